"""Full-text search: postings and BM25 as DataFrames (inventory T1-T10, W3, M9-M12, Z2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import contains_all, token_list, tokens
from corpuscle.operators.shared import written

K1, B = 1.2, 0.75


# The text fields of a document that can be searched.
FIELDS = {"title": lambda: F.col("title"), "description": lambda: F.col("description"), "tags": lambda: F.array_join("tags", " ")}


def field(name: str) -> Column | None:
    """The text of a field of documents, None for an unknown name."""
    return FIELDS[name]() if name in FIELDS else None


def documents(videos: DataFrame) -> DataFrame:
    """What a search index holds of videos; times as whole seconds."""
    return videos.select("video_id", "channel_id", "title", "description", "tags", F.unix_timestamp("published_at").alias("published_at"))


def matches_in(docs: DataFrame, name: str, query: str) -> DataFrame:
    """(video_id, score) by one field; nothing for an unknown field."""
    text = field(name)
    return docs.select("video_id", F.lit(0.0).alias("score")).limit(0) if text is None else matches(docs, "video_id", text, query)


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, tf, dl): how often a term is in a document, and the document's length. A document's tokens are counted where they are."""
    toks = tokens(text)
    return docs.select(key, toks.alias("toks")).select(key, F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, text: Column) -> tuple[int, float]:
    """How many documents there are, with empty ones, and their mean length; two numbers."""
    n, total = docs.agg(F.count("*"), F.sum(F.size(tokens(text)))).first()
    return n, (total or 0) / n if n else 0.0


def equal_to(term: str):
    return lambda x: x == term


def matches(docs: DataFrame, key: str, text: Column, query: str | Sequence[str]) -> DataFrame:
    """(key, score) of documents with a query term. A repeated query term counts twice.

    Documents are read and tokenised once: each counts only the query's tokens, those with any are written, and what the formula needs of
    all is observed on the way. Nothing but hits is kept, and nothing is shuffled.
    """
    terms = token_list(query) if isinstance(query, str) else list(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    distinct = sorted(set(terms))
    tf = [F.size(F.filter("toks", equal_to(t))).alias(f"tf{i}") for i, t in enumerate(distinct)]
    counted = docs.select(key, tokens(text).alias("toks")).select(key, F.size("toks").alias("dl"), *tf)
    has = [F.col(f"tf{i}") > 0 for i in range(len(distinct))]
    seen = Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)])
    hits = written(counted.where(reduce(Column.__or__, has)), "hits")
    if hits.isEmpty():
        return hits.select(key, F.lit(0.0).alias("score"))
    n, total = seen.get["n"], seen.get["total"] or 0
    norm = K1 * (1 - B + B * F.col("dl") / max(total / n if n else 0.0, 1.0))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        d = seen.get[f"df{i}"] or 0
        idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
        score = score + terms.count(t) * idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)
    return hits.select(key, score.alias("score")).where("score > 0")


def matches_many(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """T4 for a table of queries (query_id, query): (query_id, key, score), by a join of terms with postings.

    Only postings of the queries' terms are written, in one pass that also observes the number and length of all documents.
    """
    terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if terms.isEmpty():
        return terms.select("query_id").join(docs.select(key, F.lit(0.0).alias("score")).limit(0))
    seen = Observation()
    tokenised = docs.select(key, tokens(text).alias("toks")).withColumn("dl", F.size("toks")).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    every = tokenised.select(key, "dl", F.explode("toks").alias("term"))
    wanted = written(every.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", key, "dl").agg(F.count("*").alias("tf")), "postings")
    if wanted.isEmpty():  # perhaps without having run, so that nothing was observed
        return terms.select("query_id").join(wanted.select(key, F.lit(0.0).alias("score")))
    n, total = seen.get["n"], seen.get["total"] or 0
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(total / n if n else 0.0, 1.0)))
    return terms.join(df, "term").join(wanted, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))


def best_two(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """T5 for a table of queries: (query_id, first, best, second): the best document, its score and the next score; ties by key."""
    found = matches_many(docs, key, text, queries)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))  # two rows of each task and query are kept
    top = found.withColumn("nth", nth).where("nth <= 2")
    return top.groupBy("query_id").agg(F.max(F.when(F.col("nth") == 1, F.col(key))).alias("first"), F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("score"))), F.lit(0.0)).alias("second"))


def resonance(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """T5: for every document the best score that any other has for a query; 0 if none.

    One pass finds the best two scores; a document that holds the best gets the second.
    """
    found = matches(docs, key, text, query)
    best = found.orderBy(F.desc("score"), key).limit(2).collect()
    first = (best[0][key], best[0]["score"]) if best else (None, 0.0)
    second = best[1]["score"] if len(best) > 1 else 0.0
    return docs.select(key, F.when(F.col(key).eqNullSafe(F.lit(first[0])), second).otherwise(first[1]).alias("resonance"))


def vocabulary(docs: DataFrame, text: Column) -> DataFrame:
    """Distinct terms."""
    return docs.select(F.explode(tokens(text)).alias("term")).distinct()


def updated(index: DataFrame, changed: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Postings after the documents of `changed` (postings too) were put in or replaced. keys: all that changed, also those that have no terms now."""
    gone = changed if keys is None else keys
    return index.join(gone.select(key).distinct(), key, "left_anti").unionByName(changed)


def demand(hits: Column, full: int = 20) -> Column:
    """Matches as a share of what counts as full demand."""
    return F.least(hits / full, F.lit(1.0))


def first_own_position(found: DataFrame, competitors: DataFrame, within: int = 10) -> DataFrame:
    """Of matches (keyword, video_id, channel_id, score) the best one of a known channel that is no competitor, and its rank; no position beyond `within`.

    Its rank is one more than the number of better matches, ties by id: two aggregates, so that a keyword's matches never gather.
    """
    own = found.where("channel_id is not null").join(competitors.select("channel_id").distinct(), "channel_id", "left_anti")
    best = own.groupBy("keyword").agg(F.max("score").alias("best"))
    first = own.join(best, "keyword").where("score = best").groupBy("keyword", "best").agg(F.min("video_id").alias("first"))
    ranks = found.join(first, "keyword").groupBy("keyword", "first").agg(F.count_if((F.col("score") > F.col("best")) | ((F.col("score") == F.col("best")) & (F.col("video_id") <= F.col("first")))).alias("rank"))
    return ranks.select("keyword", F.col("first").alias("video_id"), F.when(F.col("rank") <= within, F.col("rank")).alias("position"))


def topic_cluster(found: DataFrame) -> DataFrame:
    """A blend of search score and views for videos of a topic (seo_score, view_count)."""
    views = F.when(F.col("view_count") > 0, F.least(F.log("view_count") / 20, F.lit(1.0)) * 50).otherwise(0.0)
    return found.withColumn("blend", 0.7 * F.coalesce("seo_score", F.lit(0.0)) + 0.3 * views)


def keyword_best(videos: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    """Videos whose titles have all of a keyword's tokens, by views (view_count, seo_score)."""
    need = F.array(*[F.lit(t) for t in token_list(keyword)]).cast("array<string>")
    out = videos.where(contains_all(tokens(F.col("title")), need)).select("video_id", F.coalesce("seo_score", F.lit(0.0)).alias("seo_score"), F.coalesce("view_count", F.lit(0)).alias("view_count"))
    out = out.orderBy(F.desc("view_count"), "video_id")
    return out if limit is None else out.limit(limit)


def topic_outliers(videos: DataFrame, topic: str, multiple: float) -> DataFrame:
    """Videos with the topic among their title's tokens and a multiple of these videos' mean views, the threshold included; nothing for a mean of 0."""
    found = videos.where(F.array_contains(tokens(F.col("title")), topic.lower()) & F.col("view_count").isNotNull())
    mean = found.agg(F.avg("view_count").alias("mean_views")).where("mean_views > 0")
    return found.join(F.broadcast(mean), F.col("view_count") >= multiple * F.col("mean_views")).select("video_id", "view_count", "mean_views")  # one row


def write_index(docs: DataFrame, key: str, text: Column, path: str, buckets: int = 64) -> None:
    """Postings in folders by hash of the term, sorted, so that a query reads the folders of its terms and skips most of a file."""
    out = postings(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").mode("overwrite").parquet(path)


def indexed_matches(index: DataFrame, key: str, n: int, mean: float, query: str, buckets: int = 64) -> DataFrame:
    """T4 over a written index: (key, score); only the folders of the query's terms are read."""
    terms = token_list(query)
    spark = index.sparkSession
    known = spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times long")
    here = reduce(Column.__or__, [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in set(terms)], F.lit(False))  # constants, so that folders are skipped
    hits = index.where(here & F.col("term").isin(*set(terms)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = df.join(known, "term").select("term", "times", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(mean, 1.0)))
    return hits.join(F.broadcast(stats), "term").groupBy(key).agg(F.sum(part).alias("score"))  # a row for each query term


def index_fresh(reindexed: Column, ingested: Column, videos: Column) -> Column:
    """Whether the index is no older than the last ingest; so for an empty corpus."""
    return F.coalesce(reindexed >= ingested, F.lit(False)) | (videos == 0)
