"""Scores of a whole corpus in one plan (inventory C1-C31, P8): per-row components, BM25 resonance and graph signals, joined once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import scoring as S
from corpuscle.functions.numbers import round_to
from corpuscle.functions.text import token_list, tokens, topic_label, words
from corpuscle.operators import relational as R
from corpuscle.operators.search import best_two, resonance
from corpuscle.operators.search import field as field_text


def graph_signals(videos: DataFrame, keywords: Sequence[str], centrality: DataFrame) -> DataFrame:
    """(video_id, tag_authority, topic_dominance, keyword_competition).

    Each signal is a table of tags, of (channel, token) pairs or of keywords; videos look their own up by joins on those keys.
    """
    authority = R.tag_authority(videos, centrality)
    tagged = videos.select("video_id", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    by_tag = tagged.join(authority, "tag").groupBy("video_id").agg(F.least(F.avg("authority"), F.lit(100.0)).alias("tag_authority"))
    dominance = R.topic_dominance(videos)
    by_topic = videos.select("video_id", "channel_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("token")).join(dominance.select("channel_id", "token", "dominance"), ["channel_id", "token"]).groupBy("video_id").agg(F.max("dominance").alias("topic_dominance"))
    best = R.keyword_dominance(videos, keywords).agg(F.least(F.coalesce(F.max("dominance") * 100, F.lit(0.0)), F.lit(100.0))).first()[0] if keywords else 0.0
    out = videos.select("video_id").join(by_tag, "video_id", "left").join(by_topic, "video_id", "left")
    return out.select("video_id", F.coalesce("tag_authority", F.lit(0.0)).alias("tag_authority"), F.coalesce("topic_dominance", F.lit(0.0)).alias("topic_dominance"), F.lit(best or 0.0).alias("keyword_competition"))


GRAPH = ("tag_authority", "topic_dominance", "keyword_competition")
SEARCHED = (("title", "keyword_title"), ("description", "keyword_desc"), ("tags", "keyword_tags"))


def component_columns(base: DataFrame, keywords: Column, keyword_sets: Column) -> tuple[DataFrame, list[str], list[str]]:
    """All components as columns of the rows (and of GRAPH and the resonances _title, _description, _tags, if they are there; else 0), with their names.

    Tokens, words and lines are columns first, so that each is found once.
    """
    column = lambda name, kind: F.col(name) if name in base.columns else F.lit(None).cast(kind)
    title, description, tags = F.col("title"), F.col("description"), F.coalesce("tags", F.array().cast("array<string>"))
    urls = F.coalesce(column("topic_categories", "array<string>"), F.array().cast("array<string>"))
    made = base.withColumns(S.prepared(title, description, tags) | {"_topics": F.flatten(F.transform(F.array_compact(F.transform(urls, topic_label)), tokens))})
    made = made.withColumns({"_kw": keywords, "_sets": keyword_sets})
    seo = S.structural(title, description, tags, F.col("_kw"), F.col("_sets"))
    seo |= {name: S.keyword_resonance(column(f"_{field}", "double")) for field, name in SEARCHED}
    seo |= {k: F.coalesce(column(k, "double"), F.lit(0.0)) for k in GRAPH}
    located = S.has_location(column("recording_location_name", "string"), column("recording_lat", "double"), column("recording_lng", "double"))
    geo = S.generative(description, tags, F.col("_kw"), F.col("_topics"), located, column("recording_date", "timestamp"), column("published_at", "timestamp"))
    return made.select("video_id", *[v.cast("double").alias(k) for k, v in (seo | geo).items()]), list(S.SEO_WEIGHTS), list(S.GEO_WEIGHTS)


def totals(parts: DataFrame, seo_weights: dict[str, float] = S.SEO_WEIGHTS, geo_weights: dict[str, float] = S.GEO_WEIGHTS, seo_weight: float = 1.0, geo_weight: float = 1.0) -> DataFrame:
    """(video_id, seo_score, geo_score, total_score, components) of rows with all components, which are kept to four digits."""
    names = [*S.SEO_WEIGHTS, *S.GEO_WEIGHTS]
    means = parts.withColumns({"_seo": S.weighted({k: F.col(k) for k in seo_weights}, seo_weights), "_geo": S.weighted({k: F.col(k) for k in geo_weights}, geo_weights)})
    kept = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[round_to(F.col(k), 4) for k in names]))
    return means.select("video_id", S.rounded_score(F.col("_seo")).alias("seo_score"), S.rounded_score(F.col("_geo")).alias("geo_score"), S.total_score(F.col("_seo"), F.col("_geo"), seo_weight, geo_weight).alias("total_score"), kept.alias("components"))


def score_parts(videos: DataFrame, keywords: Sequence[str], centrality: DataFrame | None = None) -> DataFrame:
    """C1-C25 of every video for a list of tracked keywords, a column each. Graph signals are 0 without centralities."""
    base = videos
    for field, _ in SEARCHED:
        base = base.join(resonance(videos, "video_id", field_text(field), " ".join(keywords)).withColumnRenamed("resonance", f"_{field}"), "video_id")
    if centrality is not None:
        base = base.join(graph_signals(videos, keywords, centrality), "video_id")
    kw = S.strings(sorted({t for k in keywords for t in token_list(k)}))
    return component_columns(base, kw, F.array(*[S.strings(token_list(k)) for k in keywords]))[0]


def score_videos(videos: DataFrame, keywords: Sequence[str], centrality: DataFrame | None = None, seo_weights: dict[str, float] = S.SEO_WEIGHTS, geo_weights: dict[str, float] = S.GEO_WEIGHTS) -> DataFrame:
    """(video_id, seo_score, geo_score, total_score, components) of every video for a list of tracked keywords.

    Without keywords each title is its own query and its tokens are its keywords, which joins all titles' terms with all postings.
    """
    if keywords:
        return totals(score_parts(videos, keywords, centrality), seo_weights, geo_weights)
    base = videos.withColumn("kws", F.array(F.coalesce("title", F.lit(""))))
    if centrality is not None:
        base = base.join(graph_signals(videos, [], centrality), "video_id")
    return score_rows(base, videos, seo_weights, geo_weights)


def score_rows(rows: DataFrame, corpus: DataFrame, seo_weights: dict[str, float] = S.SEO_WEIGHTS, geo_weights: dict[str, float] = S.GEO_WEIGHTS) -> DataFrame:
    """As score_videos() for rows with keywords of their own (kws), such as drafts; a row's resonance is with the rest of the corpus."""
    query = F.array_join("kws", " ")
    base = rows
    asked = rows.select(query.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    for field, _ in SEARCHED:
        best = best_two(corpus, "video_id", field_text(field), asked)
        base = base.withColumn("_query", query).join(best.withColumnRenamed("query_id", "_query"), "_query", "left")
        base = base.withColumn(f"_{field}", F.coalesce(F.when(F.col("first") == F.col("video_id"), F.col("second")).otherwise(F.col("best")), F.lit(0.0))).drop("_query", "first", "best", "second")
    sets = F.transform("kws", tokens)
    return totals(component_columns(base, F.array_distinct(F.flatten(sets)), sets)[0], seo_weights, geo_weights)


def metadata_score(rows: DataFrame, title: str = "title", tags: str = "tags") -> DataFrame:
    """(video_id, seo_score) of titles and tags alone, the title's tokens for keywords, without corpus, graph and description."""
    base = rows.select("video_id", F.col(title).alias("title"), F.lit("").alias("description"), F.col(tags).alias("tags"))
    toks = tokens(F.col("title"))
    parts, seo, _ = component_columns(base, F.array_distinct(toks), F.array(toks))
    return parts.select("video_id", S.rounded_score(S.weighted({k: F.col(k) for k in seo}, S.SEO_WEIGHTS)).alias("seo_score"))


def checklist(rows: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(video_id, component, message, current) of what can be mended in each row, the weakest first."""
    kw = S.strings(sorted({t for k in keywords for t in token_list(k)})) if keywords else F.array_distinct(tokens(F.col("title")))
    sets = F.array(*[S.strings(token_list(k)) for k in keywords]) if keywords else F.array(tokens(F.col("title")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    parts = component_columns(rows, kw, sets)[0].join(rows.select("video_id", words(F.col("description")).alias("_dw"), tags.alias("_tags_")), "video_id")
    out = parts.select("video_id", F.posexplode(S.recommendations({k: F.col(k) for k in S.SEO_WEIGHTS}, F.col("_dw"), F.col("_tags_"), S.strings(keywords))).alias("nth", "r"))
    return out.select("video_id", "nth", "r.component", "r.message", "r.current")


def backfill(videos: DataFrame, scores: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Scores of the videos that have none; resonance is still with the whole corpus."""
    return R.without(score_videos(videos, keywords), scores, "video_id")


def detail(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Some components of each score by name, weakest first."""
    return scored.select("video_id", F.explode("components").alias("component", "value")).where(F.col("component").isin(*names)).orderBy("video_id", "value", "component")
