"""Upserts, merges and de-duplication as pure functions of tables (inventory K1-K15, R17, R18, Z3, Z4, Z8). Spark's writers commit the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import canonical, strip
from corpuscle.operators.shared import cut


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key. Where `rows` has several of a key, the last by `seq` wins, if there is such a column."""
    if "seq" in rows.columns:
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))
        rows = rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "seq")
    else:
        rows = rows.dropDuplicates(list(key))
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """K2: the table without these keys."""
    return table.join(keys.select(*key), list(key), "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't there yet are added, each once; nothing is changed."""
    fresh = rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def keep_manual(edges: DataFrame, overlap: DataFrame) -> DataFrame:
    """New overlap edges replace the old ones; manual edges stay and win."""
    manual = edges.where("source = 'manual'")
    return manual.unionByName(overlap.join(manual.select("from_channel", "to_channel"), ["from_channel", "to_channel"], "left_anti").select(*edges.columns))


def source_rank(source: Column) -> Column:
    """K6: how far a source is trusted."""
    return F.when(source == "api", 3).when(source == "oembed", 2).otherwise(1)


def merge_by_source(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """K6: (key, fields, source, outcome): added, skipped (less trusted, or equal in all) or updated."""
    s, i = stored.select(key, F.struct(*fields, "source").alias("s")), incoming.select(key, F.struct(*fields, "source").alias("i"))
    both = s.join(i, key, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"s.{f}").eqNullSafe(F.col(f"i.{f}"))
    older = source_rank(F.col("i.source")) < source_rank(F.col("s.source"))
    equal = (source_rank(F.col("i.source")) == source_rank(F.col("s.source"))) & same
    outcome = F.when(F.col("i").isNull(), "kept").when(F.col("s").isNull(), "added").when(older | equal, "skipped").otherwise("updated")
    row = F.when(outcome.isin("added", "updated"), F.col("i")).otherwise(F.col("s"))
    return both.select(key, *[row[f].alias(f) for f in [*fields, "source"]], outcome.alias("outcome"))


def enrich(stored: DataFrame, richer: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """K7: fields of a richer source replace stored ones unless they are null or empty."""
    r = richer.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    kinds = dict(stored.dtypes)
    new = lambda f: F.when(F.size(f"_{f}") > 0, F.col(f"_{f}")) if kinds[f].startswith("array") else F.nullif(F.col(f"_{f}"), F.lit("")) if kinds[f] == "string" else F.col(f"_{f}")
    return stored.join(r, key, "left").select(*[F.coalesce(new(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])


def channel_merges(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """K8: (placeholder, channel_id): ids of a batch (channel_id, handle, seq), or of stored channels (channel_id, handle), that give way to another id of their handle.

    An id that is only a handle (@...) is a placeholder. The stored channel of a handle stays if it is real, else the first real one of the
    batch takes its place, else the last placeholder. Rows without a handle take no part.
    """
    held = stored.where("handle is not null").groupBy("handle").agg(F.min("channel_id").alias("channel_id"))
    each = batch.where("handle is not null").select("handle", "channel_id", "seq").unionByName(held.withColumn("seq", F.lit(-1)))
    real = ~F.startswith("channel_id", F.lit("@"))
    first = F.min(F.when(real, F.struct("seq", "channel_id")))["channel_id"]
    last = F.max(F.struct("seq", "channel_id"))["channel_id"]
    winner = each.groupBy("handle").agg(F.coalesce(first, last).alias("winner"))
    # a stored placeholder is merged only into what the batch brings
    return each.join(winner, "handle").where("channel_id <> winner").select(F.col("channel_id").alias("placeholder"), F.col("winner").alias("channel_id")).distinct()


def channel_rows(batch: DataFrame, merges: DataFrame, stored: DataFrame) -> DataFrame:
    """K8: the rows of a batch that are to be written: without those that give way, and those whose handle is stored under the same id."""
    known = stored.where("handle is not null").select("channel_id", "handle")
    kept = batch.join(merges.select(F.col("placeholder").alias("channel_id")), "channel_id", "left_anti").join(known, ["channel_id", "handle"], "left_anti")
    first = kept.groupBy("channel_id", "handle").agg(F.min("seq").alias("seq"))
    return kept.where("handle is null").unionByName(kept.join(first, ["channel_id", "handle", "seq"], "left_semi"))


def by_handle(channels: DataFrame, handle: str) -> DataFrame:
    """The first channel with a handle, by id."""
    return channels.where(F.col("handle") == handle).orderBy("channel_id").limit(1)


def rejected_log(rejected: DataFrame, batch_id: str, at) -> DataFrame:
    """Z3: log rows for input that was rejected (line, kind): nothing is dropped without a trace."""
    return rejected.select(F.lit(batch_id).alias("batch_id"), F.col("line").alias("item"), F.lit("failed").alias("status"), F.col("kind").alias("detail"), F.lit(at).cast("timestamp").alias("at"))


def keyword_key(keyword: Column) -> Column:
    """The form that tracked keywords are compared and kept in."""
    return F.lower(strip(keyword))


def research_run(topic: str, video_ids: Sequence[str], mean_views: float, source: str, duration_ms: int, at, spark) -> DataFrame:
    """The history row of a finished run."""
    row = spark.createDataFrame([(topic, list(video_ids), len(video_ids), float(mean_views), source, duration_ms)], "topic string, video_ids_json array<string>, video_count long, mean_views double, source string, duration_ms long")
    return row.withColumn("researched_at", F.lit(at).cast("timestamp"))


def attempt(topic: str, status: str, reason: str, at, spark) -> DataFrame:
    """The log row of an attempt."""
    return spark.createDataFrame([(topic, status, reason)], "topic string, status string, reason string").withColumn("attempted_at", F.lit(at).cast("timestamp"))


def repoint(rows: DataFrame, merges: DataFrame, column: str = "channel_id") -> DataFrame:
    """K9: placeholders in a column become the ids they were merged into."""
    m = merges.select(F.col("placeholder").alias(column), F.col("channel_id").alias("_to"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*rows.columns)


def repoint_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """K9: as repoint() at both ends, without loops and repeats."""
    out = repoint(repoint(edges, merges, "from_channel"), merges, "to_channel")
    return out.where("from_channel <> to_channel").dropDuplicates(["from_channel", "to_channel"])


def duplicate_videos(videos: DataFrame) -> DataFrame:
    """(video_id, winner) of videos that share channel and title with a better one: with a description, more views, the least id.

    The best of a group is found by an aggregate, so that a title shared by very many videos doesn't gather in one task.
    """
    rank = F.struct((F.trim(F.coalesce("description", F.lit(""))) != "").alias("described"), F.coalesce("view_count", F.lit(0)).alias("views"))
    each = videos.where("channel_id is not null and title is not null").select("video_id", "channel_id", "title", rank.alias("rank"))
    top = each.groupBy("channel_id", "title").agg(F.max("rank").alias("rank"))
    winner = each.join(top, ["channel_id", "title", "rank"]).groupBy("channel_id", "title").agg(F.min("video_id").alias("winner"))
    return each.join(winner, ["channel_id", "title"]).where("video_id <> winner").select("video_id", "winner")


def without_duplicates(table: DataFrame, duplicates: DataFrame, move: bool) -> DataFrame:
    """Rows of losing videos go to the winner (comments, tags) or are dropped (scores, curves)."""
    if not move:
        return table.join(duplicates.select("video_id"), "video_id", "left_anti")
    return table.join(duplicates, "video_id", "left").withColumn("video_id", F.coalesce("winner", "video_id")).drop("winner").select(*table.columns).dropDuplicates()


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values where a condition holds."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def clear(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Without the rows of a condition, or empty."""
    return table.limit(0) if condition is None else table.where(~F.coalesce(condition, F.lit(False)))


def numbered(table: DataFrame, rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows with ids that follow the largest one. Offsets come from counts of range partitions, not from one sorted task."""
    start = table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(column, (F.col("_before") + F.col("_nth") + start).cast("long")).drop("_part", "_nth", "_before")


def search_results(videos: DataFrame, results: DataFrame) -> DataFrame:
    """Results of a search replace title and views of known videos, keep what they don't say, and add unknown ones."""
    kinds = dict(videos.dtypes)
    r = results.dropDuplicates(["video_id"]).select("video_id", *[F.col(c).alias(f"_{c}") for c in results.columns if c in kinds and c != "video_id"])
    both = videos.withColumn("_known", F.lit(True)).join(r, "video_id", "full_outer")
    keep = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.col(f"_{c}")) if kinds[c].startswith("array") else F.coalesce(f"_{c}", c)
    return both.select(*[keep(c).alias(c) if f"_{c}" in r.columns else F.col(c) for c in videos.columns])


def entity_id(kind: str, name: Column) -> Column:
    """Type and canonical name."""
    return F.concat(F.lit(kind + ":"), canonical(name))
