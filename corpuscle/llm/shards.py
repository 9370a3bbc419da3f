"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are sorted by key over range partitions. Totals of the partitions, one row each, give the bytes and rows before each partition;
a running sum within the partition gives those before each row. A row goes to the shard that the middle of its bytes falls into when
the whole is cut at equal targets, so that a shard's bytes are off its target by no more than a row at either end.

Edge cases: a null text has no bytes and still counts one; null keys come first; rows with equal keys are ordered by checksum and
size, and rows alike in all of these are interchangeable. An empty table gives an empty result. Fewer rows than shards leave some empty. Of a
text of any length only size and checksum are sorted. Only key and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep


def ordered(df: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """The table sorted by range partitions, with their number as _part, in the shared folder.

    A random column settles ties, so that a key that holds many rows is dealt to several partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc_nulls_first() for c in by], F.col("_tie")]
    dealt = df.withColumn("_tie", F.rand(17)).repartitionByRange(n, *keys)
    return keep(dealt.withColumn("_part", F.spark_partition_id()), "ordered")


def prefix_sums(parts: DataFrame, by: list[str], size: str) -> DataFrame:
    """Adds before (bytes of all earlier rows) and row (their number) to a table by ordered()."""
    totals = parts.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"))
    within = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in by], "_tie")
    running = parts.withColumns({"_sum": F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(within)})
    placed = running.join(F.broadcast(starts), "_part")
    return placed.withColumns({"before": F.col("_bytes") + F.col("_sum") - F.col(size), "row": F.col("_rows") + F.col("_nth") - 1}).drop("_bytes", "_rows", "_sum", "_nth")


def shard(documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, size, text_crc32, shard, slot, before) for each document; the shards are contiguous in the order of the key.

    Only these small columns are sorted and shuffled, never the texts: a writer joins or reads texts by key and shard.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = documents.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    by = [key, "text_crc32", "size"]
    rows = prefix_sums(ordered(rows, by), by, "size")
    rows = keep(rows, "placed")
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = F.expr(f"least({shards - 1}, (cast(2 * before + size as decimal(38, 0)) * {shards}) div {2 * total})")
    rows = rows.withColumn("shard", middle.cast("int"))
    first = rows.groupBy("shard").agg(F.min("row").alias("_first"))  # a row for each shard
    return rows.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "shard", (F.col("row") - F.col("_first")).alias("slot"), "before")
