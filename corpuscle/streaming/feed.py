"""Structured Streaming: ingest, snapshots, cooldown and change feeds (inventory X1-X6, and windows over late data as an addition)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators.merge import merge_by_source


def read(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_last(stream: DataFrame, key: str, at: str, value: str, late: str = "2 days") -> DataFrame:
    """The last value of each key and day; days are final once the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, "1 day")).agg(F.max_by(value, at).alias(value), F.max(at).alias(at)).select(key, F.to_date(F.col("window.start")).alias("day"), at, value)


def cooled_down(stream: DataFrame, key: str, at: str, period: str = "24 hours") -> DataFrame:
    """The first row of a key in a period; repeats within it are dropped."""
    return stream.withWatermark(at, period).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, keys: list[str], value: str, size: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums over windows of event time."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key that are no further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there and writes Parquet."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, fields: list[str], every: str | None = None, parts: int = 64) -> StreamingQuery:
    """Each batch is merged into a table by trust in its source, each key once, the last by `seq`.

    The table is dealt to so many parts by hash of the key. A batch reads and writes only the parts that its keys fall in, each as a folder of
    the part and batch, so that a batch that is run again writes the same folders and nothing else. See current().
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max(F.struct("seq", *fields, "source")).alias("r")).select(key, *[F.col("r")[f].alias(f) for f in [*fields, "source"]])
        last = last.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in last.select("part").distinct().collect()]  # at most `parts`
        if touched:
            stored = current(spark, path, before=number)
            stored = last.limit(0) if stored is None else stored.where(F.col("part").isin(*touched)).select(last.columns)
            out = merge_by_source(stored, last, key, fields).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
            out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_batches() has written: of each part the newest batch's rows; None before the first. before: as it was before that batch."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy("part").agg(F.max("batch").alias("batch"))  # a row for each part
    return rows.join(F.broadcast(newest), ["part", "batch"])


def latest_by_day(stream: DataFrame, path: str, checkpoint: str, key: str, at: str, value: str, late: str = "2 days") -> StreamingQuery:
    """The last value of each key and day, kept up as batches come: each writes the days that it changed, and state older than the watermark goes. See daily()."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return daily_last(stream, key, at, value, late).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """What latest_by_day() has written: (key, day, value) by the newest batch that changed it."""
    return spark.read.parquet(path).groupBy(key, "day").agg(F.max_by(value, "batch").alias(value))


def change_feed(stream: DataFrame, counts: Callable[[SparkSession], dict[str, int]], emit: Callable[[dict[str, int]], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """After each batch the counts are taken again and passed on, the first time and whenever they differ."""
    last: list[dict[str, int]] = []

    def check(batch: DataFrame, _: int) -> None:
        now = counts(batch.sparkSession)
        if not last or last[0] != now:
            last[:] = [now]
            emit(now)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
