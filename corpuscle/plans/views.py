"""The corpus over the driver's tables: each view as a DataFrame and as DuckDB SQL, defined alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions.numbers import round_to
from corpuscle.functions.text import tokens

KEYWORDS = ("red", "blue", "small", "bolt", "gear", "ring", "widget", "anvil")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Texts that lie in fewer files than there are cores are dealt out, since a small file is read by one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and len(df.inputFiles()) < cores else df


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, "api").when(F.col("doc_id") % 3 == 1, "oembed").otherwise("rss")
    return d.select(
        F.col("doc_id").cast("string").alias("video_id"), F.col("source").alias("channel_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"), F.col("text").alias("description"),
        F.array_distinct(tokens(F.col("text"), 6)).alias("tags"), F.col("lang").alias("category_id"), (F.col("n_chars") % 900).alias("duration_sec"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("published_at"), F.col("n_chars").alias("view_count"), F.when(F.col("doc_id") % 7 != 3, F.col("n_chars") % 97).alias("like_count"),
        F.when(F.col("doc_id") % 11 != 5, F.col("n_chars") % 13).alias("comment_count"), source.alias("source"), F.when(F.col("doc_id") % 10 == 1, "unlisted").when(F.col("doc_id") % 10 == 2, "private").otherwise("public").alias("privacy_status"),
        F.when(F.col("lang").isNotNull(), F.array(F.concat(F.lit("https://example.org/wiki/"), "lang", F.lit("_the_texts")))).alias("topic_categories"), F.when(F.col("doc_id") % 5 == 0, F.lit("here")).alias("recording_location_name"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(1.5)).alias("recording_lat"), F.when(F.col("doc_id") % 8 == 0, F.lit(2.5)).alias("recording_lng"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600 + F.col("doc_id") % 17 * 86400).alias("recording_date"),
    )


def tok_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


VIDEOS = f"""v0 AS (SELECT *, {tok_sql("text")}[1:6] AS tk FROM documents),
v AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, source AS channel_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS title, text AS description, list_filter(tk, lambda x, i: list_position(tk, x) = i) AS tags,
  lang AS category_id, n_chars % 900 AS duration_sec, TIMESTAMP '2024-01-01' + to_hours(doc_id::INTEGER) AS published_at, n_chars AS view_count, CASE WHEN doc_id % 7 <> 3 THEN n_chars % 97 END AS like_count, CASE WHEN doc_id % 11 <> 5 THEN n_chars % 13 END AS comment_count,
  CASE doc_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'oembed' ELSE 'rss' END AS source, CASE doc_id % 10 WHEN 1 THEN 'unlisted' WHEN 2 THEN 'private' ELSE 'public' END AS privacy_status,
  CASE WHEN lang IS NOT NULL THEN ['https://example.org/wiki/' || lang || '_the_texts'] END AS topic_categories, CASE WHEN doc_id % 5 = 0 THEN 'here' END AS recording_location_name, CASE WHEN doc_id % 4 = 0 THEN 1.5 END AS recording_lat,
  CASE WHEN doc_id % 8 = 0 THEN 2.5 END AS recording_lng, TIMESTAMP '2024-01-01' + to_hours(doc_id::INTEGER) + to_days((doc_id % 17)::INTEGER) AS recording_date FROM v0)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("view_count"))
    p = table(spark, sf_dir, "part").join(sold, "p_partkey", "left")
    return p.select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_brand").alias("channel_id"), F.col("p_name").alias("title"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("tags"), F.coalesce("view_count", F.lit(0)).alias("view_count"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("description"))


CATALOG = """c AS (SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_brand AS channel_id, p_name AS title, list_append(string_split(p_name, ' '), lower(p_type)) AS tags, coalesce(s, 0)::BIGINT AS view_count
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = videos(spark, sf_dir).select("channel_id").distinct()
    n = F.regexp_extract("channel_id", "([0-9]+)", 1).cast("long")
    return c.select("channel_id", F.concat(F.lit("Channel "), "channel_id").alias("title"), (n % 2 == 1).alias("competitor"), (n * 7000).alias("subscriber_count"), F.timestamp_seconds(F.lit(1704067200) + n * 86400).alias("fetched_at"))


CHANNELS = """ch AS (SELECT channel_id, 'Channel ' || channel_id AS title, k % 2 = 1 AS competitor, k * 7000 AS subscriber_count, TIMESTAMP '2024-01-01' + to_days(k::INTEGER) AS fetched_at
  FROM (SELECT DISTINCT channel_id, regexp_extract(channel_id, '([0-9]+)', 1)::BIGINT AS k FROM v))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    s = j.select(F.col("doc_id").cast("string").alias("video_id"), (F.col("quality") * 60 + F.col("doc_id") % 40).cast("double").alias("seo_score"), ((1 - F.col("toxic")) * 50 + F.col("doc_id") % 50).cast("double").alias("geo_score"))
    return s.withColumn("total_score", round_to((F.col("seo_score") + F.col("geo_score")) / 2))


SCORES = """sc AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, (quality * 60 + doc_id % 40)::DOUBLE AS seo_score, ((1 - toxic) * 50 + doc_id % 50)::DOUBLE AS geo_score,
  floor((quality * 60 + doc_id % 40 + (1 - toxic) * 50 + doc_id % 50)::DOUBLE / 2 * 100 + 0.5) / 100 AS total_score FROM labels JOIN documents USING (doc_id))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def research(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).groupBy(F.concat(F.lit("the "), F.col("event_type")).alias("keyword"), F.date_trunc("day", "ts").alias("at")).agg(F.round(F.avg("value"), 6).alias("opportunity_score"), F.count("*").alias("serp_total"))
    volume = F.when(F.col("serp_total") % 3 == 0, "High").when(F.col("serp_total") % 3 == 1, "Medium").otherwise("Low")
    return day.withColumns({"competition_score": (F.col("serp_total") % 100).cast("double"), "volume_label": volume, "serp_mean_views": (F.col("serp_total") * 1000).cast("double")})


RESEARCH = """rs AS (SELECT *, (serp_total % 100)::DOUBLE AS competition_score, CASE serp_total % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS volume_label, (serp_total * 1000)::DOUBLE AS serp_mean_views
  FROM (SELECT 'the ' || event_type AS keyword, date_trunc('day', ts)::TIMESTAMP AS "at", round(avg(value), 6) AS opportunity_score, count(*) AS serp_total FROM events GROUP BY 1, 2))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("channel_id"), F.date_trunc("day", "ts").alias("at")).agg(F.sum("value").alias("s"))
    running = F.sum("s").over(Window.partitionBy("channel_id").orderBy("at"))
    return day.select("channel_id", "at", F.round(running, 6).alias("total_views"))


SNAPSHOTS = """sn AS (SELECT channel_id, "at", round(sum(s) OVER (PARTITION BY channel_id ORDER BY "at"), 6) AS total_views
  FROM (SELECT CAST(user_id AS VARCHAR) AS channel_id, date_trunc('day', ts)::TIMESTAMP AS "at", sum(value) AS s FROM events GROUP BY 1, 2))"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).groupBy(F.col("event_type").alias("keyword"), F.date_trunc("day", "ts").alias("checked_at")).agg(F.round(F.sum("value"), 6).alias("s"))
    return day.select("keyword", "checked_at", F.row_number().over(Window.partitionBy("checked_at").orderBy(F.desc("s"), "keyword")).cast("long").alias("position"))


RANKINGS = """rk AS (SELECT keyword, checked_at, row_number() OVER (PARTITION BY checked_at ORDER BY s DESC, keyword) AS position
  FROM (SELECT event_type AS keyword, date_trunc('day', ts)::TIMESTAMP AS checked_at, round(sum(value), 6) AS s FROM events GROUP BY 1, 2))"""


def with_views(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
