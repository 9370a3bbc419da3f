"""Readers for feeds, API answers, search results and captions (inventory S7-S16, Z1, Z14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.numbers import iso_seconds
from corpuscle.functions.text import strip, words


def channel_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id, title (the id if empty), link, times, description, thumbnail, rating and views; entries without id go."""
    schema = """`yt:videoId` STRING, `yt:channelId` STRING, title STRING, link STRUCT<_href: STRING>, published STRING, updated STRING, `media:group` STRUCT<`media:description`: STRING,
      `media:thumbnail`: STRUCT<_url: STRING>, `media:community`: STRUCT<`media:starRating`: STRUCT<_average: DOUBLE, _count: BIGINT>, `media:statistics`: STRUCT<_views: BIGINT>>>"""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    group, community = F.col("`media:group`"), F.col("`media:group`.`media:community`")
    out = rows.select(
        F.trim(F.col("`yt:videoId`")).alias("video_id"), F.trim(F.col("`yt:channelId`")).alias("channel_id"), F.trim("title").alias("title"), F.col("link._href").alias("link"),
        F.try_to_timestamp("published").alias("published"), F.try_to_timestamp("updated").alias("updated"), group["media:description"].alias("description"), group["media:thumbnail"]["_url"].alias("thumbnail_url"),
        community["media:starRating"]["_average"].alias("star_rating"), community["media:starRating"]["_count"].alias("rating_count"), community["media:statistics"]["_views"].alias("views"),
    )
    return out.where("video_id is not null and video_id <> ''").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "video_id"))


API_ITEM = """items ARRAY<STRUCT<id STRING, snippet STRUCT<publishedAt STRING, channelId STRING, channelTitle STRING, title STRING, description STRING, categoryId STRING, tags ARRAY<STRING>>,
  contentDetails STRUCT<duration STRING>, statistics STRUCT<viewCount STRING, likeCount STRING, commentCount STRING>, status STRUCT<privacyStatus STRING>>>"""


def api_videos(spark: SparkSession, path: str) -> DataFrame:
    """Answers with a list of items; counts come as strings, durations as ISO-8601."""
    item = spark.read.schema(API_ITEM).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    n = lambda c: F.col(f"i.statistics.{c}").try_cast("long")
    return item.select(
        F.col("i.id").alias("video_id"), F.col("i.snippet.channelId").alias("channel_id"), F.col("i.snippet.channelTitle").alias("channel_title"), F.col("i.snippet.title").alias("title"),
        F.coalesce("i.snippet.description", F.lit("")).alias("description"), F.coalesce("i.snippet.tags", F.array().cast("array<string>")).alias("tags"), F.col("i.snippet.categoryId").alias("category_id"),
        iso_seconds(F.col("i.contentDetails.duration")).alias("duration_sec"), F.try_to_timestamp("i.snippet.publishedAt").alias("published_at"),
        n("viewCount").alias("view_count"), n("likeCount").alias("like_count"), n("commentCount").alias("comment_count"), F.lit("api").alias("source"),
    )


def availability(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, privacy_status) of the items that an answer has."""
    return spark.read.schema(API_ITEM).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select(F.col("i.id").alias("video_id"), F.col("i.status.privacyStatus").alias("privacy_status"))


def missing(stored: DataFrame, available: DataFrame) -> DataFrame:
    """Stored videos that weren't in the answer, with status "missing", and others with theirs."""
    return stored.select("video_id").join(available, "video_id", "left").select("video_id", F.coalesce("privacy_status", F.lit("missing")).alias("privacy_status"))


def oembed(spark: SparkSession, path: str) -> DataFrame:
    """Title, author and the author's handle from the url."""
    rows = spark.read.schema("title STRING, author_name STRING, author_url STRING, thumbnail_url STRING").option("multiLine", True).json(path)
    return rows.withColumn("handle", F.nullif(F.regexp_extract("author_url", "/(@[^/]+)", 1), F.lit("")))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """A result for each line; broken lines and results without id go. Upload days become dates."""
    schema = "id STRING, title STRING, channel STRING, channel_id STRING, view_count BIGINT, like_count BIGINT, comment_count BIGINT, upload_date STRING, tags ARRAY<STRING>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("id is not null and id <> ''")
    return rows.withColumns({"upload_date": F.to_date(F.try_to_timestamp("upload_date", F.lit("yyyyMMdd"))), "tags": F.coalesce("tags", F.array().cast("array<string>"))}).withColumnRenamed("id", "video_id")


def comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of videos, a line for each video with a list of them."""
    schema = "id STRING, comments ARRAY<STRUCT<id: STRING, author: STRING, text: STRING, like_count: BIGINT, timestamp: BIGINT>>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(F.col("id").alias("video_id"), F.explode("comments").alias("c")).select("video_id", F.col("c.id").alias("comment_id"), "c.author", "c.text", F.coalesce("c.like_count", F.lit(0)).alias("like_count"), F.timestamp_seconds("c.timestamp").alias("published_at")).where("comment_id is not null")


def heatmaps(spark: SparkSession, path: str) -> DataFrame:
    """Attention curves, points in order of time; videos without one go."""
    schema = "id STRING, heatmap ARRAY<STRUCT<start_time: DOUBLE, value: DOUBLE>>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.size("heatmap") > 0)
    return rows.select(F.col("id").alias("video_id"), F.array_sort("heatmap").alias("points"))


def suggestions(payload: Column) -> Column:
    """The strings of an autocomplete answer, a JSON array whose second element lists them first in each entry."""
    return F.regexp_extract_all(payload, F.lit(r'\["((?:[^"\\]|\\.)*)",0'), F.lit(1))


def caption_lines(vtt: Column) -> Column:
    """The cues of WebVTT captions as arrays of clean lines, in order.

    Cues begin with a line that has an arrow; the header ends with the first blank line. Numbers and lines of notes and styles go, as do marks and the
    speaker's sign at the start of a line.
    """
    rows = F.transform(F.split(F.coalesce(vtt, F.lit("")), r"\r?\n"), strip)
    blank = F.array_position(rows, F.lit(""))
    body = F.when(blank > 0, F.slice(rows, F.lit(1) + blank.cast("int"), F.size(rows))).otherwise(F.slice(rows, 1, 0))
    said = F.filter(body, lambda x: ~F.rlike(x, F.lit("^[0-9]*$")) & (~F.rlike(x, F.lit("^(NOTE |STYLE)")) | F.contains(x, F.lit("-->"))))
    clean = F.transform(said, lambda x: F.when(F.contains(x, F.lit("-->")), F.lit(CUE)).otherwise(strip(F.regexp_replace(strip(F.regexp_replace(x, "<[^>]*(>|$)", "")), "^>>", ""))))
    cues = F.split(F.array_join(F.filter(clean, lambda x: x != ""), "\n"), f"(^|\n){CUE}(\n|$)|{CUE}\n?")
    return F.filter(F.transform(cues, lambda c: F.filter(F.split(c, "\n"), lambda x: x != "")), lambda c: F.size(c) > 0)


#: Stands for a cue's line of times.
CUE = "\x1e"


def spoken_text(vtt: Column) -> Column:
    """The text of captions, a line for each cue: without those that repeat the line before, or, of a cue that begins with it, only what is new."""

    def add(lines: Column, cue: Column) -> Column:
        last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
        rest = F.when(F.array_join(cue, " ") == last, F.slice(cue, 1, 0)).when(F.get(cue, F.lit(0)) == last, F.slice(cue, 2, F.size(cue))).otherwise(cue)
        new = F.array_join(rest, " ")
        return F.when((new == "") | (new == last), lines).otherwise(F.array_append(lines, new))

    return F.array_join(F.aggregate(caption_lines(vtt), F.array().cast("array<string>"), add), "\n")


def transcripts(captions: DataFrame, key: str = "video_id", vtt: str = "vtt") -> DataFrame:
    """(key, text, word_count) of captions."""
    return captions.select(key, spoken_text(F.col(vtt)).alias("text")).withColumn("word_count", F.size(words(F.col("text"))).cast("long"))


def shown_comments(comments_: DataFrame, most: int = 120) -> DataFrame:
    """Comments by likes, cut to so many characters for display."""
    return comments_.select("comment_id", "video_id", "author", F.left("text", F.lit(most)).alias("text"), "like_count").orderBy(F.desc("like_count"), "comment_id")


# The names of video categories by number.
CATEGORIES = {
    1: "Film & Animation", 2: "Autos & Vehicles", 10: "Music", 15: "Pets & Animals", 17: "Sports", 18: "Short Movies", 19: "Travel & Events", 20: "Gaming", 21: "Videoblogging", 22: "People & Blogs", 23: "Comedy",
    24: "Entertainment", 25: "News & Politics", 26: "Howto & Style", 27: "Education", 28: "Science & Technology", 29: "Nonprofits & Activism", 30: "Movies", 31: "Anime/Animation", 32: "Action/Adventure", 33: "Classics",
    34: "Comedy", 35: "Documentary", 36: "Drama", 37: "Family", 38: "Foreign", 39: "Horror", 40: "Sci-Fi/Fantasy", 41: "Thriller", 42: "Shorts", 43: "Shows", 44: "Trailers",
}


def categories(spark: SparkSession) -> DataFrame:
    """The 32 categories as a table."""
    return spark.createDataFrame([(str(k), v) for k, v in CATEGORIES.items()], "category_id string, category string")


def category_breakdown(videos: DataFrame) -> DataFrame:
    """Videos of each category by name, unknown numbers as they are."""
    names = F.broadcast(categories(videos.sparkSession))  # 32 rows
    return videos.where("category_id is not null").join(names, "category_id", "left").groupBy(F.coalesce("category", "category_id").alias("category")).agg(F.count("*").alias("videos"))
