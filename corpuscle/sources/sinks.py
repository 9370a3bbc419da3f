"""Writers: delimited files, JSON and a manifest (inventory K16-K18, K23, R20). Files are parts in a folder; Spark commits them as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers of the exported files.
HEADERS = {
    "videos": ("video_id", "channel_id", "title", "published_at", "duration_sec", "view_count", "like_count", "comment_count", "seo_score", "geo_score", "total_score"),
    "channels": ("channel_id", "handle", "title", "subscriber_count", "video_count"),
    "tags": ("tag", "uses", "first_used", "last_used"),
    "keywords": ("keyword", "niche", "created_at"),
    "keyword_rankings": ("keyword", "checked_at", "video_id", "position"),
}


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Quoted where needed, quotes doubled, a header in each part."""
    df.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A line for each row."""
    df.write.option("ignoreNullFields", False).json(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of what is exported."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.union(row)
    return out


def export(tables: dict[str, DataFrame], path: str) -> None:
    """A folder for each table as delimited text and as JSON, and the manifest."""
    for name, df in tables.items():
        write_csv(df, f"{path}/csv/{name}", HEADERS.get(name, tuple(df.columns)))
        write_json(df, f"{path}/json/{name}")
    manifest(tables).coalesce(1).write.json(f"{path}/manifest")


def report_line(title: Column, score: Column) -> Column:
    """A line of a Markdown report."""
    return F.format_string("- **%s** (%.2f)", title, score)
