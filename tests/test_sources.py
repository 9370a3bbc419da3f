"""Readers, links, writers and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuscle.sources import feeds, links, sinks
from corpuscle.streaming import feed

ATOM = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns:yt="urn:y" xmlns:media="urn:m" xmlns="http://www.w3.org/2005/Atom">
<entry><yt:videoId>zz-9plural0</yt:videoId><yt:channelId>UCbread</yt:channelId><title>Baking &lt;rye&gt;</title><link rel="alternate" href="https://example.org/rye"/><published>2025-03-02T07:30:00+02:00</published><updated>2025-03-03T00:00:00+00:00</updated>
<media:group><media:description>salt &amp; flour</media:description><media:thumbnail url="https://example.org/rye.png"/><media:community><media:starRating count="3" average="4.5"/><media:statistics views="77"/></media:community></media:group></entry>
<entry><yt:videoId>qq-9plural8</yt:videoId><yt:channelId>UCbread</yt:channelId><title></title></entry><entry><yt:videoId></yt:videoId><title>No id</title></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(ATOM)
    r = {x["video_id"]: x for x in feeds.channel_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert set(r) == {"zz-9plural0", "qq-9plural8"} and r["qq-9plural8"]["title"] == "qq-9plural8"
    one = r["zz-9plural0"]
    assert (one["title"], one["views"], one["star_rating"], one["description"], one["published"]) == ("Baking <rye>", 77, 4.5, "salt & flour", dt.datetime(2025, 3, 2, 5, 30))


def test_json_sources(spark, tmp_path):
    item = {"id": "v1", "snippet": {"title": "T", "channelId": "C", "publishedAt": "2024-01-01T00:00:00Z"}, "contentDetails": {"duration": "PT12M34S"}, "statistics": {"viewCount": "7", "likeCount": "x"}, "status": {"privacyStatus": "public"}}
    (tmp_path / "a.json").write_text(json.dumps({"items": [item]}))
    r = feeds.api_videos(spark, str(tmp_path / "a.json")).first()
    assert (r["duration_sec"], r["view_count"], r["like_count"], r["tags"]) == (754, 7, None, [])
    stored = spark.createDataFrame([("v1",), ("v2",)], "video_id string")
    assert sorted(map(tuple, feeds.missing(stored, feeds.availability(spark, str(tmp_path / "a.json"))).collect())) == [("v1", "public"), ("v2", "missing")]
    (tmp_path / "s.json").write_text('{"id":"x","upload_date":"20240203"}\nbroken\n{"id":""}\n')
    out = feeds.search_results(spark, str(tmp_path / "s.json")).collect()
    assert [(r["video_id"], r["upload_date"]) for r in out] == [("x", dt.date(2024, 2, 3))]
    (tmp_path / "o.json").write_text('{"title":"t","author_url":"https://e.com/@chan"}')
    assert feeds.oembed(spark, str(tmp_path / "o.json")).first()["handle"] == "@chan"


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:01 --> 00:02\n>> Hello <b>there</b>\n\n00:02 --> 00:03\n>> Hello there\nagain\n\nNOTE skip\n7\nNOTEBOOKS are\n²\n00:03 --> 00:04\nNOTEBOOKS are ²\nagain NOTEBOOKS are ²\n\n00:04 --> 00:05\nbye <c"
    df = spark.createDataFrame([("1", vtt), ("2", None), ("3", "WEBVTT"), ("4", "h\n\n00:01 --> 00:02\nx\n\n00:02 --> 00:03\nx\n00:03 --> 00:04\nx y")], "video_id string, vtt string")
    out = {r["video_id"]: (r["text"], r["word_count"]) for r in feeds.transcripts(df).collect()}
    assert out["1"] == ("Hello there\nagain NOTEBOOKS are ²\nNOTEBOOKS are ² again NOTEBOOKS are ²\nbye", 14)
    assert out["2"] == out["3"] == ("", 0) and out["4"] == ("x\nx y", 3)


@pytest.mark.parametrize("line,kind,ref", [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "video_url", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?t=1", "video_url", "dQw4w9WgXcQ"), ("https://m.youtube.com/shorts/dQw4w9WgXcQ", "video_url", "dQw4w9WgXcQ"), ("dQw4w9WgXcQ", "video_id", "dQw4w9WgXcQ"),
    ("dQw4w9WgXcB", "rejected", None), ("https://www.youtube.com/playlist?list=PL123", "playlist", "PL123"), ("@handle", "handle", "@handle"), ("https://www.youtube.com/@handle/videos", "handle", "@handle"), ("https://youtube.com/c/Name", "custom", "Name"),
    ("SC" + "a" * 21 + "w", "channel_id", "UC" + "a" * 21 + "w"), ("UC" + "a" * 21 + "A", "rejected", None), ("hello", "rejected", None),
    ("https://example.com/watch?v=dQw4w9WgXcQ", "rejected", None), ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&list=PL9", "playlist", "PL9"), ("https://www.youtube.com/channel/UCx/videos", "channel_url", "UCx"), ("https://youtube.com/user/Me", "custom", "Me"),
    ("PLabc", "playlist", "PLabc"), ("https://www.youtube.com/live/dQw4w9WgXcQ?feature=x", "video_url", "dQw4w9WgXcQ"), ("UC" + "a" * 21 + "[", "rejected", None), ("UC" + "a" * 21 + "-", "channel_id", "UC" + "a" * 21 + "-"),
])
def test_links(spark, line, kind, ref):
    r = links.inputs(spark.createDataFrame([(line,)], "line string")).first()
    assert (r["kind"], r["ref"]) == (kind, ref)


def test_link_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\n a # note\nhttps://x/y#z\n")
    assert [r["line"] for r in links.link_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "https://x/y"]


def test_video_ids(spark):
    lines = ["https://youtu.be/dQw4w9WgXcQ", "x youtu.be/aaa111bbb22 y", "dQw4w9WgXcQ", "dQw4w9WgXcB", "watch v=short", "https://m.youtube.com/embed/aaa111bbb22?x", "# dQw4w9WgXcQ", "see /shorts/ccc111bbb22!"]
    out = links.distinct_video_ids(spark.createDataFrame(list(enumerate(lines)), "n int, line string")).collect()
    assert sorted(map(tuple, out)) == [("aaa111bbb22", 1), ("ccc111bbb22", 7), ("dQw4w9WgXcQ", 0)]


@pytest.mark.parametrize("text,ref", [("@rust", "@rust"), ("https://www.youtube.com/channel/UCa/videos", "UCa"), ("https://youtube.com/c/Name", "@Name"), ("https://youtube.com/user/Me", "@Me"), ("UCabc", "UCabc"), ("SC" + "a" * 22, "UC" + "a" * 22), ("hello", None)])
def test_channel_refs(spark, text, ref):
    assert spark.range(1).select(links.channel_ref(F.lit(text))).first()[0] == ref


def test_rejects(spark):
    lines = ["https://youtu.be/aaa111bbb22", "dQw4w9WgXcB", "dQw4w9WgXcQ", "PLabc", "https://youtube.com/channel/UCa1b2c3d4e5f6g7h8i9j0kLM", "@handle"]
    out = {r["line"]: r for r in links.inputs(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert [out[x]["accepted"] for x in lines] == [True, False, True, False, False, False]
    assert "checksum" in out["dQw4w9WgXcB"]["detail"] and "playlist" in out["PLabc"]["detail"] and out["@handle"]["detail"] == out[lines[4]]["detail"]

def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x,"y"\nz'), ("b", "")], "k string, v string")
    sinks.write_csv(df, str(tmp_path / "c"), ("k", "v"))
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path / "c"), "k string, v string").fillna("").collect())) == [("a", 'x,"y"\nz'), ("b", "")]
    sinks.export({"t": df}, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "manifest")).first()["rows"] == 2


def test_streams(spark, tmp_path):
    rows = [("k", dt.datetime(2024, 1, 1, 1), 1.0), ("k", dt.datetime(2024, 1, 1, 5), 2.0), ("k", dt.datetime(2024, 1, 9), 3.0)]
    spark.createDataFrame(rows, "key string, at timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = feed.read(spark, str(tmp_path / "in"), "key string, at timestamp, value double")
    feed.into_table(feed.daily_last(src, "key", "at", "value"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert [(r["day"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(dt.date(2024, 1, 1), 2.0)]
    feed.into_table(feed.cooled_down(src, "key", "at"), str(tmp_path / "out2"), str(tmp_path / "log2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() >= 1


def test_upsert_batches(spark, tmp_path):
    schema = "id string, seq int, title string, source string"
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", 1, "a", "rss"), ("1", 2, "b", "rss"), ("7", 1, "s", "rss")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = feed.read(spark, str(tmp_path / "in"), schema)
    assert feed.current(spark, path) is None
    feed.upsert_batches(src, path, str(tmp_path / "log"), "id", ["title"]).awaitTermination()
    assert sorted((r["id"], r["title"], r["outcome"]) for r in feed.current(spark, path).collect()) == [("1", "b", "added"), ("7", "s", "added")]
    spark.createDataFrame([("1", 3, "c", "api"), ("2", 1, "n", "rss")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed.upsert_batches(src, path, str(tmp_path / "log"), "id", ["title"]).awaitTermination()
    assert sorted((r["id"], r["title"]) for r in feed.current(spark, path).collect()) == [("1", "c"), ("2", "n"), ("7", "s")]
    assert len(list((tmp_path / "t" / "batch=1").glob("part=*"))) <= 2  # the parts of two keys


def test_latest_by_day(spark, tmp_path):
    schema = "key string, at timestamp, value double"
    for rows in ([("k", dt.datetime(2024, 1, 1, 1), 1.0), ("k", dt.datetime(2024, 1, 1, 5), 2.0)], [("k", dt.datetime(2024, 1, 1, 9), 3.0), ("k", dt.datetime(2024, 1, 2), 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = feed.read(spark, str(tmp_path / "in"), schema)
        feed.latest_by_day(src, str(tmp_path / "out"), str(tmp_path / "log"), "key", "at", "value").awaitTermination()
    assert sorted(map(tuple, feed.daily(spark, str(tmp_path / "out"), "key", "value").collect())) == [("k", dt.date(2024, 1, 1), 3.0), ("k", dt.date(2024, 1, 2), 4.0)]


def test_categories(spark):
    assert feeds.categories(spark).count() == 32
    df = spark.createDataFrame([("27",), ("99",), (None,)], "category_id string")
    assert sorted(map(tuple, feeds.category_breakdown(df).collect())) == [("99", 1), ("Education", 1)]
    assert feeds.categories(spark).agg(F.count("*")).first()[0] == 32
