"""Links, ids and handles in lines of input, as columns (inventory S17-S22, F9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import strip

# Characters that the last place of an id can have.
LAST_OF_VIDEO = "AEIMQUYcgkosw048"
LAST_OF_CHANNEL = "QRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
ID = r"[A-Za-z0-9_-]"
#: Groups 1 and 2 are host and path of a link.
LINK = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?/*([^?#]*)"
HANDLE = r"[\p{IsAlphabetic}\p{N}_.-]+"


def link_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files without blanks and what follows a #."""
    return spark.read.text(path).select(strip(F.substring_index("value", "#", 1)).alias("line")).where("line <> ''")


def valid_video_id(id_: Column) -> Column:
    """Eleven characters, the last of which can only be one of sixteen."""
    return F.rlike(id_, F.lit(rf"^.{{10}}[{LAST_OF_VIDEO}]$"))


def valid_channel_id(id_: Column) -> Column:
    """22 characters, with or without UC before them, the last from the upper three quarters of the alphabet."""
    return F.rlike(id_, F.lit(rf"^(?:UC)?.{{21}}[{LAST_OF_CHANNEL}]$"))


def channel_of_shorts(id_: Column) -> Column:
    """A channel's id from one of 24 characters that begins with SC."""
    return F.when(F.startswith(id_, F.lit("SC")) & (F.char_length(id_) == 24), F.concat(F.lit("UC"), F.substring(id_, 3, 100))).otherwise(id_)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def host(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, LINK, 1))


def path(line: Column) -> Column:
    return F.rtrim(F.ltrim(F.regexp_extract(line, LINK, 2), F.lit("/")), F.lit("/"))


def ours(line: Column) -> Column:
    """Links of the video site or its short links."""
    return F.endswith(host(line), F.lit("youtube.com")) | (host(line) == "youtu.be")


#: Paths before a video's id.
VIDEO_PATHS = ("shorts", "embed", "v", "video", "watch", "live")


def video_id(line: Column) -> Column:
    """The video id of a line: by path, query or short link, else after a mark in free text, else the line itself if it is a valid id."""
    p = path(line)
    in_link = F.coalesce(found(p, rf"^(?:{'|'.join(VIDEO_PATHS)})/*({ID}{{11}})"), query_value(line, "v"), F.when(host(line) == "youtu.be", found(p, rf"^({ID}{{11}})")))
    marked = F.coalesce(*[found(line, rf"^(?:(?!{m}).)*{m}({ID}{{11}})") for m in ("v=", "/v/", "/embed/", "/video/", "/shorts/", r"youtu\.be/")])
    bare = F.when(F.rlike(line, F.lit(rf"^{ID}{{11}}$")) & valid_video_id(line), line)
    return F.coalesce(F.when(ours(line), in_link), marked, bare)


def item(line: Column) -> Column:
    """A struct (kind, ref) of what a line of input names: video_url, video_id, playlist, channel_url, channel_id, handle or custom; null for links to elsewhere.

    What nothing else fits is a channel id, to be rejected by its checksum.
    """
    p, in_list = path(line), query_value(line, "list")
    part = lambda name: found(p, rf"^{name}/([^/]+)")
    as_ = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"))
    of_list = (p == "playlist") | in_list.isNotNull()
    links_ = F.when(of_list, F.when(in_list.isNotNull(), as_("playlist", in_list)))
    for name, kind in (("channel", "channel_url"), ("show", "channel_id"), ("c", "custom"), ("user", "custom")):
        links_ = links_.when(F.startswith(p, F.lit(f"{name}/")), F.when(part(name).isNotNull(), as_(kind, channel_of_shorts(part(name)) if name == "show" else part(name))))
    links_ = links_.when(F.startswith(p, F.lit("@")), as_("handle", F.substring_index(p, "/", 1)))
    by_path = F.coalesce(*[part(name) for name in VIDEO_PATHS])
    links_ = links_.when(by_path.isNotNull(), as_("video_url", by_path)).when(query_value(line, "v").isNotNull(), as_("video_url", query_value(line, "v")))
    links_ = links_.when(host(line) == "youtu.be", as_("video_url", F.substring_index(p, "/", 1))).otherwise(as_("channel_id", line))
    channel = channel_of_shorts(line)
    bare = (
        F.when(F.startswith(line, F.lit("@")) & (F.char_length(line) > 1), as_("handle", line)).when(F.rlike(line, F.lit("^(?:PL|UU).")), as_("playlist", line))
        .when(F.rlike(channel, F.lit("^(?:UC|CL)")) & (F.char_length(channel) == 24), as_("channel_id", channel)).when(F.rlike(line, F.lit(rf"^{ID}{{11}}$")), as_("video_id", line)).otherwise(as_("channel_id", line))
    )
    return F.when(F.rlike(line, F.lit(LINK)), F.when(ours(line), links_)).otherwise(bare)


def channel_ref(text: Column) -> Column:
    """The channel id or handle that a text refers to; null if none."""
    p = path(text)
    part = lambda name: found(p, rf"^{name}/([^/]+)")
    at = lambda name: F.concat(F.lit("@"), part(name))
    in_link = F.when(F.rlike(text, F.lit(LINK)), F.coalesce(part("channel"), at("c"), channel_of_shorts(part("show")), at("user"), found(p, rf"^(@{HANDLE})(?:/|$)")))
    channel = channel_of_shorts(text)
    return F.coalesce(found(text, rf"^(@{HANDLE})$"), in_link, F.when(F.rlike(channel, F.lit("^(?:UC|CL|UU)")), channel))


# Why a line isn't taken in as a video.
REJECTED = {"video_id": "invalid id (checksum)", "channel_id": "invalid channel id (checksum)", "playlist": "playlist expansion not supported — ingest the channel instead", "channel": "use `ingest channels`"}


def inputs(lines: DataFrame) -> DataFrame:
    """(line, kind, ref, accepted, detail) of input lines: videos are accepted, all else gets the reason why not.

    Bare ids whose last character can't be one, and links to elsewhere, are of the kind "rejected".
    """
    out = lines.select("line", item(F.col("line")).alias("i")).select("line", F.col("i.kind").alias("was"), F.col("i.ref").alias("ref"))
    was, ref = F.col("was"), F.col("ref")
    valid = F.coalesce(F.when(was == "video_id", valid_video_id(ref)).when(was == "channel_id", valid_channel_id(ref)).otherwise(was.isNotNull()), F.lit(False))
    accepted = valid & was.isin("video_url", "video_id")
    detail = F.when(~valid & was.isin("video_id"), REJECTED["video_id"]).when(~valid & was.isin("channel_id"), REJECTED["channel_id"]).when(was == "playlist", REJECTED["playlist"]).when(valid & ~accepted, REJECTED["channel"])
    return out.select("line", F.when(valid, was).otherwise("rejected").alias("kind"), F.when(valid, ref).alias("ref"), F.coalesce(accepted, F.lit(False)).alias("accepted"), detail.alias("detail"))


def distinct_video_ids(lines: DataFrame) -> DataFrame:
    """Each id with the first line number it is on; lines: (n, line). What follows a # doesn't count."""
    text = strip(F.substring_index("line", "#", 1))
    return lines.select("n", video_id(text).alias("video_id")).where("video_id is not null").groupBy("video_id").agg(F.min("n").alias("n"))


def query_value(url: Column, name: str) -> Column:
    """a decoded value of a url's query; null if it isn't there or empty."""
    return F.nullif(F.url_decode(F.regexp_replace(found(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)"), r"%(?![0-9A-Fa-f]{2})", "%25")), F.lit(""))
