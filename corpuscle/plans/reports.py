"""The composite reports of the engine (inventory R1-R20, M8-M15). Each takes tables and returns a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.numbers import (
    action_priority, bands, clamp, competition, engagement_ratio, engagement_score, gap_type, grade, hook_strength, mean_retention, opportunity, predicted_views, research_verdict, retention_score, round_to, supply_gap, views_per_hour, volume_label, why,
)
from corpuscle.functions.scoring import engagement_completeness
from corpuscle.functions.text import contains_any, demand_angle, drafted_description, drafted_tags, drafted_title, jaccard, token_list, tokens, topic_label, whole
from corpuscle.operators.forecast import HORIZON, forecast
from corpuscle.operators.relational import (
    SERIES_MARKERS, channel_means, elapsed_days, ordered, outliers, title_topics, token_overlap, trending, upload_cadence, views_growth, where_all, within, without,
)
from corpuscle.operators.search import demand as demand_share
from corpuscle.operators.search import first_own_position, index_fresh, matches, matches_many
from corpuscle.operators.shared import written
from corpuscle.plans.scoring import score_rows
from corpuscle.sources.feeds import categories


def outlier_report(videos: DataFrame) -> DataFrame:
    """R4, A12, A13."""
    return outliers(videos, channel_means(videos))


def tag_overlap(tagged: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_id, tag_overlap): the median of the similarities of a channel's tag tokens with those of every other channel, where either has any.

    Only pairs with a common token are compared; the others' zeros are counted and weigh as many in the median.
    """
    words = tagged.select("channel_id", F.explode(F.flatten(F.transform("tags", tokens))).alias("token")).distinct()
    words = words.join(channels.select("channel_id"), "channel_id", "left_semi")
    pairs = token_overlap(words, "channel_id", "token")
    each = pairs.select(F.col("a").alias("channel_id"), "similarity").union(pairs.select("b", "similarity")).withColumn("times", F.lit(1).cast("long"))
    have = words.groupBy("channel_id").agg(F.lit(True).alias("has"))
    counts = channels.select("channel_id").join(have, "channel_id", "left").join(each.groupBy("channel_id").agg(F.count("*").alias("met")), "channel_id", "left")
    sizes = channels.select("channel_id").join(have, "channel_id", "left").agg(F.count("*").alias("channels"), F.count("has").alias("with_tags"))
    zeros = F.when(F.col("has"), F.col("channels") - 1).otherwise(F.col("with_tags")) - F.coalesce("met", F.lit(0))
    padded = each.union(counts.join(F.broadcast(sizes)).select("channel_id", F.lit(0.0), zeros.alias("times")).where("times > 0"))  # one row
    return padded.groupBy("channel_id").agg(F.percentile("similarity", 0.5, F.col("times")).alias("tag_overlap"))


CARD = ("total_views", "views_growth", "avg_title_len", "tag_overlap", "centrality", "seo_avg")


def scorecard(videos: DataFrame, scores: DataFrame, channels: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """Figures of each of the channels (channel_id, title) to be compared, and those of the median channel as a row without a channel.

    seo_min is never above 0 and seo_max never below. Categories are counted by name.
    """
    v = F.coalesce("view_count", F.lit(0))
    share = lambda c: F.avg(c.cast("double"))
    own = videos.join(channels.select("channel_id"), "channel_id", "left_semi")
    base = own.groupBy("channel_id").agg(
        F.count("*").alias("videos"), F.sum(v).alias("total_views"), F.avg(F.char_length("title")).alias("avg_title_len"), share(F.rlike("title", F.lit("[0-9]"))).alias("digit_ratio"),
        share(F.contains(F.lower("title"), F.lit("how to"))).alias("howto_ratio"),
    )
    names = F.broadcast(categories(videos.sparkSession))  # 32 rows
    own = own if "category_id" in own.columns else own.withColumn("category_id", F.lit(None).cast("string"))
    kinds = own.where("category_id is not null").join(names, "category_id", "left").groupBy("channel_id", F.coalesce("category", "category_id").alias("category")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("channel_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    scored = own.select("video_id", "channel_id").join(scores, "video_id").groupBy("channel_id").agg(
        F.avg("seo_score").alias("seo_avg"), F.percentile("seo_score", 0.5).alias("seo_median"), F.least(F.min("seo_score"), F.lit(0.0)).alias("seo_min"), F.greatest(F.max("seo_score"), F.lit(0.0)).alias("seo_max"), F.count("*").alias("scored"),
    )
    out = channels.select("channel_id", "title")
    for part in (base, kinds, views_growth(own).withColumnRenamed("growth", "views_growth"), scored, tag_overlap(own, channels)):
        out = out.join(part, "channel_id", "left")
    out = out.join(centrality, "channel_id", "left") if centrality is not None else out.withColumn("centrality", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    two, four = ("avg_title_len", "digit_ratio", "howto_ratio", "seo_avg", "seo_median", "seo_min", "seo_max"), ("tag_overlap", "centrality")
    rows = out.select(
        "channel_id", "title", *[zero(c).cast("long").alias(c) for c in ("videos", "total_views", "scored")], round_to(F.coalesce("views_growth", F.lit(1.0))).alias("views_growth"),
        *[round_to(zero(c).cast("double")).alias(c) for c in two], *[round_to(zero(c).cast("double"), 4).alias(c) for c in four], "categories",
    )
    rows = written(rows, "scorecard")  # read twice
    middle = lambda c, d: round_to(F.coalesce(F.percentile(c, 0.5), F.lit(0.0)), d)
    median = rows.agg(middle("total_views", 0).cast("long").alias("total_views"), *[middle(c, 4 if c in four else 2).alias(c) for c in CARD[1:]])
    return rows.unionByName(median, allowMissingColumns=True)


def census(videos: DataFrame) -> DataFrame:
    """One row of counts over trusted sources' unknown figures (switched off), privacy, and the mean completeness of figures."""
    trusted = F.col("source").isin("api", "oembed")
    off = {c: F.col(c).isNull() & trusted for c in ("view_count", "like_count", "comment_count")}
    known = engagement_completeness(F.col("view_count"), F.col("like_count"), F.col("comment_count"), F.col("source"))
    status = F.col("privacy_status") if "privacy_status" in videos.columns else F.lit(None).cast("string")
    return videos.agg(
        F.count_if(off["view_count"] | off["like_count"] | off["comment_count"]).alias("disabled_videos"), *[F.count_if(x).alias(f"disabled_{c}") for c, x in off.items()],
        F.count_if(status == "unlisted").alias("unlisted"), F.count_if(status == "private").alias("private"), F.coalesce(round_to(F.avg(known)), F.lit(0.0)).alias("engagement_complete"),
    )


def stale_channels(channels: DataFrame, now, days: int = 14) -> DataFrame:
    """Channels that were last fetched more than so many days ago."""
    return channels.where(F.col("fetched_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).select("channel_id", "title", "fetched_at")


def health(tables: dict[str, DataFrame], videos: DataFrame, channels: DataFrame, ingest_log: DataFrame, now, reindexed=None, quota: int = 0, stale_days: int = 14) -> DataFrame:
    """R2: (name, value) of the tables' rows, the census of figures, stale channels, quota and whether the index is fresh; the last ingest is newest(log, "at", "log_id")."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").cast("double").alias("value")).select(F.lit(f"rows_{name}").alias("name"), "value")
        out = row if out is None else out.union(row)
    counted = census(videos)
    row = lambda name, df: df.select(F.lit(name).alias("name"), "value")
    out = out.union(counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in counted.columns]), F.array(*[F.col(c).cast("double") for c in counted.columns]))).alias("name", "value")))
    out = out.union(row("stale_channels", stale_channels(channels, now, stale_days).agg(F.count("*").cast("double").alias("value"))))
    last = ingest_log.agg(F.max("at").alias("at")).join(videos.agg(F.count("*").alias("n")))  # one row each
    out = out.union(row("index_fresh", last.select(index_fresh(F.lit(reindexed).cast("timestamp"), F.col("at"), F.col("n")).cast("double").alias("value"))))
    spark = videos.sparkSession
    return out.union(spark.createDataFrame([("quota_used", float(quota)), ("quota_limit", float(QUOTA))], "name string, value double"))


QUOTA = 10_000
# What alerts say.
ALERTS = {
    "exhausted": "YouTube API daily quota exhausted (%d/%d)", "nearing": "YouTube API daily quota nearing limit (%d%%)", "integrity": "integrity_check failed: %s",
    "brand": "brand keyword '%s' absent from competitor top titles", "stale": "channel '%s' stale (fetched %s)", "competitor": "new competitor detected: %s",
}


def alerts(videos: DataFrame, keywords: DataFrame, channels: DataFrame, competitors: DataFrame, existing: DataFrame, now, quota: int = 0, warn_at: int = 80, broken: str | None = None, stale_days: int = 14) -> DataFrame:
    """(kind, channel_id, message, severity) of the rules that fire, each once and without those that were raised before.

    Quota used up or nearing its limit, a failed integrity check (broken: what it says), a tracked keyword that matches no title (if there are any
    videos), channels not fetched for some days, and competitors.
    """
    spark = videos.sparkSession
    text = lambda name, *parts: F.format_string(ALERTS[name], *parts)
    fixed = []
    if quota >= QUOTA:
        fixed.append(("quota", None, ALERTS["exhausted"] % (quota, QUOTA), "critical"))
    elif quota * 100 // QUOTA >= min(warn_at, 100):
        fixed.append(("quota", None, ALERTS["nearing"] % (quota * 100 // QUOTA), "warn"))
    if broken:
        fixed.append(("integrity", None, ALERTS["integrity"] % broken, "critical"))
    out = spark.createDataFrame(fixed, "kind string, channel_id string, message string, severity string")
    none = F.lit(None).cast("string")
    known = videos.select(F.explode(tokens(F.col("title"))).alias("token")).distinct()
    met = keywords.select("keyword", F.explode(tokens(F.col("keyword"))).alias("token")).join(known, "token").select("keyword").distinct()
    if not videos.isEmpty():
        out = out.union(keywords.select("keyword").distinct().join(met, "keyword", "left_anti").select(F.lit("brand"), none, text("brand", F.col("keyword")), F.lit("warn")))
    fetched = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = out.union(stale_channels(channels, now, stale_days).select(F.lit("gap"), "channel_id", text("stale", F.col("title"), fetched), F.lit("warn")))
    labels = competitors.select("channel_id").join(channels.select("channel_id", "title"), "channel_id", "left")
    out = out.union(labels.select(F.lit("gap"), "channel_id", text("competitor", F.coalesce("title", "channel_id")), F.lit("info")))
    raised = existing.select(F.col("kind").alias("k"), F.col("channel_id").alias("c"), F.col("message").alias("m"))
    return out.dropDuplicates(["kind", "channel_id", "message"]).join(raised, (F.col("kind") == F.col("k")) & F.col("channel_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left_anti")


def own_overview(videos: DataFrame, scores: DataFrame, channels: DataFrame, competitors: DataFrame, own: str) -> DataFrame:
    """One row with the own channel's figures and the medians over the competitors' subscribers, videos' views and videos' scores.

    The growth series is growth_series(), the tags to take up are relational.missing_tags().
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    mine = videos.where(F.col("channel_id") == own)
    figures = mine.agg(
        F.count("*").alias("video_count"), zero(F.sum("view_count")).alias("total_views"), F.coalesce(F.max_by("title", F.struct(zero(F.col("view_count")), F.col("video_id"))), F.lit("—")).alias("best_video_title"),
    ).withColumn("avg_views", F.coalesce(F.try_divide("total_views", "video_count"), F.lit(0.0)))
    score = mine.select("video_id").join(scores, "video_id").agg(F.coalesce(F.avg("total_score"), F.lit(0.0)).alias("avg_score"))
    channel = channels.where(F.col("channel_id") == own).agg(F.coalesce(F.max("title"), F.lit("My Channel")).alias("channel_name"), zero(F.max("subscriber_count")).alias("subscriber_count"))
    middle = lambda c: F.coalesce(F.percentile(c, 0.5), F.lit(0.0))
    theirs = within(videos, competitors, "channel_id")
    medians = [
        within(channels, competitors, "channel_id").agg(F.count("*").alias("competitors"), middle("subscriber_count").alias("median_subscribers")), theirs.agg(middle("view_count").alias("median_views")),
        theirs.select("video_id").join(scores, "video_id").agg(middle("total_score").alias("median_score")),
    ]
    out = channel
    for part in (figures, score, *medians):
        out = out.join(F.broadcast(part))  # one row each
    return out


def growth_series(snapshots: DataFrame, own: str) -> DataFrame:
    """(label, value) of a channel's views by day, in order."""
    return snapshots.where(F.col("channel_id") == own).orderBy("at").select(F.date_format("at", "yyyy-MM-dd").alias("label"), F.coalesce("total_views", F.lit(0)).cast("double").alias("value"))


def series(research: DataFrame) -> DataFrame:
    """(keyword, days, value) of keyword research."""
    return elapsed_days(research, "keyword", "at").select("keyword", "days", F.col("opportunity_score").alias("value"))


RESEARCH = ("opportunity_score", "competition_score", "volume_label")


def keyword_opportunities(research: DataFrame, horizon: float = HORIZON, limit: int = 25) -> DataFrame:
    """Keywords by their latest opportunity, with competition, volume, the forecast's verdict and the series of opportunities (label, value) it rests on."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("at", "opportunity_score"))), lambda x: F.struct(F.date_format(x["at"], "MM-dd").alias("label"), x["opportunity_score"].alias("value")))
    last = research.groupBy("keyword").agg(F.max_by(F.struct(*RESEARCH), "at").alias("last"), points.alias("points"))  # the history of one keyword
    out = last.join(forecast(series(research), "keyword", horizon=horizon).select("keyword", "verdict"), "keyword", "left")
    trend = F.when(F.col("verdict").isNotNull(), F.col("points")).otherwise(F.slice("points", 1, 0))
    out = out.select("keyword", F.col("last.opportunity_score").alias("opportunity"), F.col("last.competition_score").alias("competition"), F.col("last.volume_label").alias("volume"), F.coalesce("verdict", F.lit("no-history")).alias("verdict"), trend.alias("trend"))
    return out.orderBy(F.desc("opportunity"), "keyword").limit(limit)


def covered_topics(topics: DataFrame, own_videos: DataFrame, column: str = "keyword") -> DataFrame:
    """Topics of which two tokens or more (a repeated one counts again) are among those of all own titles together."""
    own = own_videos.select(F.explode(tokens(F.col("title"))).alias("token")).distinct()
    each = topics.select(column).distinct().select(column, F.explode(tokens(F.col(column))).alias("token"))
    return each.join(own, "token").groupBy(column).agg(F.count("*").alias("hits")).where("hits >= 2").select(column)


def next_videos(research: DataFrame, own_videos: DataFrame, horizon: float = HORIZON, limit: int = 5) -> DataFrame:
    """Researched keywords that the own titles don't cover, by the forecast's next opportunity, else the latest, each with a draft and reasons."""
    fields = [*RESEARCH, "serp_total", "serp_mean_views", "suggested_tags", "related_keywords"]
    kinds = {"serp_total": "long", "suggested_tags": "array<string>", "related_keywords": "array<string>"}
    have = [F.col(c) if c in research.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in fields]
    last = research.groupBy("keyword").agg(F.max_by(F.struct(*have), "at").alias("l")).select("keyword", "l.*")
    out = without(last, covered_topics(last, own_videos), "keyword").join(forecast(series(research), "keyword", horizon=horizon).select("keyword", "next", "verdict", "reliability"), "keyword", "left")
    out = out.withColumn("next_opportunity", F.coalesce("next", "opportunity_score", F.lit(0.0))).orderBy(F.desc("next_opportunity"), "keyword").limit(limit)
    verdict, topic = F.coalesce("verdict", F.lit("no-history")), F.col("keyword")
    opp, comp, volume = (F.col(c) for c in RESEARCH)
    return out.select(
        topic.alias("topic"), verdict.alias("verdict"), "next_opportunity", "opportunity_score", "competition_score", "volume_label", drafted_title(topic, demand_angle(verdict, volume)).alias("title"),
        drafted_description(topic, volume, opp, comp, verdict, F.col("serp_mean_views"), F.coalesce("suggested_tags", F.array().cast("array<string>"))).alias("description"),
        drafted_tags(topic, F.col("suggested_tags"), F.col("related_keywords")).alias("tags"), F.coalesce("reliability", F.lit("low")).alias("reliability"), predicted_views(opp, opp).alias("prediction"),
        why(opp, comp, volume, F.coalesce("serp_total", F.lit(0))).alias("why"),
    )


def best_keyword(videos: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """M9: for each title the keyword that shares most tokens with it, the first of several; none if none shares any."""
    toks = F.array_distinct(tokens(F.col("title")))
    shared = F.array(*[F.struct(F.size(F.array_intersect(F.array(*[F.lit(t) for t in token_list(k)]).cast("array<string>"), toks)).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("keyword")) for i, k in enumerate(keywords)]) if keywords else None
    best = F.array_max(shared) if keywords else None
    return videos.select("video_id", (F.when(best["n"] > 0, best["keyword"]) if keywords else F.lit(None).cast("string")).alias("keyword"))


def ideas(videos: DataFrame, scores: DataFrame, centrality: DataFrame, keywords: Sequence[str], niche: str | None = None, top: int = 10, neighbourhood: int = 5, leading: int = 10) -> DataFrame:
    """Candidate titles ranked by half their search score, three tenths how they fit keywords and niche, two tenths the gap around them.

    Candidates are the best title matches of each tracked keyword, and the best scores, whose keyword is the one that fits their title best;
    a video counts once, for the first keyword it came with. Those without a score are scored on the spot for their keyword. Ties go by
    the order in which they came. The rationale holds the parts. What is ranked is bounded by the list of keywords.
    """
    spark = videos.sparkSession
    asked = spark.createDataFrame([(str(i), k) for i, k in enumerate(keywords)], "query_id string, query string")
    found = written(matches_many(videos, "video_id", F.col("title"), asked), "matches")
    demand = found.groupBy("query_id").agg(F.count("*").alias("demand_matches")).join(asked, "query_id").select(F.col("query").alias("keyword"), "demand_matches").dropDuplicates(["keyword"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id"))
    near = found.withColumn("nth", nth).where(F.col("nth") <= neighbourhood).join(asked, "query_id").select("video_id", F.col("query").alias("keyword"), F.col("query_id").cast("int").alias("source"), "nth")
    top_scores = scores.orderBy(F.desc("total_score"), "video_id").limit(leading).join(videos.select("video_id", "title"), "video_id")
    order = F.row_number().over(Window.orderBy(F.desc("total_score"), "video_id"))  # a row for each of `leading`
    ranked = top_scores.select("video_id", order.alias("nth"))
    more = best_keyword(top_scores, keywords).join(ranked, "video_id").select("video_id", F.coalesce("keyword", F.lit("")).alias("keyword"), F.lit(len(keywords)).alias("source"), "nth")
    first = near.union(more).groupBy("video_id").agg(F.min(F.struct("source", "nth", "keyword")).alias("c")).select("video_id", F.col("c.keyword").alias("keyword"), F.col("c.source").alias("_source"), F.col("c.nth").alias("_nth"))
    candidates = written(videos.join(F.broadcast(first), "video_id"), "candidates")  # bounded by the list of keywords
    unscored = without(candidates, scores, "video_id").withColumn("kws", F.array("keyword"))
    fresh = score_rows(unscored, videos).select("video_id", F.col("seo_score").alias("fresh"))
    terms = sorted({t for k in [*keywords, niche or ""] for t in token_list(k)})
    fit = jaccard(F.array_distinct(tokens(F.col("title"))), F.array(*[F.lit(t) for t in terms])) * 100 if terms else F.lit(50.0)
    out = candidates.join(scores.select("video_id", "seo_score"), "video_id", "left").join(fresh, "video_id", "left").join(centrality, "channel_id", "left").join(demand, "keyword", "left")
    out = out.withColumns({"seo_total": F.coalesce("seo_score", "fresh"), "centrality": F.coalesce("centrality", F.lit(0.0)), "demand_matches": F.coalesce("demand_matches", F.lit(0)), "idea_fit": fit})
    ratio = engagement_ratio(F.col("view_count"), F.col("like_count"), F.col("comment_count"))
    out = out.withColumn("engagement_boost", F.coalesce(clamp(ratio * 100 / 4, 0.0, 1.0) * 0.25, F.lit(0.0)))
    out = out.withColumn("competitor_gap", (1 - F.col("centrality")) * 100 * demand_share(F.col("demand_matches")) * (1 + F.col("engagement_boost")))
    score = round_to(0.5 * F.col("seo_total") + 0.3 * F.col("idea_fit") + 0.2 * F.col("competitor_gap"))
    parts = [round_to(F.col(c), d).alias(c) for c, d in (("seo_total", 2), ("idea_fit", 2), ("competitor_gap", 2), ("engagement_boost", 4), ("centrality", 4))]
    ranked = out.select("video_id", "title", score.alias("score"), F.struct(*parts, "demand_matches", "keyword", F.col("channel_id").alias("source_channel")).alias("rationale"), "_source", "_nth")
    return ranked.orderBy(F.desc("score"), "_source", "_nth").limit(top).select("video_id", "title", "score", "rationale")


def keyword_check(videos: DataFrame, competitors: DataFrame, keywords: Sequence[str], at) -> DataFrame:
    """A snapshot (keyword, checked_at, video_id, position, topics) for each tracked keyword: the best match of a channel that is no competitor."""
    asked = videos.sparkSession.createDataFrame([(k, k) for k in dict.fromkeys(keywords)], "query_id string, query string")
    found = written(matches_many(videos, "video_id", F.col("title"), asked), "matches").withColumnRenamed("query_id", "keyword").join(videos.select("video_id", "channel_id"), "video_id")
    own = first_own_position(found, competitors)
    urls = F.col("topic_categories") if "topic_categories" in videos.columns else F.array().cast("array<string>")
    labels = videos.select("video_id", F.array_compact(F.transform(F.coalesce(urls, F.array().cast("array<string>")), topic_label)).alias("topics"))
    out = asked.select(F.col("query").alias("keyword")).join(own, "keyword", "left").join(labels, "video_id", "left")
    return out.select("keyword", F.lit(at).cast("timestamp").alias("checked_at"), "video_id", F.col("position").cast("long").alias("position"), "topics")


def keyword_trends(rankings: DataFrame) -> DataFrame:
    """By keyword the latest and the previous position, their difference, and all snapshots in order."""
    shots = F.array_sort(F.collect_list(F.struct("checked_at", "video_id", "position", "topics")))  # the history of one keyword
    out = rankings.groupBy("keyword").agg(shots.alias("snapshots"))
    last, before = F.element_at("snapshots", -1)["position"], F.get("snapshots", F.size("snapshots") - 2)["position"]
    return out.select("keyword", last.alias("latest_position"), before.alias("previous_position"), (last - before).alias("delta"), "snapshots")


def keyword_inspection(results: DataFrame, by: str = "keyword", asked: int = 6) -> DataFrame:
    """Channels, views, competition, opportunity and verdict of each keyword's search results, of which so many were asked for."""
    found = results.groupBy(by).agg(F.count_distinct(F.nullif("channel_id", F.lit(""))).alias("channels"), F.sum(F.coalesce("view_count", F.lit(0))).alias("total_views"), F.coalesce(F.avg("view_count"), F.lit(0.0)).alias("mean_views"), F.count("*").alias("results"))
    comp = competition(F.col("channels"), F.col("mean_views"), asked)
    out = found.withColumns({"competition": comp, "opportunity": opportunity(F.col("mean_views"), comp), "volume": volume_label(F.col("mean_views"))})
    verdict = research_verdict(F.col(by), F.col("volume"), F.col("competition"), F.col("mean_views"), F.col("channels"))
    return out.withColumns({"verdict": verdict, "why": why(F.col("opportunity"), F.col("competition"), F.col("volume"), F.col("results")), "gap": supply_gap(F.col("mean_views"), F.col("competition")), "gap_type": gap_type(F.col("opportunity"))})


def related_tags(results: DataFrame, limit: int = 20) -> DataFrame:
    """Tags of search results by uses; those over 60 bytes go."""
    tag = F.lower(F.trim("raw"))
    return results.select(F.explode("tags").alias("raw")).select(tag.alias("tag")).where((F.col("tag") != "") & (F.octet_length("tag") <= 60)).groupBy("tag").agg(F.count("*").alias("usage")).orderBy(F.desc("usage"), "tag").limit(limit)


def hybrid(videos: DataFrame, key: str, text: Column, query: str, walk: DataFrame | None = None, weight: float = 0.3) -> DataFrame:
    """(key, score) that blends a search's score with a walk's; where only one is above 0, it counts alone."""
    found = matches(videos, key, text, query).select(key, F.col("score").alias("b"))
    if walk is None:
        return found.select(key, F.col("b").alias("score"))
    weight = min(max(weight, 0.0), 1.0)
    both = found.join(walk.select(F.col("id").alias(key), F.col("score").alias("g")), key, "full_outer").select(key, F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("g", F.lit(0.0)).alias("g"))
    return both.select(key, F.when(F.col("b") <= 0, F.col("g")).when(F.col("g") <= 0, F.col("b")).otherwise((1 - weight) * F.col("b") + weight * F.col("g")).alias("score"))


def video_query(videos: DataFrame, scores: DataFrame, query: str | None = None, walk: DataFrame | None = None, weight: float = 0.3, mode: str = "relevance", limit: int | None = None, **filters) -> DataFrame:
    """Videos that pass the filters (see where_all), with relevance and scores, in one of the orders."""
    out = where_all(videos, scores, **filters).drop("seo_score", "total_score").join(scores.select("video_id", "seo_score", "total_score"), "video_id", "left")
    blend = hybrid(videos, "video_id", F.col("title"), query or "", walk, weight).withColumnRenamed("score", "relevance")
    out = out.join(blend, "video_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    return ordered(out.select("video_id", "title", "channel_id", "relevance", "view_count", "published_at", "seo_score", "total_score"), mode, limit)


def signals(videos: DataFrame, heatmaps: DataFrame, now, guard: bool = True) -> DataFrame:
    """By video views per hour (with or without the guard), engagement and retention; heatmaps: (video_id, points) with a value each."""
    curve = heatmaps.select("video_id", F.transform("points", lambda p: p["value"]).alias("curve"))
    ratio = engagement_ratio(F.col("view_count"), F.col("like_count"), F.col("comment_count"))
    out = videos.join(curve, "video_id", "left").withColumns({"vph": views_per_hour(F.col("view_count"), F.col("published_at"), F.lit(now).cast("timestamp"), guard), "engagement_ratio": ratio, "engagement_score": engagement_score(ratio)})
    return trending(out).select("video_id", "vph", "trending", "engagement_ratio", "engagement_score", hook_strength(F.col("curve")).alias("hook_retention"), mean_retention(F.col("curve")).alias("mean_retention"), retention_score(F.col("curve")).alias("retention_score"))


def due_topics(candidates: DataFrame, history: DataFrame, now, hours: int = 24) -> DataFrame:
    """Topics that haven't been looked into for so many whole hours."""
    last = history.groupBy("topic").agg(F.max("researched_at").alias("last"))
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 3600)
    return candidates.join(last, "topic", "left").where(F.col("last").isNull() | (age >= hours)).select(*candidates.columns)


def publishing(keywords: DataFrame, uploads: DataFrame, now, days: int = 90, least: int = 2, newest: int = 5) -> DataFrame:
    """M6: keywords with whether so many of their newest uploads (keyword, upload_date) are at most so many days old, and how many are.

    The recent ones come first among the newest, so that it is enough to count them, up to `newest`.
    """
    recent = F.datediff(F.lit(now).cast("date"), F.col("upload_date")) <= days
    found = uploads.where(recent).groupBy("keyword").agg(F.least(F.count("*"), F.lit(newest)).alias("recent_uploads"))
    n = F.coalesce("recent_uploads", F.lit(0))
    return keywords.join(found, "keyword", "left").select(*keywords.columns, n.alias("recent_uploads"), (n >= least).alias("active"))


def run_statistics(log: DataFrame) -> DataFrame:
    """Attempts, topics, and those that were skipped or succeeded."""
    by = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return log.agg(F.count("*").alias("attempts"), F.count_distinct("topic").alias("topics"), by("skipped").alias("skipped"), by("success").alias("succeeded"))


# Weights and words of a channel's audit.
AUDIT = {"metadata": 0.30, "consistency": 0.15, "engagement": 0.20, "tags": 0.15, "series": 0.10, "authority": 0.10}
VERDICTS = {
    "A": "%s is a well-optimized channel — keep the cadence and metadata discipline.", "B": "%s is strong. Biggest lever: %s (%s/100).", "C": "%s is average. Focus on %s (%s/100) to move the needle.",
    "else": "%s needs work — start with %s (%s/100), then consistency and tags.",
}


def audit(videos: DataFrame, scores: DataFrame, channels: DataFrame) -> DataFrame:
    """Six components of each channel (channel_id, title, subscriber_count) with videos, rounded one by one, their weighted sum, a grade and a verdict."""
    base = videos.where("channel_id is not null").groupBy("channel_id").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(F.size("tags"), F.lit(0))).alias("mean_tags"), F.coalesce(F.avg("view_count"), F.lit(0.0)).alias("views"), F.count("published_at").alias("dated"),
        F.avg(engagement_ratio(F.col("view_count"), F.col("like_count"), F.col("comment_count")) * 100).alias("ratio"),
    )
    seo = videos.select("video_id", "channel_id").join(scores, "video_id").groupBy("channel_id").agg(F.avg("seo_score").alias("seo"))
    marked = title_topics(videos).withColumn("marked", contains_any(F.lower("title"), SERIES_MARKERS).cast("int"))
    topics = marked.groupBy("channel_id", "topic").agg(F.count("*").alias("n"), F.sum("marked").alias("marked")).where("n > 1 and marked >= 2")  # series of the channel's own titles
    in_series = topics.groupBy("channel_id").agg(F.sum("n").alias("series"))
    most = videos.agg(F.max("view_count").alias("most"))
    out = base.join(seo, "channel_id", "left").join(upload_cadence(videos), "channel_id", "left").join(in_series, "channel_id", "left").join(F.broadcast(most))  # one row
    out = out.join(channels.select("channel_id", "title", "subscriber_count"), "channel_id", "left")
    steady = clamp(clamp(100 - 80 * F.col("cv")) + F.when(F.col("mean_gap").between(4, 10), 10.0).otherwise(0.0))
    parts = {
        "metadata": F.coalesce("seo", F.lit(0.0)),
        "consistency": F.when(F.col("dated") < 2, 50.0).otherwise(F.coalesce(steady, F.lit(0.0))),
        "engagement": F.least(F.coalesce("ratio", F.lit(0.0)) / 4, F.lit(1.0)) * 100,
        "tags": F.when(F.floor("mean_tags").between(5, 30), 100.0).when(F.col("mean_tags") >= 1, 60.0).otherwise(0.0),
        "series": F.least(F.coalesce("series", F.lit(0)) / F.col("n") / 0.40, F.lit(1.0)) * 100,
        "authority": (0.5 * F.least(F.coalesce("subscriber_count", F.lit(0)) / 100_000, F.lit(1.0)) + 0.5 * F.least(F.coalesce(F.try_divide("views", "most"), F.lit(0.0)), F.lit(1.0))) * 100,
    }
    out = out.select("channel_id", F.coalesce("title", "channel_id").alias("title"), *[round_to(c).alias(k) for k, c in parts.items()])
    out = out.withColumn("_total", clamp(sum((F.col(k) * w for k, w in AUDIT.items()), F.lit(0.0)))).withColumn("grade", grade(F.col("_total")))
    weakest = F.array_min(F.array(*[F.struct(F.col(k).alias("score"), F.lit(i).alias("nth"), F.lit(k).alias("name")) for i, k in enumerate(AUDIT)]))
    say = lambda name: F.format_string(VERDICTS[name], F.col("title"), weakest["name"], whole(weakest["score"]))
    verdict = F.when(F.col("grade") == "A", F.format_string(VERDICTS["A"], F.col("title"))).when(F.col("grade") == "B", say("B")).when(F.col("grade") == "C", say("C")).otherwise(say("else"))
    return out.select("channel_id", "title", *AUDIT, round_to(F.col("_total")).alias("overall"), "grade", verdict.alias("verdict"))


# What to do about a weak component: its impact, the action and the reason.
ACTIONS = {
    "metadata": ("High", "Rewrite video titles to 20-60 chars with the keyword up front; add 300+ char descriptions", "metadata score %s/100 — weak titles/descriptions hurt CTR and ranking"),
    "consistency": ("High", "Publish on a fixed cadence (data: weekly beats sporadic 5x; 12+/mo grows subs 66% faster)", "consistency %s/100 — irregular upload gaps hurt the algorithm"),
    "engagement": ("High", "Improve hooks/retention (hold 50% in first 30s) and ask for comments (comments weigh 3x likes)", "engagement %s/100 — low comments×3+likes vs views"),
    "tags": ("Medium", "Use 5-30 relevant tags per video (5 min / 15-30 optimal)", "tag usage %s/100 — too few or poorly-diversified tags"),
    "series": ("Medium", "Structure content as a series/playlist to boost session time", "series strength %s/100 — few episodic videos"),
    "authority": ("Low", "Cross-promote and build watch time to grow authority (subs + views vs competitors)", "authority %s/100 — channel scale is a lagging factor"),
}
#: Angles on a topic that few serve.
ANGLES = ("Make a Short version — this topic has no Short in the corpus yet", "Start a series on %s — episodic content boosts session time", "Cover %s with a fresh angle — only %s channel(s) own it")


def actions(audited: DataFrame, below: float = 70.0) -> DataFrame:
    """What to do about weak components of audited channels, the most pressing first, ties in the components' order."""
    each = [F.struct(F.lit(k).alias("area"), F.lit(what).alias("what"), F.format_string(reason, whole(F.col(k))).alias("why"), F.lit(impact).alias("impact"), F.col(k).alias("score"), F.lit(i).alias("nth")) for i, (k, (impact, what, reason)) in enumerate(ACTIONS.items())]
    out = audited.select("channel_id", F.explode(F.array(*each)).alias("x")).select("channel_id", "x.*").where(F.col("score") < below)
    return out.withColumn("priority", action_priority(F.col("score"), F.col("impact"))).orderBy("channel_id", F.desc("priority"), "nth").drop("nth")


def gap_opportunities(coverage: DataFrame, limit: int | None = None) -> DataFrame:
    """Topics worth a video, the best score first, with an angle and how many views it may bring."""
    short, serial, fresh = ANGLES
    angle = F.when(F.col("no_short"), short).when(F.col("is_series"), F.format_string(serial, F.col("topic"))).otherwise(F.format_string(fresh, F.col("topic"), F.col("channels").cast("string")))
    out = coverage.where("score >= 30 and mean_views > 0").orderBy(F.desc("score"), "topic")
    out = out.select("topic", "score", F.col("mean_views").alias("demand_views"), F.col("channels").alias("channels_covering"), angle.alias("action"), predicted_views(F.col("score"), F.lit(50.0)).alias("prediction"))
    return out if limit is None else out.limit(limit)


def title_band(title: Column) -> Column:
    """short, fitting or long."""
    return bands(F.char_length(title), ((40, 0), (61, 1)), 2)


def own_first(rows: DataFrame, own: str) -> DataFrame:
    """The own channel before all others, then by score."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("channel_id") == own), F.desc("overall"), "channel_id")))  # a row for each channel
