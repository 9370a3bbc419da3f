"""Weighted least-squares trends (inventory M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_LIFE, WEIGHTED_FROM, HORIZON = 30.0, 5, 7.0


def forecast(series: DataFrame, by: str, days: str = "days", value: str = "value", horizon: float = HORIZON) -> DataFrame:
    """M1, M2: by entity the slope, fit, t, next value, change in percent, verdict and reliability of a series (days, value).

    Two aggregations: the first finds the last day and number of points, which weigh the second. Entities with fewer than three points,
    or all at one time, have no row. From five points on, a point weighs half as much thirty days earlier. A horizon of 0 or less is the usual one.
    """
    horizon = horizon if horizon > 0 else HORIZON
    points = series.where(F.col(value).isNotNull() & F.col(days).isNotNull()).select(by, F.col(days).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    ends = points.groupBy(by).agg(F.max("t").alias("tmax"), F.count("*").alias("n")).where("n >= 3")
    w = F.when(F.col("n") >= WEIGHTED_FROM, F.exp(-F.log(F.lit(2.0)) / HALF_LIFE * (F.col("tmax") - F.col("t")))).otherwise(1.0)
    weighed = points.join(ends, by).withColumn("w", w)
    means = weighed.groupBy(by, "tmax", "n").agg((F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("tm"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("vm"))
    c = weighed.join(means.select(by, "tm", "vm"), by)
    dt, dv = F.col("t") - F.col("tm"), F.col("v") - F.col("vm")
    sums = c.groupBy(by, "tmax", "n", "tm", "vm").agg(F.sum(F.col("w") * dt * dt).alias("sxx"), F.sum(F.col("w") * dt * dv).alias("sxy"), F.sum(F.col("w") * dv * dv).alias("syy")).where("sxx >= 1e-12")
    out = sums.withColumns({"slope": F.col("sxy") / F.col("sxx"), "r2": F.when(F.col("syy") > 1e-12, F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))).otherwise(0.0)})
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    out = out.withColumn("se", F.sqrt(sse / (F.col("n") - 2) / F.col("sxx")))
    t = F.when(F.col("se") > 1e-12, F.try_divide("slope", "se")).when(F.col("slope") != 0, F.signum("slope") * 1.7976931348623157e308).otherwise(0.0)
    out = out.withColumns({"t": t, "next": F.col("vm") + F.col("slope") * (F.col("tmax") + horizon - F.col("tm")), "pct": F.when(F.col("vm") != 0, F.try_divide(F.col("slope") * horizon, F.abs("vm")) * 100).otherwise(0.0)})
    strong = F.abs("t") >= 2
    verdict = F.when(strong & (F.col("pct") > 10), "rising").when(strong & (F.col("pct") < -10), "falling").otherwise("flat")
    reliability = F.when((F.col("n") < 4) | (F.abs("t") < 1.5), "low").when((F.col("n") >= 8) & strong, "high").otherwise("medium")
    return out.select(by, "n", "slope", "r2", "t", "next", "pct", verdict.alias("verdict"), reliability.alias("reliability"))


def forecast_complete(series: DataFrame, by: str, **how) -> DataFrame:
    """M3: as forecast(), but an entity with any unknown value or day has no row."""
    whole = series.groupBy(by).agg(F.bool_or(F.col("value").isNull() | F.col("days").isNull()).alias("broken")).where("not broken").select(by)
    return forecast(series.join(whole, by, "left_semi"), by, **how)


def keyword_report(research: DataFrame, series: DataFrame, horizon: float = HORIZON) -> DataFrame:
    """M4: by keyword its points, forecast and latest research (keyword, at, opportunity_score, competition_score, volume_label), the best next opportunity first."""
    last = research.groupBy("keyword").agg(F.count("*").alias("points"), F.max_by(F.struct("opportunity_score", "competition_score", "volume_label"), "at").alias("last"))
    f = forecast(series, "keyword", horizon=horizon).select("keyword", "verdict", F.col("next").alias("next_opportunity"), "slope", "pct", "reliability", "t", "r2")
    out = last.join(f, "keyword", "left").select(
        "keyword", "points", "verdict", "next_opportunity", "slope", "pct", "reliability", "t", "r2", F.col("last.opportunity_score").alias("latest_opportunity"), F.col("last.competition_score").alias("latest_competition"), F.col("last.volume_label").alias("volume"),
    )
    return out.orderBy(F.desc(F.coalesce("next_opportunity", F.lit(0.0))), "keyword")


def channel_report(channels: DataFrame, series: DataFrame, own: str | None = None, horizon: float = HORIZON) -> DataFrame:
    """M3, M4: by channel the forecast of its views, the fastest growth first; a channel with any unknown figure has none."""
    f = forecast_complete(series, "channel_id", horizon=horizon).select("channel_id", "verdict", F.col("next").alias("next_total_views"), "slope", "pct", "reliability", F.col("n").alias("points"))
    out = channels.select("channel_id", F.col("title").alias("channel")).join(f, "channel_id", "left").withColumn("is_own", F.coalesce(F.col("channel_id") == F.lit(own), F.lit(False)))
    return out.orderBy(F.desc(F.coalesce("pct", F.lit(0.0))), "channel_id")
