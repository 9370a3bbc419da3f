"""Numeric, date and performance expressions (inventory F13-F26, M2, M5, M7, M16, Z9, Z10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whole


def round_to(v: Column, digits: int = 2) -> Column:
    """halves away from zero on the scaled double, so that 1.005 gives 1.0 (Spark's own round gives 1.01)."""
    k = 10.0**digits
    return F.signum(v) * F.floor(F.abs(v) * k + 0.5) / k


def clamp(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def bands(v: Column, steps: Sequence[tuple[float, float]], beyond: float) -> Column:
    """the value of the first step that v is below."""
    out = None
    for below, value in steps:
        out = F.when(v < below, float(value)) if out is None else out.when(v < below, float(value))
    return out.otherwise(float(beyond))


def grade(score: Column) -> Column:
    """letters by the whole part of a score."""
    s = F.floor(clamp(score))
    return F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 55, "C").when(s >= 40, "D").otherwise("F")


def instant(text: Column) -> Column:
    """a time in any offset as a timestamp; null if it can't be read."""
    return F.try_to_timestamp(text)


def whole_days(a: Column, b: Column) -> Column:
    """full days between two times to the microsecond, either way round."""
    return F.floor(F.abs(F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400_000_000))


def quota_day(at: Column) -> Column:
    """F16: the day of the Pacific time zone that a UTC time falls on."""
    return F.to_date(F.from_utc_timestamp(at, "America/Los_Angeles"))


def iso_seconds(duration: Column) -> Column:
    """seconds of an ISO-8601 duration of days, hours, minutes and seconds; null for years, months and anything else."""
    pattern = r"^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
    part = lambda i: F.coalesce(F.when(F.regexp_extract(duration, pattern, i) != "", F.regexp_extract(duration, pattern, i).cast("double")), F.lit(0.0))
    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(F.rlike(duration, F.lit(pattern)) & F.rlike(duration, F.lit("[0-9]")), F.floor(total + 0.5).cast("long"))


def views_per_hour(views: Column, published: Column, now: Column, guard: bool = True) -> Column:
    """by whole minutes since publishing; null in the first minute and before. Without the guard it is the plain quotient, which is
    negative before publishing and infinite (or no number) in the first minute."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(published)) / 60) / 60
    if guard:
        return F.when(hours > 0.016, views / hours)
    return F.when(hours != 0, views / hours).when(hours == 0, views * F.lit(float("inf")))


def engagement_ratio(views: Column, likes: Column, comments: Column) -> Column:
    """comments count three times a like; null without views."""
    return F.when(views > 0, (3 * F.coalesce(comments, F.lit(0)) + F.coalesce(likes, F.lit(0))) / views)


def engagement_score(ratio: Column) -> Column:
    """a ratio of 4 % is full."""
    return F.least(ratio * 100 / 4, F.lit(1.0)) * 100


def curve_mean(curve: Column) -> Column:
    return F.when(F.size(curve) > 0, F.aggregate(curve, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(curve))


def hook_strength(curve: Column) -> Column:
    """The mean of the first tenth of a curve (one point at least) in percent; null without points."""
    return curve_mean(F.slice(curve, F.lit(1), F.greatest(F.ceil(F.size(curve) * 0.1).cast("int"), F.lit(1)))) * 100


def mean_retention(curve: Column) -> Column:
    """the mean of a whole curve in percent."""
    return curve_mean(curve) * 100


def retention_score(curve: Column) -> Column:
    """the mean of a curve in percent, between 0 and 100."""
    return clamp(curve_mean(curve) * 100)


# What an action's impact weighs.
IMPACTS = {"High": 1.0, "Medium": 0.6, "Low": 0.3}


def action_priority(score: Column, impact: Column) -> Column:
    """what is left of a component's score, weighted by the impact."""
    weight = F.when(impact == "High", IMPACTS["High"]).when(impact == "Medium", IMPACTS["Medium"]).otherwise(IMPACTS["Low"])
    return weight * (1 - clamp(score) / 100)


def predicted_views(opportunity: Column, fit: Column) -> Column:
    """a tier in words."""
    return F.when((opportunity >= 70) & (fit >= 40), "Very High").when(opportunity >= 50, "High").when(opportunity >= 30, "Medium").otherwise("Low")


def competition(channels: Column, mean_views: Column, results: int = 6) -> Column:
    """M5: how crowded a search page of so many results is."""
    return (0.7 * F.least(channels / results, F.lit(1.0)) + 0.3 * F.least(mean_views / 1e6, F.lit(1.0))) * 100


def opportunity(mean_views: Column, competition_: Column) -> Column:
    """M5: demand that competition leaves."""
    return F.least(mean_views / 250_000, F.lit(1.0)) * (1 - competition_ / 100) * 100


def keyword_score(demand: Column, competition_: Column, recent: Column, fit: Column | None = None) -> Column:
    """M5: the weighted whole."""
    return (0.40 * demand + 0.35 * (1 - competition_ / 100) + 0.15 * F.when(recent, 1.0).otherwise(0.5) + 0.10 * (F.lit(0.5) if fit is None else fit)) * 100


def volume_label(mean_views: Column) -> Column:
    """M5: demand in words."""
    return F.when(mean_views >= 250_000, "High").when(mean_views >= 60_000, "Medium").when(mean_views > 0, "Low").otherwise("Unknown")


def research_verdict(keyword: Column, volume: Column, competition_: Column, mean_views: Column, channels: Column) -> Column:
    """M5: what volume and competition say of a keyword, in words."""
    low, medium, high, few, none = VERDICTS
    views, n = whole(mean_views), channels.cast("string")
    return (
        F.when((volume == "High") & (competition_ < 60), F.format_string(high, keyword, views, n)).when(volume.isin("High", "Medium") & (competition_ < 75), F.format_string(medium, keyword, views, n))
        .when(volume.isin("High", "Medium"), F.format_string(few, keyword, n)).when(volume == "Low", F.format_string(low, keyword, views)).otherwise(F.format_string(none, keyword))
    )


# Verdicts on a keyword, kinds of gaps and reasons, in words.
VERDICTS = (
    'Low demand — ranking videos for "%s" average only %s views. The topic may be too niche; check the related keywords for a higher-demand variant.',
    'Moderate opportunity — "%s" has solid demand (avg %s views per ranking video) across %s channel(s). Win with a sharper title, a better hook, and the suggested tags.',
    'Strong opportunity — "%s" is high-demand (avg %s views per ranking video) and only %s channel(s) own the SERP. A well-optimized video can take positions.',
    'Saturated — "%s" ranks strongly across %s channel(s) with high views. Pick a more specific angle or a related long-tail keyword.',
    'No demand data — the SERP for "%s" returned no view counts. Try a broader topic.',
)
GAPS = (
    "underserved — high demand, few channels own this. Strong opening.",
    "contested — solid demand across several channels. Win with a sharper angle or better hook.",
    "saturated — many channels own this with high views. Only enter with a clearly differentiated angle.",
)
REASONS = ("high demand with weak competition — a well-optimized video can win", "solid demand, winnable with a sharper angle", "moderate or saturated demand — needs a clear angle")


def supply_gap(mean_views: Column, competition_: Column) -> Column:
    """M7: demand times how weak the supply is, rounded."""
    return round_to(F.least(F.least(mean_views / 100_000, F.lit(1.0)) * (1 - competition_ / 100) * 100, F.lit(100.0)))


def gap_type(opportunity_: Column) -> Column:
    """M7: what an opportunity says of the supply."""
    return F.when(opportunity_ >= 70, GAPS[0]).when(opportunity_ >= 40, GAPS[1]).otherwise(GAPS[2])


def gap_score(mean_views: Column, channels: Column) -> Column:
    """Demand that few channels serve."""
    return round_to(F.least(mean_views / 100_000, F.lit(1.0)) * F.greatest(1 - channels / 5, F.lit(0.0)) * 100)


def trend(delta: Column) -> Column:
    """A rank that falls in number rises."""
    return F.when(delta < 0, "rising").when(delta > 0, "declining").otherwise("stable")


def why(opportunity_: Column, competition_: Column, volume: Column, matches: Column) -> Column:
    """A sentence of reasons."""
    first = F.when((opportunity_ >= 70) & (competition_ < 60), REASONS[0]).when(opportunity_ >= 50, REASONS[1]).otherwise(REASONS[2])
    now = F.when(matches > 0, F.concat(matches.cast("string"), F.lit(" ranking videos currently match")))
    return F.concat_ws("; ", first, F.concat(F.lower(volume), F.lit(" search volume")), F.concat(F.lit("competition "), whole(competition_), F.lit("/100")), now)


def free_second(at: Column, taken: Column) -> Column:
    """a time, or the first whole number of seconds after it that isn't in an array of times taken."""
    ahead = F.transform(F.sequence(F.lit(0), F.size(taken)), lambda k: F.timestamp_seconds(F.unix_timestamp(at) + k))
    return F.array_min(F.filter(ahead, lambda x: ~F.array_contains(taken, x)))


def quota_used(day: Column, used: Column, now: Column) -> Column:
    """What a ledger (day, used) says of the quota day that now falls on: nothing once the day has changed."""
    return F.when(day == F.date_format(quota_day(now), "yyyy-MM-dd"), F.coalesce(used, F.lit(0))).otherwise(F.lit(0))


def quota_check(used: Column, projected: Column, warn_at: int, limit: int = 10_000) -> Column:
    """A struct (used, projected, remaining, warn): warn if so many more calls bring the day's use to warn_at percent of the limit."""
    after = used + projected
    percent = F.when(after >= limit, 100).otherwise(F.floor(after * 100 / limit))
    return F.struct(used.alias("used"), projected.alias("projected"), F.greatest(F.lit(limit) - used, F.lit(0)).alias("remaining"), (percent >= min(warn_at, 100)).alias("warn"))
