"""Text expressions: tokens, words, lines, formats and drafts (inventory T1, F1-F12, F27-F33, U7). All are JVM-side columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Unicode has it, as a class for Java's patterns and for RE2's.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_STRINGS = "array<string>"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def token_list(text: str) -> list[str]:
    """T1 for a string at hand, such as a keyword."""
    return [t.lower() for t in re.split(r"[\W_]+", text) if t]


def tokens(text: Column, first: int | None = None) -> Column:
    """Lower-cased runs of letters and digits, in order; empty for null. With `first`, so many of them; the text is split no further."""
    limit = -1 if first is None else first + 2  # one empty piece may come before, and the rest is one
    all_ = F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", limit), ""), F.array().cast(NO_STRINGS))
    return all_ if first is None else F.slice(all_, 1, first)


def words(text: Column) -> Column:
    """runs between white space."""
    return F.coalesce(F.array_remove(F.split(text, f"{SPACE}+"), ""), F.array().cast(NO_STRINGS))


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.coalesce(F.array_remove(F.transform(F.split(text, r"\r?\n"), strip), ""), F.array().cast(NO_STRINGS))


def first_lines(text: Column, n: int = 2) -> Column:
    """the first lines that aren't empty, joined by a space."""
    return F.array_join(F.slice(lines(text), 1, n), " ")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """whether any of the strings is inside."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def topic_label(url: Column) -> Column:
    """the last part of a url's path with spaces for underscores; null if blank."""
    label = F.trim(F.replace(F.element_at(F.split(url, "/"), -1), F.lit("_"), F.lit(" ")))
    return F.when(label != "", label)


def canonical(name: Column) -> Column:
    """trimmed, lower-cased, hyphens for spaces."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))


def has_precise_number(text: Column) -> Column:
    """a number that looks exact: one digit but 0, two or three digits that don't end in 0, or four digits and more."""
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9][0-9,]*)")), lambda x: F.replace(x, F.lit(","), F.lit("")))
    n = lambda x: F.length(x)
    return F.exists(runs, lambda x: ((n(x) == 1) & (x != "0")) | (n(x).between(2, 3) & ~F.endswith(x, F.lit("0"))) | (n(x) >= 4))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def contains_all(have: Column, need: Column) -> Column:
    """Every element of `need` is there."""
    return F.size(F.array_except(need, have)) == 0


def string_list(json: Column) -> Column:
    """a JSON array as strings; empty if it can't be read. Numbers in it are read as strings."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def csv_field(value: Column) -> Column:
    """Quoted only where a comma, quote or line break asks for it."""
    return F.when(F.rlike(value, F.lit('[,"\n\r]')), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def xml_escaped(value: Column) -> Column:
    """F8: the five characters that markup reserves."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def human_count(n: Column) -> Column:
    """1.2M, 3k or the number itself, halves to even."""
    n = n.cast("double")
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1))).when(n >= 1000, F.concat(whole(n / 1e3), F.lit("k"))).otherwise(whole(n))


def whole(n: Column) -> Column:
    """A number without its fraction, halves to even, as text."""
    return F.bround(n.cast("double"), 0).cast("long").cast("string")


def clock(seconds: Column) -> Column:
    """minutes and seconds."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def demand_angle(verdict: Column, volume: Column) -> Column:
    """what a draft leads with, by the trend's verdict or else the volume."""
    return F.when(ascii_lower(verdict) == "rising", "rising").when(ascii_lower(verdict) == "falling", "falling").when(ascii_lower(volume) == "high", "high_demand").otherwise("explained")


# What drafted titles, descriptions and variants say.
TITLES = {"rising": "%s, Explained", "falling": "Is %s Still Worth It?", "high_demand": "What Is %s?", "comparison": "%s: A Comparison"}
TITLE_ELSE = "%s, Explained"
LEARN = "Learn %s — how it works, why it matters, and whether it's trending up or down. \n\nIn this video you'll understand %s clearly: the core idea, the problem it solves, and the trade-offs. "
VARIANTS = ("Give Me 60 Seconds on %s", "7 Things I Wish I Knew About %s", "The Secret About %s Nobody Tells You", "How to Master %s (for Beginners)")
VARIANTS_WITH_OUTCOME = ("Give Me 60 Seconds on %1$s", "The 7 %2$ss About %1$s", "The Secret About %1$s Nobody Tells You", "How to Master %1$s (for Beginners)", "How %1$s %2$s (My Exact Process)")


def bare_topic(topic: Column) -> Column:
    return F.regexp_replace(strip(topic), "[.]+$", "")


def drafted_title(topic: Column, angle: Column) -> Column:
    """a title for a topic by angle; beyond 55 characters it ends after 52 with an ellipsis."""
    t = bare_topic(topic)
    title = None
    for name, form in TITLES.items():
        title = F.when(angle == name, F.format_string(form, t)) if title is None else title.when(angle == name, F.format_string(form, t))
    title = title.otherwise(F.format_string(TITLE_ELSE, t))
    return F.when(F.char_length(title) > 55, F.concat(F.regexp_replace(F.left(title, F.lit(52)), f"{SPACE}+$", ""), F.lit("…"))).otherwise(title)


def drafted_description(topic: Column, volume: Column, opportunity: Column, competition: Column, verdict: Column, mean_views: Column, suggested: Column) -> Column:
    """what the topic is, what research says of it as far as it is known, and the leading tags."""
    said = lambda known, *parts: F.when(known.isNotNull(), F.concat(*parts)).otherwise("")
    against = F.coalesce(F.concat(F.lit(" vs competition "), whole(competition), F.lit("/100.")), F.lit("."))
    covered = F.when(F.size(suggested) > 0, F.concat(F.lit("\n\nKeywords covered: "), F.array_join(F.slice(suggested, 1, 6), ", "), F.lit("."))).otherwise("")
    return F.concat(
        F.format_string(LEARN, topic, topic), said(opportunity, F.lit("Research shows opportunity "), whole(opportunity), F.lit("/100"), against), said(verdict, F.lit(" Demand is "), verdict, F.lit(".")),
        said(mean_views, F.lit(" Ranking videos average "), human_count(mean_views), F.lit(" views.")), F.lit(" ("), F.coalesce(volume, F.lit("this topic")), F.lit(" volume)."), covered,
        F.lit("\n\n# "), F.replace(topic, F.lit(" "), F.lit("")), F.lit(" #TechExplained"),
    )


def drafted_tags(primary: Column, suggested: Column, related: Column, most: int = 12) -> Column:
    """One list without blanks and repeats of another ASCII case, first come first."""
    none = F.array().cast(NO_STRINGS)
    every = F.filter(F.transform(F.concat(F.array(primary), F.coalesce(suggested, none), F.coalesce(related, none)), strip), lambda x: x != "")
    lower = F.transform(every, ascii_lower)
    return F.slice(F.filter(every, lambda x, i: F.array_position(lower, ascii_lower(x)) == i + 1), 1, most)


def title_variants(topic: Column, outcome: Column) -> Column:
    """titles for a topic under psychological patterns; the outcome may be null. Nothing for a blank topic."""
    t = bare_topic(topic)
    plain, full = (F.array(*[F.format_string(form, t, *rest) for form in forms]) for forms, rest in ((VARIANTS, ()), (VARIANTS_WITH_OUTCOME, (outcome,))))
    return F.when(t == "", F.array().cast(NO_STRINGS)).when(F.coalesce(outcome, F.lit("")) != "", full).otherwise(plain)
