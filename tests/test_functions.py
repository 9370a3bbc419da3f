"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import numbers as N
from corpuscle.functions import scoring as S
from corpuscle.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def near(a, b):
    return a == pytest.approx(b, abs=1e-6)


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Über-fáCile"))) == ["über", "fácile"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    for text in ("-a b, c d", "a b c", "a b-", "--", "", "a-b c d e", None):
        every = one(spark, T.tokens(F.lit(text).cast("string")))
        assert one(spark, T.tokens(F.lit(text).cast("string"), 3)) == every[:3]
    assert one(spark, T.first_lines(F.lit(" a \n\n b\r\nc"))) == "a b"


def test_text_formats(spark):
    assert one(spark, T.csv_field(F.lit('a,"b"'))) == '"a,""b"""'
    assert one(spark, T.topic_label(F.lit("https://x/wiki/Rust_lang"))) == "Rust lang"
    assert one(spark, T.canonical(F.lit(" Big Data "))) == "big-data"
    assert one(spark, T.string_list(F.lit("oops"))) == []
    assert one(spark, T.string_list(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, T.human_count(F.lit(1_200_000))) == "1.2M"
    assert one(spark, T.clock(F.lit(125))) == "2:05"
    assert one(spark, T.drafted_tags(F.lit(" Rust "), F.array(F.lit("rust"), F.lit(" db "), F.lit(" ")), F.lit(None).cast("array<string>"))) == ["Rust", "db"]
    assert [one(spark, T.human_count(F.lit(n))) for n in (999, 14_640, 2500, 3500)] == ["999", "15k", "2k", "4k"]  # halves to even


def test_drafts(spark):
    title = lambda topic, angle: one(spark, T.drafted_title(F.lit(topic), F.lit(angle)))
    assert title(" jwt vs paseto. ", "rising") == "jwt vs paseto, Explained" and title("jwt", "falling") == "Is jwt Still Worth It?" and title("jwt", "high_demand") == "What Is jwt?" and title("jwt", "explained") == "jwt, Explained"
    assert title("x" * 80, "rising") == "x" * 52 + "…" and title("x" * 51 + " yyyyy", "rising") == "x" * 51 + "…"
    angle = lambda v, w: one(spark, T.demand_angle(F.lit(v).cast("string"), F.lit(w).cast("string")))
    assert [angle("Rising", "x"), angle("falling", "High"), angle("flat", "HIGH"), angle(None, None)] == ["rising", "falling", "high_demand", "explained"]
    told = one(spark, T.drafted_description(F.lit("jwt use"), F.lit("High"), F.lit(30.6), F.lit(69.4), F.lit("rising"), F.lit(14_640.0), F.array(*[F.lit(str(i)) for i in range(8)])))
    assert "Research shows opportunity 31/100 vs competition 69/100. Demand is rising. Ranking videos average 15k views. (High volume)." in told
    assert told.endswith("Keywords covered: 0, 1, 2, 3, 4, 5.\n\n# jwtuse #TechExplained")
    none = F.lit(None)
    assert "(this topic volume)." in one(spark, T.drafted_description(F.lit("a"), none.cast("string"), none.cast("double"), none.cast("double"), none.cast("string"), none.cast("double"), F.array().cast("array<string>")))
    variants = lambda topic, outcome: one(spark, T.title_variants(F.lit(topic), F.lit(outcome).cast("string")))
    assert len(variants("Rust.", "the truth")) == 5 and variants("Rust.", "the truth")[1] == "The 7 the truths About Rust" and len(variants("Rust", None)) == 4 and variants(" . ", "x") == []


def test_gaps_and_quota(spark):
    assert near(one(spark, N.supply_gap(F.lit(50_000.0), F.lit(40.0))), 30)
    assert one(spark, N.gap_type(F.lit(70.0))).startswith("underserved") and one(spark, N.gap_type(F.lit(40.0))).startswith("contested") and one(spark, N.gap_type(F.lit(39.9))).startswith("saturated")
    assert one(spark, N.why(F.lit(70.0), F.lit(59.6), F.lit("High"), F.lit(3))) == "high demand with weak competition — a well-optimized video can win; high search volume; competition 60/100; 3 ranking videos currently match"
    assert one(spark, N.why(F.lit(50.0), F.lit(80.0), F.lit("Low"), F.lit(0))) == "solid demand, winnable with a sharper angle; low search volume; competition 80/100"
    assert one(spark, N.research_verdict(F.lit("rust"), F.lit("High"), F.lit(59.0), F.lit(300_000.4), F.lit(2))).startswith('Strong opportunity — "rust" is high-demand (avg 300000 views')
    assert near(one(spark, N.action_priority(F.lit(20.0), F.lit("Medium"))), 0.48)
    check = one(spark, N.quota_check(F.lit(7990), F.lit(10), 80))
    assert (check["remaining"], check["warn"]) == (2010, True) and not one(spark, N.quota_check(F.lit(0), F.lit(10), 80))["warn"] and one(spark, N.quota_check(F.lit(12_000), F.lit(1), 100))["remaining"] == 0
    noon = F.lit(dt.datetime(2024, 1, 2, 3))  # the evening before, in the quota's time zone
    assert one(spark, N.quota_used(F.lit("2024-01-01"), F.lit(5), noon)) == 5 and one(spark, N.quota_used(F.lit("2024-01-02"), F.lit(5), noon)) == 0
    at = lambda s: F.lit(dt.datetime(2024, 1, 1, 0, 0, s))
    assert one(spark, N.free_second(at(1), F.array(at(1), at(2), at(4)))) == dt.datetime(2024, 1, 1, 0, 0, 3)

@pytest.mark.parametrize("text,precise", [("7 tips", True), ("0 tips", False), ("10 tips", False), ("47 tips", True), ("1,000 tips", True), ("none", False)])
def test_precise_number(spark, text, precise):
    assert one(spark, T.has_precise_number(F.lit(text))) is precise


@pytest.mark.parametrize("v,r", [(1.005, 1.0), (2.675, 2.68), (0.125, 0.13)])
def test_round_to(spark, v, r):
    assert near(one(spark, N.round_to(F.lit(v))), r)


@pytest.mark.parametrize("text,seconds", [("PT12M34S", 754), ("PT8M5S", 485), ("PT1H2M3S", 3723), ("P1DT2H", 93600), ("P1M", None), ("junk", None)])
def test_iso_seconds(spark, text, seconds):
    assert one(spark, N.iso_seconds(F.lit(text))) == seconds


@pytest.mark.parametrize("mean,channels,score", [(50_000.0, 5, 0), (50_000.0, 1, 40), (200_000.0, 1, 80)])
def test_gap_score(spark, mean, channels, score):
    assert near(one(spark, N.gap_score(F.lit(mean), F.lit(channels))), score)


def test_whole_days(spark):
    at = lambda *x: F.lit(dt.datetime(2024, 1, *x))
    half = at(8, 23, 59, 59, 500_000)
    assert one(spark, N.whole_days(half, at(9))) == 0 and one(spark, N.whole_days(at(9), half)) == 0
    assert one(spark, N.whole_days(half, at(10))) == 1 and one(spark, N.whole_days(at(9, 23, 59, 59), at(9))) == 0
    assert one(spark, N.whole_days(half, at(9, 23, 59, 59, 400_000))) == 0  # a tenth of a second less than a day
    assert one(spark, N.whole_days(half, at(9, 23, 59, 59, 500_000))) == 1 and one(spark, N.whole_days(at(12), at(10))) == 2


def test_views_per_hour_before_publishing(spark):
    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
    assert one(spark, N.views_per_hour(F.lit(100), at(10), at(0))) is None and one(spark, N.views_per_hour(F.lit(100), at(1), at(1))) is None
    plain = lambda n, a, b: one(spark, N.views_per_hour(F.lit(n), a, b, guard=False))
    assert near(plain(100, at(0), at(10)), 10) and near(plain(100, at(10), at(0)), -10)
    assert plain(100, at(1), at(1)) == float("inf") and str(plain(0, at(1), at(1))) == "nan"
    assert plain(100, F.lit(None).cast("timestamp"), at(1)) is None


def late_documents(spark, folder):
    """Documents around the hour that the queries take for now, and a vector for some."""
    rows = [(i, f"text {i}", "en", f"src{i % 3}", (i * 37) % 500 + (i != 12409)) for i in (*range(40), *range(12400, 12420), *range(20000, 20010))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [0.5] * 8) for i in (0, 12408, 20000)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["a35_trending", "f22_views_per_hour", "z9_signals"])
def test_queries_after_now(spark, tmp_path, name):
    """The rates of documents published later than now are those of the query's SQL."""
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    folder = late_documents(spark, tmp_path)
    df = __spark_entry__.queries()[name](spark, folder)
    with duckdb.connect() as con:
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_performance(spark):
    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
    assert near(one(spark, N.views_per_hour(F.lit(100), at(0), at(10))), 10)
    assert one(spark, N.views_per_hour(F.lit(100), F.lit(None).cast("timestamp"), at(10))) is None
    assert near(one(spark, N.engagement_ratio(F.lit(100), F.lit(1), F.lit(1))), 0.04)
    assert near(one(spark, N.engagement_score(F.lit(0.04))), 100)
    assert one(spark, N.engagement_ratio(F.lit(0), F.lit(1), F.lit(1))) is None
    curve = F.array(*[F.lit(x) for x in [0.9, 0.7] + [0.5] * 9])
    assert near(one(spark, N.hook_strength(curve)), 80) and near(one(spark, N.mean_retention(curve)), 100 * 6.1 / 11)


@pytest.mark.parametrize("best,score", [(0.0, 0), (0.5, 12.5), (2.0, 50), (4.0, 100), (8.0, 100)])
def test_keyword_resonance(spark, best, score):
    assert near(one(spark, S.keyword_resonance(F.lit(best))), score)


@pytest.mark.parametrize("n,score", [(9, 30), (10, 60), (39, 89), (40, 100), (60, 100), (80, 70), (120, 40), (300, 40)])
def test_title_length(spark, n, score):
    assert near(one(spark, S.title_length(F.lit("x" * n))), score)


def component(spark, name, title="", description="", tags=(), keywords=(), sets=()):
    """A component by the columns that the plan prepares."""
    row = spark.range(1).select(F.lit(title).alias("title"), F.lit(description).alias("description"), S.strings(list(tags)).alias("tags"))
    row = row.withColumns(S.prepared(F.col("title"), F.col("description"), F.col("tags")))
    kw = S.strings(list(keywords))
    parts = S.structural(F.col("title"), F.col("description"), F.col("tags"), kw, F.array(*[S.strings(list(x)) for x in sets]).cast("array<array<string>>"))
    parts |= S.generative(F.col("description"), F.col("tags"), kw, S.strings([]), F.lit(False), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    return row.select(parts[name].alias("x")).first()["x"]


@pytest.mark.parametrize("position,score", [(1, 100), (5, 70), (6, 70), (11, 40), (0, 0)])
def test_title_front(spark, position, score):
    words = [f"w{i}" for i in range(1, 15)]
    if position:
        words[position - 1] = "rust"
    assert near(component(spark, "title_front", " ".join(words), keywords=["rust"]), score)


@pytest.mark.parametrize("title,score", [("5 Best Ways To Win", 50), ("The [Ultimate] 100x Guide", 75), ("10 Ultimate [Tips] How to Win", 100)])
def test_title_hooks(spark, title, score):
    assert near(one(spark, S.title_hooks(F.lit(title))), score)


def test_tags(spark):
    title = "Rust Database Guide"
    assert near(component(spark, "tags_relevance", title, tags=["database", "rust"]), 200 / 3)
    quality = lambda tags: component(spark, "tags_quality", title, tags=tags)
    assert near(quality(["rust", "database", "x", "y"]), 65)
    assert near(quality(["rust", "database"] + [f"t{i}" for i in range(13)]), 100)
    assert near(quality(["rust"]), 40)
    assert near(quality(["a1", "b1", "c1", "d1"]), 15)
    assert near(quality([]), 0)


def test_descriptions(spark):
    assert near(component(spark, "desc_first2lines", description="\n one \n\n two\nrust", keywords=["rust"]), 60) and near(component(spark, "desc_first2lines", description="a\n Rust!", keywords=["rust"]), 100)
    assert near(component(spark, "desc_first150", description="x" * 150 + " rust", keywords=["rust"]), 60) and component(spark, "title_40_chars", "rust") == 0
    assert [component(spark, "desc_length", description="w " * n) for n in (0, 50, 100, 150, 200)] == [40, 60, 75, 90, 100]
    assert near(component(spark, "desc_structure", description="\t- a\n#b\nStep 1"), 100) and near(component(spark, "desc_structure", description="one"), 0)
    assert near(component(spark, "hashtag_count", description="#a1 #b1 #c1 # x"), 100) and near(component(spark, "hashtag_count", description="#a #b #c #d #e #f #g #h #i"), 40)
    triple = lambda **k: component(spark, "keyword_triple", sets=[["rust", "db"], []], **k)
    assert triple(title="db rust", description="rust db", tags=["Rust", "db x"]) == 100 and triple(title="rust db") == 30 and triple(title="rust") == 0


def test_generative(spark):
    assert near(component(spark, "qa_phrasing", title="Why?", description="Why?\nBecause.\nHow? "), 100) and near(component(spark, "qa_phrasing", title="Why?", description="x"), 0)
    assert near(component(spark, "entity_coverage", title="who", description="What, HOW"), 40)
    assert near(component(spark, "list_phrasing", description="- a\n- b\n1 c\nstep two"), 100) and near(component(spark, "list_phrasing", description="* a\n 2nd"), 50)
    assert near(component(spark, "conversational", keywords=["x"]), 20) and near(component(spark, "conversational", description="x x you your", keywords=["x"]), 80)
    assert near(component(spark, "metadata_complete", description="\u00a0", tags=["a"]), 35) and near(component(spark, "metadata_complete", description="at 1:00", tags=["a"]), 100)
    null = F.lit(None)
    assert one(spark, S.has_location(F.lit(" "), F.lit(1.0), null.cast("double"))) is False and one(spark, S.has_location(null.cast("string"), F.lit(1.0), F.lit(2.0))) is True and one(spark, S.has_location(F.lit("x"), null.cast("double"), null.cast("double"))) is True
    assert near(one(spark, S.location_signal(F.lit(True), F.lit(dt.datetime(2024, 1, 3)), F.lit(dt.datetime(2024, 1, 1)))), 100)
    assert near(one(spark, S.engagement_completeness(null, F.lit(1), null, F.lit("rss"))), 100 / 3)
    assert near(one(spark, S.psychology_score(F.lit("How to earn 47 million in 60 seconds"))), 90) and near(one(spark, S.psychology_score(F.lit("The 7 Brutal Truths About Marketing"))), 30)


def test_totals(spark):
    parts = {k: F.lit(100.0) for k in S.SEO_WEIGHTS}
    assert near(one(spark, S.weighted(parts, S.SEO_WEIGHTS)), 100)
    assert near(one(spark, S.total_score(F.lit(33.335), F.lit(66.664))), 50.0) and near(one(spark, S.total_score(F.lit(10.0), F.lit(40.0), 2.0, 1.0)), 20)
    with pytest.raises(ValueError):
        S.weighted(parts, {"title_front": -1.0})


def test_recommendations(spark):
    seo = {k: F.lit(100.0) for k in S.SEO_WEIGHTS}
    told = lambda **c: one(spark, S.recommendations(seo | {k: F.lit(v) for k, v in c.items()}, S.strings(["w"] * 9), S.strings(["t"] * 7), S.strings(["rust"])))
    assert told() == []
    rows = told(title_length=60.0, title_40_chars=0.0, desc_length=40.0, title_front=0.0)
    assert [r["component"] for r in rows] == ["title_40_chars", "desc_length", "title_length"] and rows[1]["message"].startswith("Description is 9 words")
    rows = one(spark, S.recommendations(seo | {"tags_quality": F.lit(0.0)}, S.strings([]), S.strings([]), S.strings([])))
    assert [(r["component"], r["current"]) for r in rows] == [("tags_quality", 0), ("keyword_title", 100)] and rows[0]["message"].startswith("No tags")
    rows = one(spark, S.recommendations(seo, S.strings([]), S.strings(["t"] * 31), S.strings(["k"])))
    assert [r["message"].split(" — ")[0] for r in rows] == ["31 tags"]
