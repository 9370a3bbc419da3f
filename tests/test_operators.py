"""Operators on small tables with known results, ties and nulls."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.operators import forecast, graph, merge, search, vectors
from corpuscle.operators import relational as R
from corpuscle.plans import reports

VIDEO = "video_id string, channel_id string, title string, description string, tags array<string>, view_count long, duration_sec long, published_at timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def videos(spark, *rows):
    full = [dict(video_id=str(i), channel_id="a", title="t", description="", tags=[], view_count=1, duration_sec=100, published_at=day(i)) | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in VIDEO.split(", ")) for r in full], VIDEO)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_schemas(spark):
    assert len(schemas.DDL) == 25
    assert all(k in schemas.schema(t).names for t, keys in schemas.KEYS.items() for k in keys)


def test_totals_and_groups(spark):
    df = spark.createDataFrame([("c1", 100), ("c1", 300), ("c2", 50), (None, None)], "c string, v long")
    r = R.totals(df.where("v is not null"), "v").first()
    assert (r["sum"], r["avg"], r["min"], r["max"], r["count"]) == (450, 150, 50, 300, 3)
    assert rows(R.group_counts(df, "c"), "c", "n") == [("c1", 2), ("c2", 1)]
    empty = R.totals(df.limit(0), "v").first()
    assert (empty["sum"], empty["avg"], empty["min"], empty["count"]) == (0, 0, None, 0)


def test_filters(spark):
    v = videos(spark, {"duration_sec": None, "tags": ["Rust"]}, {"duration_sec": 30, "tags": ["rust", "db"]}, {"duration_sec": 900})
    scores = spark.createDataFrame([("0", 50.0, 40.0)], "video_id string, seo_score double, total_score double")
    assert rows(R.where_all(v, longest=60), "video_id") == [("0",), ("1",)]
    assert rows(R.where_all(v, tags=["RUST"]), "video_id") == [("0",), ("1",)]
    assert rows(R.where_all(v, scores, least_seo=10), "video_id") == [("0",)]
    assert R.title_contains(v, " ").count() == 3
    assert R.ordered(v, "newest", 2).count() == 2 and R.ordered(v, "newest").count() == 3
    assert R.page(v, [F.asc("video_id")], 2, 2).collect()[0]["video_id"] == "2"


def test_outliers(spark):
    v = videos(spark, {}, {}, {}, {"view_count": 100})
    out = reports.outlier_report(v).collect()
    assert len(out) == 1 and out[0]["mean_views"] == 25.75 and out[0]["multiple"] == 3.88


def test_topic_coverage(spark):
    v = videos(spark, {"title": "rust ownership", "view_count": 1000, "duration_sec": 60}, {"title": "ownership two", "view_count": 2000}, {"title": "ownership", "view_count": 5000, "channel_id": "b"})
    r = R.topic_coverage(v).where("topic = 'ownership'").first()
    assert (r["videos"], r["channels"], r["mean_views"], r["no_short"]) == (3, 2, 2666.67, False)
    twice = R.topic_coverage(videos(spark, {"title": "loop loop"})).collect()
    assert [(x["topic"], x["videos"]) for x in twice] == [("loop", 2)]


def test_rank_changes(spark):
    r = spark.createDataFrame([("rust", day(0), 5), ("rust", day(1), 3), ("go", day(0), 2), ("c", day(0), None), ("c", day(1), 4)], "keyword string, checked_at timestamp, position long")
    assert sorted((x["keyword"], x["delta"], x["trend"]) for x in R.rank_changes(r).collect() if x["delta"] is not None) == [("rust", -2, "rising")]
    assert R.rank_changes(r).count() == 3


def test_trending(spark):
    df = spark.createDataFrame([(str(i), "a", 1.0) for i in range(5)] + [("9", "a", 10.0)], "video_id string, channel_id string, vph double")
    assert rows(R.trending(df).where("trending"), "video_id") == [("9",)]


def test_first_of_each(spark):
    a = spark.createDataFrame([("Rust", 0), ("db", 1)], "seed string, ord long")
    b = spark.createDataFrame([("rust", 0), (" ", 1), ("Go", 2)], "seed string, ord long")
    assert rows(R.first_of_each([a, b], "seed"), "seed") == [("Go",), ("Rust",), ("db",)]


def test_close_sets(spark):
    v = videos(spark, {"title": "a b c d"}, {"title": "a b c e"}, {"title": "a b c d"}, {"title": "x y"}, {"title": ""})
    assert rows(R.similar_titles(v, 0.6), "a", "b") == [("0", "1"), ("0", "2"), ("1", "2")]
    tagged = spark.createDataFrame([("1", "x"), ("2", "x"), ("1", "y"), ("2", "y"), ("3", "y")], "video_id string, tag string")
    assert rows(R.shared_items(tagged, "tag", 2.0), "a", "b", "weight") == [("1", "2", 4.0), ("1", "3", 2.0), ("2", "3", 2.0)]
    assert rows(R.shared_items(tagged, "tag", 1.0, 2), "a", "b", "weight") == [("1", "2", 2.0)]
    assert rows(R.title_links(v, 0.6), "video_id", "class_id", "links") == [("0", "0", 2), ("1", "1", 2), ("2", "0", 2), ("3", "3", 0), ("4", "4", 0)]
    assert rows(R.item_links(tagged, "tag", 2), "video_id", "class_id", "links") == [("1", "1", 1), ("2", "1", 1), ("3", "3", 0)]


def test_title_links_compared(spark, monkeypatch):
    """Titles that share five words of eight, and so aren't close, are never compared; those that differ in a word are, once."""
    compared = spark.sparkContext.accumulator(0)

    def similarity(a, b):
        compared.add(1)
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0

    monkeypatch.setattr(R, "jaccard", F.udf(similarity, "double"))
    titles = [f"all of them share this x{i} y{i} z{i}" for i in range(200)] + ["one two three four", "one two three five", "one two three five", None]
    out = R.title_links(videos(spark, *[{"title": t} for t in titles]), 0.5)
    links = {r["video_id"]: (r["class_id"], r["links"]) for r in out.collect()}
    assert links == {str(i): (str(i), 0) for i in range(200)} | {"200": ("200", 2), "201": ("201", 2), "202": ("201", 2), "203": ("203", 0)}
    assert compared.value < 5 * len(titles)


@pytest.mark.parametrize("least", [1, 2, 3, 9])
def test_item_links_counted(spark, monkeypatch, least):
    """Links of small sets are counted without a pair, those with larger ones are found as well; all are as by brute force."""
    pick = np.random.default_rng(7)
    sets = {f"v{i:03d}": {str(x) for x in pick.choice(14, pick.integers(1, 7), replace=False)} for i in range(150)} | {f"e{i}": {"11", "1", "", ":"} for i in range(5)} | {"f": {"1", "11:"}}
    large = {f"w{i}": {str(x) for x in range(i, i + 10)} for i in range(4)} | {"w9": {str(x) for x in range(10)}}

    def links(of):
        rows_ = spark.createDataFrame([(v, t) for v, s in of.items() for t in s], "video_id string, tag string")
        return {r["video_id"]: (r["class_id"], r["links"]) for r in R.item_links(rows_, "tag", least).collect()}

    want = lambda of: {v: (min(x for x in of if of[x] == s), sum(x != v and len(of[x] & s) >= least for x in of)) for v, s in of.items()}
    assert links(sets | large) == want(sets | large)
    monkeypatch.setattr(R, "near_sets", None)
    assert links(sets) == want(sets)


def test_tags(spark):
    v = videos(spark, {"tags": ["X", "y"]}, {"tags": ["x"], "channel_id": "b"}, {"tags": ["z"], "channel_id": "b"}, {"tags": ["z"], "channel_id": "b"})
    assert [(r["tag"], r["opportunity"]) for r in R.tag_gaps(v, "a").collect()] == [("z", 2.0)]
    rivals = spark.createDataFrame([("b",)], "channel_id string")
    assert [(r["tag"], r["uses"], round(r["opportunity"], 4)) for r in R.missing_tags(v, rivals, "a").collect()] == [("z", 2, 66.6667)]  # of three uses, an own tag's among them
    assert R.missing_tags(v, rivals.limit(0), "a").count() == 0
    known = spark.createDataFrame([("x",), ("none",)], "tag string")
    assert rows(R.tag_cloud(known, R.video_tags(v)), "tag", "uses") == [("none", 0), ("x", 2)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "rust db rust"), (2, "db"), (3, ""), (4, None)], "id long, text string")
    found = {r["id"]: r["score"] for r in search.matches(docs, "id", F.col("text"), "rust").collect()}
    twice = {r["id"]: r["score"] for r in search.matches(docs, "id", F.col("text"), "rust rust").collect()}
    assert list(found) == [1] and twice[1] == pytest.approx(2 * found[1])
    many = search.matches_many(docs, "id", F.col("text"), spark.createDataFrame([(7, "rust rust")], "query_id long, query string")).collect()
    assert many[0]["score"] == pytest.approx(twice[1])
    r = {x["id"]: x["resonance"] for x in search.resonance(docs, "id", F.col("text"), "rust").collect()}
    assert r[1] == 0 and r[2] == pytest.approx(found[1])
    assert search.matches(docs, "id", F.col("text"), "").count() == 0 and search.matches(docs.limit(0), "id", F.col("text"), "rust").count() == 0
    assert search.field("body") is None and search.matches_in(videos(spark, {"tags": ["Rust"]}), "tags", "rust!").count() == 1 and search.matches_in(videos(spark, {}), "body", "t").count() == 0


def test_first_own_position(spark):
    found = spark.createDataFrame([("k", "a", "r", 3.0), ("k", "b", None, 2.5), ("k", "c", "o", 2.0), ("k", "d", "o", 2.0), ("m", "a", "r", 1.0)] + [("n", f"x{i}", "r", 9.0 - i / 9) for i in range(12)] + [("n", "z", "o", 1.0)], "keyword string, video_id string, channel_id string, score double")
    rivals = spark.createDataFrame([("r",)], "channel_id string")
    assert sorted(map(tuple, search.first_own_position(found, rivals).collect())) == [("k", "c", 3), ("n", "z", None)]


def test_topics(spark):
    v = videos(spark, {"title": "rust", "view_count": 5000}, {"title": "a rust", "view_count": 3000}, {"title": "rust!", "view_count": 8000}, {"title": "rusty", "view_count": 90000}).withColumn("seo_score", F.lit(10.0))
    assert rows(search.topic_outliers(v, "Rust", 1.5), "video_id") == [("2",)] and search.topic_outliers(v.withColumn("view_count", F.lit(0)), "rust", 1.0).count() == 0
    assert [r["video_id"] for r in search.keyword_best(v, "RUST a", 5).collect()] == ["1"]
    assert search.topic_cluster(v.withColumn("view_count", F.lit(0))).first()["blend"] == pytest.approx(7)

def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest(v, [0.0, 0.0], 3).collect()] == [1, 3, 4]
    assert vectors.nearest(v, [0.0, 0.0], 0).count() == 0
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<float>")
    assert [(r["vec_id"], r["rank"]) for r in vectors.nearest_many(v, q, 2).orderBy("rank").collect()] == [(3, 1), (1, 2)]
    assert rows(vectors.recalled(v, [1.0, 0.0]), "vec_id") == [(2,), (3,)]


def test_nearest_many_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(23)] + [(23, None)], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole, parts = (rows(vectors.nearest_many(v, q, 3, most=most), "query_id", "rank", "vec_id", "distance") for most in (100, 5))
    assert len(whole) == 69 and parts == whole


def test_neighbour_graph(spark):
    points = {i: [float(i * i), float(i % 3)] for i in range(22)} | {i: [5.0, 5.0] for i in range(30, 50)}
    v = spark.createDataFrame([*points.items(), (99, None)], "vec_id long, embedding array<float>")
    links = vectors.neighbour_graph(v, most=15)
    far = lambda i, j: sum((x - y) ** 2 for x, y in zip(points[i], points[j]))
    want = {(i, j, n + 1) for i in points for n, j in enumerate(sorted((j for j in points if j != i), key=lambda j: (far(i, j), j))[:16])}  # noqa: B023
    assert {(r["src"], r["dst"], r["rank"]) for r in links.collect()} == want
    assert [tuple(r) for r in vectors.entry_points(v, links).collect()] == [(i, 16) for i in range(4)]
    one = v.where("vec_id in (0, 99)")
    assert [tuple(r) for r in vectors.entry_points(one, vectors.neighbour_graph(one)).collect()] == [(0, 0)]


def test_neighbour_graph_rounds(spark):
    """Several scans of a few blocks each, with many equal vectors; what each sends are the equal ones with the least keys."""
    points = {i: [float(i * 7 % 5), float(i % 3)] for i in range(60)} | {100 + i: [1.0] for i in range(4)}
    v = spark.createDataFrame([*points.items(), (99, None), (98, [])], "vec_id long, embedding array<float>")
    far = lambda i, j: sum((x - y) ** 2 for x, y in zip(points[i], points[j]))
    want = {(i, j, n + 1) for i in points for n, j in enumerate(sorted((j for j in points if j != i and len(points[i]) == len(points[j])), key=lambda j: (far(i, j), j))[:3])}  # noqa: B023
    for most, blocks in ((7, 2), (20, 1), (1000, 4)):
        assert {(r["src"], r["dst"], r["rank"]) for r in vectors.neighbour_graph(v, 3, most=most, blocks=blocks).collect()} == want
    assert vectors.neighbour_graph(v.limit(0)).count() == 0
    sent = [len(keys) for keys, x in vectors.packed_blocks(v.where("vec_id < 60"), 4, 1000)]
    assert sent == [60] and [len(k) for k, _ in vectors.packed_blocks(v.where("vec_id < 60"), 2, 1000)] == [30]


@pytest.mark.parametrize("spread", [1.0, 1e-4])
def test_nearest_places(monkeypatch, spread):
    """Few pairs get their distance in double precision, also among near copies far from the origin, and all the nearest are found."""
    x = (np.random.default_rng(3).normal(0, spread, (6000, 16)) + 5).astype("f4")
    compared, merge = [], vectors.merge
    monkeypatch.setattr(vectors, "merge", lambda d, p, *finds: (compared.append(len(finds[0])), merge(d, p, *finds)))
    d, p = vectors.nearest_places(x[:600], np.arange(600), [(x[:2500], np.arange(2500)), (x[2500:], np.arange(2500, 6000))], x.astype("f8").mean(0), 5)
    assert sum(compared) < 0.02 * 600 * len(x)
    for i in range(0, 600, 37):
        far = ((x[i].astype("f8") - x.astype("f8")) ** 2).T.copy().sum(0)
        far[i] = np.inf
        near = np.lexsort((np.arange(len(x)), far))[:5]
        assert (p[i] == near).all() and (d[i] == far[near]).all()
    odd = np.array([[0, 1], [np.nan, 1], [2, 2], [np.inf, 0], [0, 1.5]], "f4")
    d, p = vectors.nearest_places(odd, np.arange(5), [(odd, np.arange(5))], np.zeros(2), 4)
    assert p[0].tolist() == [4, 2, 3, 1] and d[0, 0] == 0.25 and np.isnan(d[0, 3]) and p[1].tolist() == [0, 2, 3, 4]


def test_publishing(spark):
    dates = {"rust": [0, 90, 91], "go": [90, 91, 200, None], "many": [1] * 7, "old": [100] * 9}
    up = spark.createDataFrame([(k, None if n is None else dt.date(2024, 6, 1) - dt.timedelta(days=n)) for k, ns in dates.items() for n in ns], "keyword string, upload_date date")
    known = spark.createDataFrame([(k,) for k in [*dates, "none"]], "keyword string")
    assert rows(reports.publishing(known, up, "2024-06-01"), "keyword", "recent_uploads", "active") == [("go", 1, False), ("many", 5, True), ("none", 0, False), ("old", 0, False), ("rust", 2, True)]


@pytest.mark.parametrize("values,verdict", [([10, 12, 14, 16, 18], "rising"), ([50, 46, 42, 38, 34], "falling"), ([10, 11, 9, 10.5], "flat"), ([1, 2], None)])
def test_forecast(spark, values, verdict):
    s = spark.createDataFrame([("k", float(i), float(v)) for i, v in enumerate(values)], "k string, days double, value double")
    out = forecast.forecast(s, "k").collect()
    assert [r["verdict"] for r in out] == ([verdict] if verdict else [])
    if verdict == "rising":
        assert out[0]["next"] > 18
    assert forecast.forecast(s.withColumn("days", F.lit(1.0)), "k").count() == 0


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def nodes(spark, names):
    return spark.createDataFrame([(x,) for x in names], "id string")


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(graph, "SMALL", 0)


def test_pagerank(spark, size):
    star = edges(spark, ("b", "a"), ("c", "a"), ("d", "a"), ("a", "a"), ("x", "a"))
    r = {x["id"]: x["rank"] for x in graph.pagerank(nodes(spark, "abcd"), star, rounds=30).collect()}
    assert sum(r.values()) == pytest.approx(1, abs=1e-9) and max(r, key=r.get) == "a"
    assert graph.pagerank(nodes(spark, "a"), edges(spark, ("a", "a")), rounds=3).first()["rank"] == pytest.approx(1)


def test_paths_and_components(spark, size):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"))
    both = graph.both_ways(e)
    assert graph.shortest_path(both, "a", "d") == ["a", "b", "c", "d"]
    assert graph.shortest_path(both, "a", "a") == ["a"] and graph.shortest_path(both, "a", "y") is None
    assert rows(graph.neighbourhood(both, "a", 2), "id", "hop") == [("a", 0), ("b", 1), ("c", 2)] and rows(graph.within_hops(both, "a", 2), "id", "hop") == [("b", 1), ("c", 2)]
    assert rows(graph.components(nodes(spark, "abcdxyz"), e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    line = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert rows(graph.articulation_points(nodes(spark, "abcd"), line), "id") == [("b",), ("c",)]
    assert graph.articulation_points(nodes(spark, "abcdxy"), e).count() == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_neighbourhood_of_repeated_edges(spark, monkeypatch, few):
    """Edges that are there twice, that end nowhere or go back; all that is written are the newest nodes of a round."""
    sizes, whole = [], graph.cut
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "cut", lambda df: (sizes.append(df.count()), whole(df))[1])
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("b", None), ("c", None), ("c", "d"), ("x", "y"), (None, "z")] * 2, "src string, dst string")
    got = graph.neighbourhood(e, "a", 3).collect()
    assert {(r["id"], r["hop"]) for r in got} == {("a", 0), ("b", 1), ("c", 2), (None, 2), ("d", 3)} and len(got) == 5
    assert sizes == [1, 2, 1]


def test_long_chain(spark, size):
    names = [f"{i:03d}" for i in range(60)]
    out = graph.components(nodes(spark, names), edges(spark, *zip(names, names[1:])))
    assert {r["component"] for r in out.collect()} == {"000"}


def test_components_in_slices(spark, monkeypatch):
    """A graph that lies in several slices, by names of its own and without a list of nodes; its edges aren't kept on disk."""
    import os
    import random

    monkeypatch.setattr(graph, "SMALL", 0)
    shared = spark.conf.get("spark.checkpoint.dir")
    on_disk = lambda: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(shared) for x in names)
    draw = random.Random(5)
    pairs = [(f"o{draw.randrange(4000)}", f"p{draw.randrange(30000)}") for _ in range(9000)] + [("hub", f"h{i % 50}") for i in range(400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    e = edges(spark, *pairs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = on_disk()
        out = rows(graph.components(nodes(spark, [*root, "alone"]), e.select("dst", "src", "weight").toDF("src", "dst", "weight")), "id", "component")
        wrote = on_disk() - before
        assert out == sorted([(x, find(x)) for x in root] + [("alone", "alone")])
        assert wrote < 60 * len(pairs)
        assert rows(graph.components(None, e), "id", "component") == sorted((x, find(x)) for x in root)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_path(spark):
    names = [f"{i:03d}" for i in range(24)]
    both = graph.both_ways(edges(spark, *zip(names, names[1:]), ("x", "y")))
    assert graph.shortest_path(both, "000", "023") == names
    assert graph.shortest_path(both, "000", "x") is None


def test_walk_and_communities(spark, size):
    e = graph.both_ways(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")))
    scores = {r["id"]: r["score"] for r in graph.random_walk(e, "a", rounds=10).collect()}
    assert "a" not in scores and scores["b"] > scores["f"]
    assert graph.random_walk(e, "unknown", rounds=2).count() == 0
    groups = {r["id"]: r["community"] for r in graph.communities(nodes(spark, "abcdef"), e).collect()}
    assert groups["a"] == groups["b"] and groups["e"] == groups["f"]


def test_video_graph(spark):
    v = videos(spark, {"tags": ["X"], "title": "a b c d e f"}, {"tags": ["x", "y"], "title": "a g h i j k"}, {"tags": ["z"], "title": "a b c d q r"}, {"title": "n"}, {"title": None, "tags": ["y"]})
    got = {(r["a"], r["b"]): r["weight"] for r in graph.video_graph(v).collect()}
    assert got == pytest.approx({("0", "1"): 1 + 0.5 / 11, ("0", "2"): 0.25, ("1", "4"): 1.0})
    assert {(r["a"], r["b"]): r["weight"] for r in graph.video_graph(v, 1.02).collect()} == pytest.approx({("0", "1"): 1 + 0.5 / 11})
    topics = v.withColumn("topic_categories", F.when(F.col("video_id").isin("1", "2"), F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")))
    assert {(r["a"], r["b"]): r["weight"] for r in graph.video_graph(topics, 0.3).collect()} == pytest.approx({("0", "1"): 1 + 0.5 / 11, ("1", "2"): 2 + 0.5 / 11, ("1", "4"): 1.0})


SMALLEST = "/root/testdata/sf0.001"


def test_whole_rounds(spark):
    from corpuscle.plans import catalogue

    ids = [r["id"] for r in catalogue.nation_nodes(spark, SMALLEST).collect()]
    links = {(r["src"], r["dst"]): r["weight"] for r in catalogue.nation_edges(spark, SMALLEST).collect()}
    total = {i: sum(w for (a, b), w in links.items() if a == i != b) for i in ids}
    degree = {i: sum(a == i for a, _ in links) for i in ids}
    rank, walk = dict.fromkeys(ids, 1 / len(ids)), {"3": 1.0}
    for _ in range(50):
        lost = sum(rank[i] for i in ids if not total[i])
        rank = {i: 0.15 / len(ids) + 0.85 * (lost / len(ids) + sum(rank[a] * w / total[a] for (a, b), w in links.items() if b == i != a)) for i in ids}
        walk = {i: 0.3 * (i == "3") + sum(walk.get(a, 0) * w / 1000 / degree[a] * 0.7 for (a, b), w in links.items() if b == i) for i in ids}
    assert dict(catalogue.QUERIES["g1_pagerank"](spark, SMALLEST).collect()) == pytest.approx(rank, abs=2e-6)
    assert dict(catalogue.QUERIES["g7_random_walk"](spark, SMALLEST).collect()) == pytest.approx({i: x for i, x in walk.items() if i != "3" and x > 0}, abs=2e-9)


def test_whole_relations(spark):
    from itertools import combinations

    from corpuscle.functions.text import tokens
    from corpuscle.plans import catalogue, views

    rows_ = views.catalog(spark, SMALLEST).select("video_id", "channel_id", "tags", F.concat(tokens(F.col("title")), F.flatten(F.transform("tags", tokens))).alias("words")).collect()
    name = lambda kind, x: f"{kind}:" + x.strip().lower().replace(" ", "-")
    want = {}

    def put(a, b, kind, weight):
        want[a, b, kind] = max(weight, want.get((a, b, kind), 0))

    of, having = {}, {}
    for r in rows_:
        put(name("video", r["video_id"]), name("channel", r["channel_id"]), "created_by", 1.0)
        of.setdefault(r["channel_id"], set()).update(r["words"])
        for n, t in enumerate(r["tags"]):
            put(name("video", r["video_id"]), name("tag", t), "tagged_with", 1 / (1 + n))
            having.setdefault(t.lower(), set()).add(r["video_id"])
    for a, b in combinations(sorted(having), 2):
        if len(both := having[a] & having[b]) >= 2:
            put(name("tag", a), name("tag", b), "related_to", len(both) / len(having[a] | having[b]))
    for a in of:
        for b in of:
            if a != b and of[a] & of[b]:
                put(name("channel", a), name("channel", b), "competes_in", len(of[a] & of[b]) / len(of[a] | of[b]))
    got = {(r["src"], r["dst"], r["relation"]): r["weight"] for r in catalogue.QUERIES["g15_relations"](spark, SMALLEST).collect()}
    assert {k[2] for k in got} == {"created_by", "tagged_with", "related_to", "competes_in"}
    assert got == pytest.approx(want, abs=2e-6)


def test_knowledge_graph(spark):
    v = videos(spark, {"tags": ["Big Data", "rust"], "title": "one"}, {"tags": ["rust", "big data"], "channel_id": "b", "title": "two"})
    channels = spark.createDataFrame([("a", "A"), ("b", "B")], "channel_id string, title string")
    keywords = spark.createDataFrame([("rust lang",)], "keyword string")
    none = spark.createDataFrame([], "from_channel string, to_channel string, weight double")
    known, links, groups = graph.knowledge_graph(v, channels, keywords, none, rounds=5)
    assert "tag:big-data" in {r["id"] for r in known.collect()}
    assert {r["relation"] for r in links.collect()} == {"created_by", "tagged_with", "related_to"}
    assert groups.count() >= 1
    got = graph.tag_authority_of_videos(links, known.select("id", "centrality")).count()
    assert got == 2


def test_merges(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert rows(merge.upsert(table, new, ["k"]), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(merge.insert_absent(table, new.drop("seq"), ["k"]), "k")[-1] == (3,)
    assert rows(merge.delete(table, table.where("k = 1"), ["k"]), "k") == [(2,)]
    assert rows(merge.numbered(table, spark.createDataFrame([("x",), ("y",)], "v string"), "k", ["v"]), "k", "v") == [(3, "x"), (4, "y")]


def test_source_precedence(spark):
    s = "id string, title string, source string"
    stored = spark.createDataFrame([("1", "a", "api"), ("2", "a", "rss"), ("3", "a", "api")], s)
    incoming = spark.createDataFrame([("1", "b", "oembed"), ("2", "b", "api"), ("3", "a", "api"), ("4", "n", "rss")], s)
    out = merge.merge_by_source(stored, incoming, "id", ["title"])
    assert rows(out, "id", "title", "outcome") == [("1", "a", "skipped"), ("2", "b", "updated"), ("3", "a", "skipped"), ("4", "n", "added")]


def test_duplicates_and_placeholders(spark):
    v = videos(spark, {"view_count": 9}, {"description": "d", "view_count": 1}, {"description": "d", "view_count": 1}, {"title": "other"})
    d = merge.duplicate_videos(v)
    assert rows(d, "video_id", "winner") == [("0", "1"), ("2", "1")]
    comments = spark.createDataFrame([("0", "x"), ("3", "y")], "video_id string, text string")
    assert rows(merge.without_duplicates(comments, d, True), "video_id") == [("1",), ("3",)]
    none = spark.createDataFrame([], "channel_id string, handle string")
    batch = lambda *ids: spark.createDataFrame([(c, h, i) for i, (c, h) in enumerate(ids)], "channel_id string, handle string, seq int")
    m = merge.channel_merges(batch(("@me", "@me"), ("UC1", "@me")), none)  # a placeholder, then the real one
    assert rows(m, "placeholder", "channel_id") == [("@me", "UC1")]
    stored = spark.createDataFrame([("UC1", "@me")], "channel_id string, handle string")
    late = batch(("@me", "@me"), ("UC1", "@me"), ("UC3", "@me"), ("UC9", None))
    known = merge.channel_merges(late, stored)  # a stored real one stays, another real one gives way
    assert rows(known, "placeholder", "channel_id") == [("@me", "UC1"), ("UC3", "UC1")] and rows(merge.channel_rows(late, known, stored), "channel_id") == [("UC9",)]
    assert merge.channel_merges(batch(("UCa", "@a"), ("UCb", "@b")), none).count() == 0
    assert rows(merge.channel_merges(batch(("UC1", "@me")), spark.createDataFrame([("@me", "@me")], "channel_id string, handle string")), "placeholder", "channel_id") == [("@me", "UC1")]
    e = spark.createDataFrame([("@me", "UC1", 1.0), ("@me", "UC2", 1.0), ("UC1", "UC2", 1.0)], "from_channel string, to_channel string, weight double")
    assert rows(merge.repoint_edges(e, m), "from_channel", "to_channel") == [("UC1", "UC2")]


def test_scores(spark):
    from corpuscle.plans import scoring

    v = videos(spark, {"title": "Rust Database Guide", "description": "rust here\n- a\n- b", "tags": ["rust", "db"]}, {"title": "Rust and Go", "tags": ["go"]}, {"title": None, "description": None})
    central = spark.createDataFrame([("a", 0.5)], "channel_id string, centrality double")
    out = {r["video_id"]: r for r in scoring.score_videos(v, ["rust"], central).collect()}
    assert len(out) == 3 and all(0 <= r["total_score"] <= 100 for r in out.values())
    assert len(out["0"]["components"]) == 25 and out["0"]["components"]["title_front"] == 100 and out["0"]["components"]["keyword_triple"] == 100
    assert out["0"]["seo_score"] > out["2"]["seo_score"]
    own = {r["video_id"]: r for r in scoring.score_videos(v, []).collect()}  # each title is its own query
    assert len(own) == 3 and own["0"]["components"]["keyword_title"] > 0 and own["2"]["components"]["keyword_title"] == 0 and own["0"]["components"]["title_front"] == 100
    row = out["0"]
    mean = lambda w: sum(row["components"][k] * x for k, x in w.items()) / sum(w.values())
    seo, geo = mean(scoring.S.SEO_WEIGHTS), mean(scoring.S.GEO_WEIGHTS)
    assert row["seo_score"] == pytest.approx(seo, abs=0.006) and row["total_score"] == pytest.approx((seo + geo) / 2, abs=0.006)
    alone = {r["video_id"]: r["seo_score"] for r in scoring.metadata_score(v).collect()}
    assert alone["0"] > alone["2"]
    told = [r["component"] for r in scoring.checklist(v.where("video_id = '0'"), []).orderBy("nth").collect()]
    assert "keyword_title" in told and "tags_quality" in told
    known = spark.createDataFrame([("0",)], "video_id string")
    assert rows(scoring.backfill(v, known, ["rust"]), "video_id") == [("1",), ("2",)]
    assert scoring.detail(scoring.score_videos(v, ["rust"]), ["title_front"]).count() == 3


def test_written_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rust db rust"), (2, "db"), (3, "")], "id long, text string")
    search.write_index(docs, "id", F.col("text"), str(tmp_path / "index"))
    n, mean = search.statistics(docs, F.col("text"))
    got = {r["id"]: r["score"] for r in search.indexed_matches(spark.read.parquet(str(tmp_path / "index")), "id", n, mean, "db rust db").collect()}
    assert got == pytest.approx({r["id"]: r["score"] for r in search.matches(docs, "id", F.col("text"), "db rust db").collect()})


def test_csv_of_whole_texts(spark, tmp_path):
    from corpuscle.plans import catalogue

    texts = ["a" * 100 + ', "b"\nc', "d" * 100, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = dict(catalogue.QUERIES["k16_csv_texts"](spark, str(tmp_path)).collect())
    assert out == {0: '"' + "a" * 100 + ', ""b""\nc"', 1: "d" * 100, 2: "", 3: None}


def test_covered_topics(spark):
    topics = spark.createDataFrame([(k,) for k in ("rust ownership", "ownership in rust explained", "rust server deployment", "async database", "react state", "rust", "rust rust")], "keyword string")
    own = lambda *titles: videos(spark, *[{"title": t} for t in titles])
    assert rows(reports.covered_topics(topics, own("Rust ownership", "borrowing: lifetime async")), "keyword") == [("ownership in rust explained",), ("rust ownership",), ("rust rust",)]
    assert reports.covered_topics(topics, own()).count() == 0


def test_census(spark):
    v = spark.createDataFrame([("api", 100, None, None, None), ("rss", 100, None, None, "private"), ("oembed", 5, 2, 1, "unlisted")], "source string, view_count long, like_count long, comment_count long, privacy_status string")
    r = reports.census(v).first()
    assert (r["disabled_videos"], r["disabled_view_count"], r["disabled_like_count"], r["disabled_comment_count"], r["unlisted"], r["private"]) == (1, 0, 1, 1, 1, 1)
    assert r["engagement_complete"] == pytest.approx((100 + 100 / 3 + 100) / 3, abs=0.006) and reports.census(v.limit(0)).first()["engagement_complete"] == 0


def test_scorecard(spark):
    v = videos(spark, {"tags": ["rust db"], "view_count": 10}, {"tags": ["go"], "channel_id": "b", "title": "How to 7"}, {"channel_id": "c", "tags": ["rust"]}, *[{"channel_id": "a", "view_count": n, "tags": []} for n in (1, 2, 3, 4, 5)])
    scores = spark.createDataFrame([("0", 50.0, 1.0), ("3", 70.0, 1.0)], "video_id string, seo_score double, total_score double")
    channels = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "channel_id string, title string")
    r = {x["channel_id"]: x for x in reports.scorecard(v, scores, channels).collect()}
    assert r["a"]["views_growth"] == pytest.approx(round(12 / 13, 2)) and (r["a"]["seo_avg"], r["a"]["seo_median"], r["a"]["seo_min"], r["a"]["seo_max"], r["a"]["scored"]) == (60, 60, 0, 70, 2)
    assert (r["a"]["tag_overlap"], r["b"]["tag_overlap"], r["d"]["tag_overlap"]) == (0, 0, 0) and r["b"]["howto_ratio"] == r["b"]["digit_ratio"] == 1 and r["d"]["videos"] == 0
    two = {x["channel_id"]: x["tag_overlap"] for x in reports.scorecard(v, scores, channels.where("channel_id in ('a', 'c')")).collect()}
    assert two["a"] == two["c"] == two[None] == 0.5
    assert r[None]["total_views"] == 1 and r[None]["videos"] is None


def test_alerts(spark):
    v = videos(spark, {"title": "Rust one"})
    channels = spark.createDataFrame([("a", "A", day(0)), ("b", "B", day(20))], "channel_id string, title string, fetched_at timestamp")
    tracked, rivals = spark.createDataFrame([("rust db",), ("go",)], "keyword string"), spark.createDataFrame([("b",), ("x",)], "channel_id string")
    none = spark.createDataFrame([], "kind string, channel_id string, message string")
    out = reports.alerts(v, tracked, channels, rivals, none, day(21), quota=10_000, broken="bad")
    assert rows(out, "kind", "severity") == [("brand", "warn"), ("gap", "info"), ("gap", "info"), ("gap", "warn"), ("integrity", "critical"), ("quota", "critical")]
    assert {r["message"] for r in out.where("kind = 'gap'").collect()} == {"channel 'A' stale (fetched 2024-01-01T00:00:00Z)", "new competitor detected: B", "new competitor detected: x"}
    assert reports.alerts(v, tracked, channels, rivals, out, day(21), quota=10_000, broken="bad").count() == 0
    assert rows(reports.alerts(v.limit(0), tracked, channels, rivals.limit(0), none, day(3), quota=7_900), "kind") == []


def test_ideas(spark):
    v = videos(spark, {"title": "rust db", "view_count": 100}, {"title": "rust rust go", "channel_id": "b"}, {"title": "cooking"}, {"title": "go"}).withColumns({"like_count": F.lit(4), "comment_count": F.lit(0)})
    scores = spark.createDataFrame([("0", 80.0, 90.0), ("2", 10.0, 20.0)], "video_id string, seo_score double, total_score double")
    central = spark.createDataFrame([("a", 0.5)], "channel_id string, centrality double")
    out = {r["video_id"]: r for r in reports.ideas(v, scores, central, ["rust", "db"], "go").collect()}
    assert set(out) == {"0", "1", "2"} and [out[i]["rationale"]["keyword"] for i in "012"] == ["rust", "rust", ""]
    r = out["0"]["rationale"]  # all of two terms of three, two matches of twenty, half the centrality, an engagement of 4 %
    assert (r["idea_fit"], r["demand_matches"], r["engagement_boost"], r["competitor_gap"]) == (66.67, 2, 0.25, 6.25)
    assert out["0"]["score"] == pytest.approx(0.5 * 80 + 0.3 * 200 / 3 + 0.2 * 6.25, abs=0.006)
    from corpuscle.plans import scoring

    alone = scoring.score_rows(v.where("video_id = '1'").withColumn("kws", F.array(F.lit("rust"))), v).first()["seo_score"]
    assert out["1"]["rationale"]["seo_total"] == alone > 0 and out["2"]["rationale"]["demand_matches"] == 0
    assert reports.ideas(v, scores, central, [], None).first()["rationale"]["idea_fit"] == 50


def test_audit_and_actions(spark):
    v = videos(spark, *[{"title": f"part {i} loop", "tags": list("abcde"), "view_count": 100, "published_at": day(7 * i)} for i in range(4)], {"channel_id": "b", "view_count": 400}).withColumns({"like_count": F.lit(1), "comment_count": F.lit(1)})
    scores = spark.createDataFrame([("0", 50.0)], "video_id string, seo_score double")
    channels = spark.createDataFrame([("a", "A", 50_000), ("b", None, None)], "channel_id string, title string, subscriber_count long")
    r = {x["channel_id"]: x for x in reports.audit(v, scores, channels).collect()}
    a, b = r["a"], r["b"]
    assert (a["metadata"], a["consistency"], a["engagement"], a["tags"], a["series"], a["authority"]) == (50, 100, 100, 100, 100, 37.5)
    assert a["overall"] == pytest.approx(15 + 15 + 20 + 15 + 10 + 3.75) and a["grade"] == "B" and a["verdict"] == "A is strong. Biggest lever: authority (38/100)."
    assert (b["title"], b["consistency"], b["authority"], b["grade"]) == ("b", 50, 50, "F") and b["verdict"].startswith("b needs work — start with metadata (0/100)")
    todo = [(x["area"], x["impact"]) for x in reports.actions(reports.audit(v, scores, channels)).where("channel_id = 'a'").collect()]
    assert todo == [("metadata", "High"), ("authority", "Low")]


def test_gap_opportunities(spark):
    topics = spark.createDataFrame([("rust async", 60.0, 80_000.0, 2, True, False), ("saturated", 5.0, 10_000.0, 8, False, False), ("loop", 30.0, 1.0, 3, False, True), ("zero", 90.0, 0.0, 1, True, False), ("plain", 70.0, 5.0, 4, False, False)], "topic string, score double, mean_views double, channels long, no_short boolean, is_series boolean")
    out = {r["topic"]: r for r in reports.gap_opportunities(topics).collect()}
    assert set(out) == {"rust async", "loop", "plain"} and "Short" in out["rust async"]["action"] and out["loop"]["action"].startswith("Start a series on loop") and out["plain"]["action"] == "Cover plain with a fresh angle — only 4 channel(s) own it"
    assert (out["plain"]["prediction"], out["rust async"]["prediction"], out["loop"]["prediction"]) == ("Very High", "High", "Medium")


def test_keyword_reports(spark):
    r = spark.createDataFrame([("rust", day(i), 10.0 + 2 * i, 5.0, "High", 9, 1000.0) for i in range(5)] + [("go", day(0), 40.0, 1.0, "Low", 3, 10.0)], "keyword string, at timestamp, opportunity_score double, competition_score double, volume_label string, serp_total long, serp_mean_views double")
    out = {x["keyword"]: x for x in reports.keyword_opportunities(r).collect()}
    assert out["go"]["verdict"] == "no-history" and out["go"]["trend"] == [] and out["rust"]["verdict"] == "rising" and [p["label"] for p in out["rust"]["trend"]] == ["01-01", "01-02", "01-03", "01-04", "01-05"]
    best = reports.next_videos(r, videos(spark, {"title": "cooking"})).collect()
    assert [(x["topic"], x["verdict"], x["reliability"]) for x in best] == [("go", "no-history", "low"), ("rust", "rising", "medium")] and best[1]["title"] == "rust, Explained" and best[1]["next_opportunity"] == pytest.approx(32)
    f = forecast.keyword_report(r, reports.series(r)).collect()
    assert [x["keyword"] for x in f] == ["rust", "go"] and f[0]["next_opportunity"] == pytest.approx(32) and forecast.forecast(reports.series(r), "keyword", horizon=0).first()["next"] == pytest.approx(32)
    s = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(4)] + [("b", 0.0, 1.0), ("b", 1.0, None), ("b", 2.0, 3.0), ("b", 3.0, 3.0)], "channel_id string, days double, value double")
    c = forecast.channel_report(spark.createDataFrame([("a", "A"), ("b", "B")], "channel_id string, title string"), s, "b").collect()
    assert [(x["channel_id"], x["is_own"], x["verdict"] is None) for x in c] == [("a", False, False), ("b", True, True)]


def test_overview(spark):
    v = videos(spark, {"view_count": 5, "title": "old"}, {"view_count": 5, "title": "best"}, {"channel_id": "b", "view_count": 10}, {"channel_id": "b", "view_count": 30}, {"channel_id": "c", "view_count": 900})
    scores = spark.createDataFrame([("0", 10.0), ("2", 20.0), ("3", 40.0), ("4", 99.0)], "video_id string, total_score double")
    channels = spark.createDataFrame([("b", "B", 7)], "channel_id string, title string, subscriber_count long")
    r = reports.own_overview(v, scores, channels, spark.createDataFrame([("b",)], "channel_id string"), "a").first()
    assert (r["channel_name"], r["subscriber_count"], r["video_count"], r["total_views"], r["avg_views"], r["avg_score"], r["best_video_title"]) == ("My Channel", 0, 2, 10, 5, 10, "best")
    assert (r["competitors"], r["median_subscribers"], r["median_views"], r["median_score"]) == (1, 7, 20, 30)


def test_graph_helpers(spark):
    v = videos(spark, {"tags": ["rust"]}, {"tags": ["rust"], "channel_id": "b"})
    assert graph.content_hash(v) == graph.content_hash(v.orderBy(F.desc("video_id"))) != graph.content_hash(v.limit(1))
    n, e = nodes(spark, "ab"), edges(spark, ("a", "b"))
    first = graph.centrality_of(v, n, e)
    assert graph.centrality_of(v, n, e, first)[1] is first[1] and graph.centrality_of(v.limit(1), n, e, first)[1] is not first[1]
    links = graph.relations(v, spark.createDataFrame([], "from_channel string, to_channel string, weight double"))
    central = spark.createDataFrame([("channel:a", 0.2), ("channel:b", 0.4), ("tag:rust", 0.3)], "id string, centrality double")
    got = graph.graph_scores(v, links, central, spark.createDataFrame([("channel:a", "t", "video:0")], "channel string, topic string, video string"), ["rust"])
    assert rows(got, "video_id", "topic_dominance", "keyword_competition") == [("0", 100, 0), ("1", 0, 0)] and got.first()["tag_authority"] == pytest.approx(30)
    one = spark.createDataFrame([("a", 8.0)], "id string, score double")
    far = spark.createDataFrame([("b", 0.5), ("c", 0.1)], "id string, score double")
    depth = spark.createDataFrame([("b", 1), ("c", 3)], "id string, hop int")
    groups = spark.createDataFrame([("a", 1), ("d", 1)], "id string, community int")
    none = one.limit(0)
    assert rows(graph.fuse(one, none, far, community=groups, depths=depth), "id", "score", "depth") == [("a", 100, 0), ("b", 50, 1), ("c", 10, 3), ("d", 10, 1)]
    assert rows(graph.fuse(one, none, far, community=groups, depths=depth, mode="local"), "id") == [("a",), ("b",)]
    assert rows(graph.fuse(one, none, far, entities_=spark.createDataFrame([("b", "tag")], "id string, type string"), kind="tag"), "id") == [("b",)]


def test_logs(spark):
    seeds = spark.createDataFrame([(1, True), (2, False)], "seed_id long, active boolean")
    assert rows(R.active_seeds(seeds), "seed_id") == [(1,)]
    run = merge.research_run("rust", ["v1", "v2"], 5.0, "search", 12, day(1), spark).first()
    assert (run["video_count"], run["researched_at"]) == (2, day(1)) and R.status_count(merge.attempt("rust", "skipped", "cooldown", day(1), spark), "skipped") == 1
    history = spark.createDataFrame([("rust", day(2)), ("rust", day(5)), ("go", day(3))], "topic string, researched_at timestamp")
    assert [r["researched_at"] for r in R.topic_history(history, "rust").collect()] == [day(5), day(2)]
    research = spark.createDataFrame([("rust", day(2)), ("go", day(3)), ("rust", day(1))], "keyword string, at timestamp")
    assert [(r["keyword"], r["at"]) for r in R.research_history(research).collect()] == [("go", day(3)), ("rust", day(1)), ("rust", day(2))]
    assert merge.by_handle(spark.createDataFrame([("UCb", "@x"), ("UCa", "@x")], "channel_id string, handle string"), "@x").first()["channel_id"] == "UCa"
    assert merge.rejected_log(spark.createDataFrame([("bad", "rejected")], "line string, kind string"), "b1", day(0)).first()["status"] == "failed"
    v = spark.createDataFrame([(1, [0.0, 3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    put = vectors.put(v, spark.createDataFrame([(2, [4.0, 3.0])], v.schema))
    assert vectors.distance_to(put, 2, [4.0, 0.0]).first()["distance"] == 9 and vectors.distance_to(put, 2, [1.0]).count() == 0


def test_small_helpers(spark):
    v = videos(spark, {"tags": ["A", "b"]}, {"tags": ["a"]})
    assert rows(R.flattened(v, "tags"), "value") == [("A",), ("b",)]
    stored = spark.createDataFrame([("0", "kept", 0)], "video_id string, tag string, position long")
    assert rows(R.tags_of(v, stored), "video_id", "tag") == [("0", "kept"), ("1", "a")]
    assert R.newest(v, "published_at", "video_id").first()["video_id"] == "1"
    R.register({"small": v})
    assert spark.sql("select count(*) from small where channel_id = 'a'").first()[0] == 2
