"""Sharding, licence digests and host reputation: known results, ties, nulls, repeats, empty tables, clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import licences, shards, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOC)


def test_shards(spark):
    texts = ["é" * (i * 7 % 50) for i in range(100)] + [None, "", "x" * 5000, "dup", "dup"]
    out = sorted(shards.shard(docs(spark, *texts), 8).collect(), key=lambda r: r["doc_id"])
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in out] == sizes
    assert [r["text_crc32"] for r in out] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [r["before"] for r in out] == [sum(sizes[:i]) for i in range(len(sizes))]
    assert [r["shard"] for r in out] == sorted(r["shard"] for r in out)
    for s in {r["shard"] for r in out}:
        assert [r["slot"] for r in out if r["shard"] == s] == list(range(sum(r["shard"] == s for r in out)))


def test_long_texts(spark):
    long = "word " * 400_000
    out = {r["doc_id"]: r for r in shards.shard(docs(spark, long, "x" * 300_000, "a").withColumns({c: F.lit("clash") for c in ("size", "shard", "_part", "before")}), 2).collect()}
    assert out[0]["size"] == 2_000_001 and out[1]["text_crc32"] == zlib.crc32(b"x" * 300_000)
    found = {r["doc_id"]: r["notices"] for r in licences.scan(docs(spark, long + "\nReleased under the MIT License.\n" + long, "x" * 300_000)).collect()}
    assert found == {0: ["MIT"], 1: []}


def test_shards_balance(spark):
    out = shards.shard(docs(spark, *["word " * (1 + i % 9) for i in range(800)]), 8)
    got = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 8 and max(got) - min(got) <= 2 * 46


def test_shards_repeats_and_nulls(spark):
    out = shards.shard(docs(spark, "a", "a", "a", None, "b", ids=[7, 7, 7, None, None]), 2).collect()
    assert sorted(r["before"] for r in out) == [0, 1, 3, 5, 7] and len(out) == 5
    assert shards.shard(docs(spark, "a").limit(0)).count() == 0
    with pytest.raises(ValueError):
        shards.shard(docs(spark, "a"), 0)


def test_licence_forms(spark):
    texts = ["LICENSED under the Apache Licence, version 2.0", "Copyright (c) 2020 Me\n  Released under the MIT License!\n", "prose\n* Licensed under CC BY-NC 4.0. *\nmore", "All rights reserved.", None, "", "Licensed under nothing"]
    out = sorted(licences.scan(docs(spark, *texts)).collect(), key=lambda r: r["doc_id"])
    assert [r["license"] for r in out] == ["Apache-2.0", "MIT", None, None, None, None, None]
    assert [r["notices"] for r in out] == [["Apache-2.0"], ["MIT"], ["CC-BY-NC-4.0"], [], [], [], []]
    assert [r["digest"] is None for r in out] == [False, False, False, True, True, True, False]


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-only", "MPL-2.0", "LGPL-2.1-only"])
def test_whole_licences(spark, name):
    text = (licences.TEXTS / f"{name}.txt").read_text()
    changed = text.replace("(c) <year>", "(c) 2021").replace("license", "licence").replace("\n", "\r\n   ").upper() + "\n\n--\n"
    lost = text.replace(" of ", " off ", 1)
    rest = text.lstrip().partition("\n\n")[2]
    out = sorted(licences.scan(docs(spark, text, changed, rest, lost, "a " + text)).collect(), key=lambda r: r["doc_id"])
    assert [r["license"] for r in out] == [name, name, name, None, None]


def test_known_licences(spark):
    texts = licences.known_texts()
    assert len({k for k, _ in texts}) >= 25
    by = {}
    for k, t in texts:
        by.setdefault(spark.range(1).select(licences.digest(licences.canonical_lines(F.lit(t)))).first()[0], set()).add(k)
    assert all(len(v) == 1 for v in by.values())


def test_licence_joins(spark):
    """Beyond the limit lines are joined, with the same result."""
    d = docs(spark, "Released under the MIT License.\nReleased under the MIT License.", "x", None).withColumns({c: F.lit("clash") for c in ("digest", "_lines", "_row")})
    few = sorted(map(str, licences.scan(d).collect()))
    many = sorted(map(str, licences.scan(d, most=0).select(licences.scan(d).columns).collect()))
    assert few == many
    assert licences.scan(d.limit(0)).count() == 0
    none = licences.known_licences(spark).limit(0)
    assert [r["license"] for r in licences.scan(d, none).collect()] == [None] * 3


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://WWW.Example.org/en/12?x", "www.example.org", "/en/12", "example.org/en/1", "block"), ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("http://org", "org", "", None, None), ("x://y.com/de/#", "y.com", "/de/", "com/de/", "block"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("mailto:x", "", "", None, None), (None, "", "", None, None), ("http://h?q=/p", "h", "", None, None), ("http://É.net#a", "É.net", "", None, None),
])
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    good = spark.createDataFrame([], "host string, good boolean")
    r = urls.judge(pages, good, RULES).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_reputation(spark):
    rows = [("good.example.net", True)] * 60 + [("bad.example.net", False)] * 60 + [("new.example.net", True)] + [("other.org", True)] * 20 + [("x.org", None)]
    outcomes = spark.createDataFrame(rows, "host string, good boolean")
    pages = spark.createDataFrame([(1, "http://good.example.net/"), (2, "http://bad.example.net/"), (3, "http://unknown.example.net/"), (4, "http://fresh.dev/"), (1, "http://u@GOOD.example.net.:8080/")], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "_all", "_host", "domain", "_host_key")})
    out = urls.judge(pages, outcomes).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 5 and got[2]["verdict"] == "block"
    assert {(r["verdict"], r["level"]) for r in out if r["page_id"] == 1} == {("allow", "host")}
    assert (got[3]["level"], got[4]["level"]) == ("domain", "all")
    assert got[1]["bound"] < got[1]["mean"] < 1 and got[3]["verdict"] == "block"
    empty = urls.judge(pages, outcomes.limit(0)).first()
    assert empty["mean"] == pytest.approx(0.5) and empty["bound"] < 0
    assert urls.judge(pages.limit(0), outcomes).count() == 0


def test_reputation_by_hand(spark):
    """Two domains half good, whose hosts are all good or all bad: hosts differ as much as they can, domains not at all."""
    rows = [(f"{h}.{d}.net", h == "a") for d in ("one", "two") for h in "ab" for _ in range(40)]
    table = urls.reputation(spark.createDataFrame(rows, "host string, good boolean"))
    by = {(r["level"], r["key"]): r for r in table.collect()}
    assert by["domain", "one.net"]["m"] == 1000 and by["host", "a.one.net"]["m"] == 1  # the least and the largest spread
    # all: 80 of 160. suffix: a single group has strength 1. domain: 40 of 80 with 1000 observations at 1/2. host: 40 of 40 with one at 1/2
    assert (by["all", ""]["alpha"], by["all", ""]["beta"]) == (81, 81)
    assert (by["suffix", "net"]["alpha"], by["suffix", "net"]["beta"]) == pytest.approx((80.5, 80.5))
    assert (by["domain", "one.net"]["alpha"], by["domain", "one.net"]["beta"]) == pytest.approx((540, 540))
    assert (by["host", "a.one.net"]["alpha"], by["host", "a.one.net"]["beta"]) == pytest.approx((40.5, 0.5))
    # a new host: the domain's own variance is 1/1081 of 1/4, and of what is left half is its hosts'
    assert by["domain", "one.net"]["sure"] == pytest.approx(1080 / 1081 / 2)
    assert by["suffix", "net"]["sure"] == pytest.approx(161 / 162 * 1000 / 1001 / 2)
    assert by["all", ""]["sure"] == pytest.approx(162 / 163 / 2 * 1000 / 1001 / 2)
    page = spark.createDataFrame([(1, "http://c.one.net/")], "page_id long, url string")
    assert urls.judge(page, spark.createDataFrame(rows, "host string, good boolean")).first()["bound"] == pytest.approx(0.5 - 1.645 * (0.25 * (1 - 1080 / 1081 / 2)) ** 0.5)


@pytest.mark.parametrize("host,site,domain,suffix", [
    ("www.example.co.uk", "www.example.co.uk", "example.co.uk", "co.uk"), ("a.b.example.com:80", "a.b.example.com", "example.com", "com"), ("me@x.org.", "x.org", "x.org", "org"), ("10.0.0.1:8080", "10.0.0.1", "10.0.0.1", "address"),
    ("[::1]:80", "[::1]", "[::1]", "address"), ("localhost", "localhost", "localhost", "localhost"), ("", "", "", ""), ("co.uk", "co.uk", "co.uk", "co.uk"), ("x.github.io", "x.github.io", "x.github.io", "github.io"), ("a.x.io", "a.x.io", "x.io", "io"),
])
def test_levels(spark, host, site, domain, suffix):
    c = urls.levels_of(F.lit(host), ["github.io"])
    assert tuple(spark.range(1).select(c["host"], c["domain"], c["suffix"]).first()) == (site, domain, suffix)
