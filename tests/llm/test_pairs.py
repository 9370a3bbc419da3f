"""Near-duplicates and benchmark leaks against brute force; the pipeline as a whole."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import decontam, hashing, neardup


def made(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.randrange(9999)}" if rng.random() < share else w for w in words]


def by_hand(a, b):
    shingle = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    x, y = shingle(a), shingle(b)
    x, y = ({k: v / sum(c.values()) for k, v in c.items()} for c in (x, y))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x if i in y)


def test_similarity_and_estimate():
    rng = random.Random(4)
    errors = []
    for share in (0.0, 0.01, 0.03, 0.1, 0.3):
        for _ in range(6):
            a = made(rng, 150) + ["the", "same"] * rng.randrange(12)
            b = edited(rng, a, share)
            x, y = (neardup.bag(" ".join(w).encode()) for w in (a, b))
            want = by_hand(a, b)
            assert neardup.similarity(x, y) == pytest.approx(want)
            errors.append((neardup.signature(*x, 400) == neardup.signature(*y, 400)).mean() - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t\x1c", max_size=60))
def test_word_hashes(text):
    words = text.encode().lower().split()
    h = hashing.word_hashes(text.encode()).tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words))
    assert h == [hashing.word_hashes(w)[0] for w in words]


def components(links, names):
    label = {n: n for n in names}
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_corpus():
    rng = random.Random(9)
    base = made(rng, 200)
    texts = [" ".join(edited(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]))) for _ in range(60)]
    texts += [" ".join(made(rng, 120)) for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[70].upper(), "short", "short", "one two three four", "one two three four", "", "", " ", None, None]
    return texts


def test_classes(spark):
    texts = near_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("clash"))
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    known = {i: t for i, t in enumerate(texts) if t is not None}
    bags = {i: neardup.bag(t.encode()) for i, t in known.items()}
    links = [(i, j) for i in known for j in known if i < j and (known[i] == known[j] or (len(bags[i][0]) and len(bags[j][0]) and neardup.similarity(bags[i], bags[j]) >= 0.8))]
    want = components(links, list(range(len(texts))))
    assert out == want
    kept = neardup.one_of_each(df).collect()
    assert len(kept) == len(set(want.values())) and {want[r["doc_id"]] for r in kept} == set(want.values())


def test_classes_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 7)
    monkeypatch.setattr(neardup, "STARS", 0)
    texts = near_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    monkeypatch.undo()
    assert out == {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}


def test_boilerplate(spark):
    """Texts that share a bucket but are no duplicates: only their few rare shingles are looked at, and copies among them are still found."""
    rng = random.Random(12)
    plate = made(rng, 300)
    texts = [" ".join(plate + made(rng, 90)) for _ in range(40)]
    texts += [" ".join(edited(rng, t.split(), 0.003)) for t in texts[:10]]
    bags = spark.createDataFrame([(i, h.tobytes(), n.tobytes()) for i, (h, n) in enumerate(neardup.bag(t.encode()) for t in texts)], "id long, h binary, n binary")
    groups = neardup.rarest(bags, 0.8).groupBy("group").count()
    assert groups.agg(F.max("count")).first()[0] == 2
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {i: i for i in range(40)} | {40 + i: i for i in range(10)}


def test_class_keys(spark):
    same = spark.createDataFrame([(7, "a b c d e f"), (7, "u v w x y z"), (8, "u v w x y Z")], "doc_id long, text string")
    assert len({r["class_id"] for r in neardup.near_duplicates(same).collect()}) == 2  # a key of two classes
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (None, None), (3, "A b c d e f")], "doc_id long, text string")
    out = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect()]
    assert sorted((k, c) for k, c in out if k) == [(3, 3), (5, 3), (5, 3)]
    assert sum(c is not None and c < 0 for k, c in out if k is None) == 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.one_of_each(df.limit(0)).count() == 0
    odd = df.withColumns({"_row": F.lit("mine"), "_node": F.col("text"), "id": F.lit(1)})
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 3 and {r["_row"] for r in kept.collect()} == {"mine"}


def test_wand():
    rng = random.Random(1)
    items = [(i, " ".join(made(rng, rng.randrange(3, 40), 120))) for i in range(60)]
    index = decontam.Index(items, size=4)
    for _ in range(300):
        words = {f"w{rng.randrange(120)}".encode() for _ in range(rng.randrange(1, 80))}
        terms = [index.term[w] for w in words if w in index.term]
        for least in (0.2, 0.6, 0.95):
            want = Counter()
            for t in terms:
                for i, x in index.postings[t]:
                    want[i] += x
            live = index.live(np.array(terms or [len(index.postings)]), max(1, len(terms)), least)
            got = dict(index.search(terms, live.any(0), least))
            assert got.keys() == {i for i, x in want.items() if x >= least}
            assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(made(rng, 10 + i))) for i in range(30)] + [(90, "Qua tro word item"), (91, None), (92, ""), (93, "twin item has seven words in it"), (94, "twin item has seven words in it")]
    filler = lambda n: " ".join(made(rng, n))
    docs = [(k, f"{filler(rng.randrange(300))} {items[k][1]} {filler(rng.randrange(300))}") for k in range(30)]
    docs += [(100, filler(500)), (101, None), (102, ""), (103, "a " * 40 + "QUA, tro word... item b"), (104, "x TWIN item, has seven words in IT!"), (105, " ".join(items[20][1].split()[:12])), (105, " ".join(items[20][1].split()[18:]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    for part in (20_000, 10):
        out = {(r["doc_id"], r["item_id"]) for r in decontam.scan(d, b, slice_items=part).collect()}
        assert out == {(k, k) for k in range(30)} | {(103, 90), (104, 93), (104, 94)}
    stay = sorted(r["doc_id"] for r in decontam.clean(d, b).collect())
    assert stay == [100, 101, 102, 105, 105]
    assert decontam.scan(d, b.limit(0)).count() == 0 and decontam.scan(d.limit(0), b).count() == 0 and decontam.clean(d, b.limit(0)).count() == len(docs)


def test_leaks_with_edits(spark):
    rng = random.Random(3)
    items = [made(rng, n) for n in (15, 24, 40, 59)]
    other = lambda w, k: [*w[:k], "other", *w[k + 1 :]]
    texts = [other(w, len(w) - 3) for w in items] + [w[:-2] for w in items]
    texts += [w[: -(len(w) // 3)] + made(rng, len(w) // 3) for w in items] + [made(rng, 6) for _ in items]  # another answer
    docs = [(i, " ".join([*made(rng, 70), *t, *made(rng, 70)])) for i, t in enumerate(texts)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.scan(d, b).collect()) == [(i, i % 4) for i in range(8)]
    assert sorted(r["doc_id"] for r in decontam.clean(d, b).collect()) == list(range(8, 16))


def test_leaks_whatever_the_slices(spark):
    rng = random.Random(6)
    items = [(i, " ".join(made(rng, 12 + i, 60))) for i in range(30)]
    docs = [(i, " ".join(edited(rng, t.split(), 0.03))) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted((r["doc_id"], r["item_id"], r["first_word"], round(r["score"], 9)) for r in decontam.scan(d, b, slice_items=n).collect()) for n in (20_000, 7))
    assert whole and parts == whole


def test_long_texts(spark):
    text = " ".join(f"w{i * 7919 % 60_000}" for i in range(300_000))
    df = spark.createDataFrame([(0, text), (1, text + " end"), (2, "x" * 200_000), (3, "x" * 200_000 + "y"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, " ".join(text.split()[5000:5040])), (8, " ".join(text.split()[9000:9900])), (9, "other words " * 20)], "item_id long, text string")
    for size in (20_000_000, 300):
        found = {(r["doc_id"], r["item_id"]) for r in decontam.scan(df, items, slice_bytes=size).collect()}
        assert found == {(d, i) for d in (0, 1) for i in (7, 8)}


def test_stages_keep_columns(spark):
    """Columns named as results of the stages come back as they were."""
    sf = "/root/testdata/sf0.001"
    names = ("score", "lang_pred", "kept", "band", "script", "n_words", "entropy", "_lang", "label", "_node", "_row", "piece", "_given_0")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    docs = docs.unionByName(docs.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")})).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows if r["doc_id"] is not None for c in names), name
        assert any(r["text"] is None for r in rows) == (k >= 2), name


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert kept and kept <= ids
            ids = kept
            docs = docs.where(F.col("doc_id").isin(*kept))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
