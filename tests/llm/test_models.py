"""Language identification, quality rules and language-model scores: held-out accuracy and brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpuscle.llm import fertility, katz, langid

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SYLLABLES = {"en": ("th", "ing", "er", "on", "ed"), "de": ("sch", "ein", "ung", "ver", "ä"), "fr": ("eau", "que", "é", "ent", "oi")}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, made(rng, k := list(SYLLABLES)[i % 3], int(rng.integers(20, 120))), k) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_language_id(spark, corpus):
    held = langid.held_out(F.col("doc_id"))
    odd = spark.createDataFrame([(9000, None, "en"), (9001, "", None), (9002, "123 !!", "en"), (None, "eau que", "fr")], corpus.schema)
    model = langid.train(corpus.union(odd).where(~held), sample=300)
    out = langid.predict(corpus.union(odd).withColumn("score", F.lit("clash")), model).collect()
    own = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(own) > 80 and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (9000, 9001, 9002)} == {"und"}
    assert next(r["lang_pred"] for r in out if r["doc_id"] is None) == "fr"


def test_language_id_without_labels(spark, corpus):
    model = langid.train(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(corpus.limit(3), model).collect()} == {"und"}
    one = langid.train(corpus.where("lang = 'en'"), sample=50)
    assert {r["lang_pred"] for r in langid.predict(corpus.limit(3), one).collect()} == {"en"}
    assert langid.predict(corpus.limit(0), one).count() == 0


def test_language_id_parts():
    c = langid.characters("A1 b--É".encode())
    assert "".join(map(chr, c)) == " a b é "
    assert len(langid.characters(b"12 .")) == 0 == len(langid.characters(None))
    found, n = langid.counts(c)
    assert n.sum() == sum(len(c) - k + 1 for k in langid.ORDERS)
    model = langid.Model(["x", "y"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype("f4"), np.zeros(2), 2.0)
    want = sum(model.weights[p] * k for p, k in zip(found, n)) / n.sum() * langid.SCALE / 2
    assert model.logits([c, c])[1] == pytest.approx(want, rel=1e-4)
    logits = np.array([[4.0, 0.0]] * 3 + [[0.0, 4.0]])
    assert langid.fit_temperature(logits, np.array([0, 0, 1, 1])) > 1


def test_leader_by_hand(monkeypatch):
    """Weights by the textbook's step for one coordinate at a time."""
    monkeypatch.setattr(langid, "BUCKETS", 12)
    rng = np.random.default_rng(3)
    data = [(np.r_[np.sort(rng.choice(12, 4, replace=False)), 12], np.r_[rng.random(4) * 2, 1.0]) for _ in range(30)]
    labels = [int(at[0]) % 3 for at, _ in data]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.6, 0.01
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        v = z[i, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    for _ in range(4):
        for (at, x), y in zip(data, labels):
            logits = [sum(v * weight(i, c) for i, v in zip(at.tolist(), x)) for c in range(3)]
            total = sum(math.exp(v) for v in logits)
            for c in range(3):
                for i, v, w in [(i, v, weight(i, c)) for i, v in zip(at.tolist(), x)]:
                    g = v * (math.exp(logits[c]) / total - (c == y))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * w
                    n[i, c] += g * g
    want = [[weight(i, c) for c in range(3)] for i in range(13)]
    assert langid.follow_the_leader(data, labels, 3, 4, alpha, beta, l1, l2) == pytest.approx(np.array(want))
    assert any(w == 0 for row in want for w in row)  # sparse


def test_document_frequencies_and_sample(spark, corpus):
    rows = corpus.where("doc_id < 60")
    n, df = langid.document_frequencies(rows, "text")
    want = Counter()
    for r in rows.collect():
        want.update(set(langid.counts(langid.characters(r["text"].encode()))[0].tolist()))
    assert n == 60 and {i: int(df[i]) for i in np.flatnonzero(df)} == want
    languages, labels, found = langid.training_sample(rows, "doc_id", "text", "lang", 30, 10**9)
    assert languages == ["de", "en", "fr"] and Counter(labels) == {0: 10, 1: 10, 2: 10}
    assert Counter(langid.training_sample(rows, "doc_id", "text", "lang", 30, 1)[1]) == {0: 1, 1: 1, 2: 1}  # one row for each language at least
    assert all(n.sum() > 0 for _, n in found)


def naive(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if any(c not in " \t\n\v\f\r" for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_counts(spark):
    texts = [None, "", " \n ", "a b c a b c", "x y\nx y\n x y\nx y", "é# * w\x1cz $%&|<>", "a a a a a", "one", "漢字 text\tmore"] * 2
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("kept", "_lang", "script")})
    out = sorted(fertility.judge(df, PIECES, WORDS, least=2).collect(), key=lambda r: r["doc_id"])
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == naive(r["text"]), r["text"]
        assert r["base_failed"] and not r["kept"]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [i for w in ("漢字", "text", "more") for i in sp.encode(w)]
    last = out[8]
    assert last["byte_share"] == pytest.approx(sum(3 <= i <= 258 for i in ids) / len(ids)) and last["piece_chars"] == pytest.approx(10 / len(ids)) and last["script"] == "Latin"
    assert fertility.judge(df.limit(0), PIECES, WORDS).count() == 0


def test_quality_bands(spark, corpus):
    rng = np.random.default_rng(8)
    clean = [(i, made(rng, k := list(SYLLABLES)[i % 3], 200), k) for i in range(600)]
    junk = [(1000 + i, " ".join(w + "###" for w in made(rng, "en", 200).split()), "en") for i in range(20)]
    few = [(2000, made(rng, "en", 200), "xx"), (2001, made(rng, "en", 200), None)]
    out = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(clean + junk + few, corpus.schema), PIECES, WORDS, least=100).collect()}
    assert sum(out[i]["kept"] for i in range(600)) >= 594
    assert not any(out[1000 + i]["kept"] for i in range(20))
    assert out[2000]["band"] == out[2001]["band"] == "script:Latin" and out[0]["band"] == "lang:en"


def test_quality_by_hand(spark, corpus):
    """Measures, medians and verdicts by plain Python, from the vocabularies' own encoding of each word."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    rows = [(i, made(rng, k := list(SYLLABLES)[i % 3], int(rng.integers(60, 90))) + " #" * (i % 7 == 0) * 30, None if i % 10 == 9 else k) for i in range(120)] + [(500, "漢字仮名" * 9000, "zh"), (501, "漢字 仮名 " * 40, "zh")]
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    measures = {}
    for i, text, lang in rows:
        words = text.split()
        ids = [x for w in words for x in sp.encode(w)]
        n = sum(map(len, words))
        share = [v / len(ids) for v in Counter(ids).values()]
        entropy = -sum(p * math.log2(p) for p in share) / math.log2(min(len(ids), 32_000))
        measures[i] = (n / len(ids), n / sum(len(tok.encode(w, add_special_tokens=False).ids) for w in words), sum(3 <= x <= 258 for x in ids) / len(ids), entropy)
    base = {i: len(t.split()) < 50 or 100 * naive(t)[4] > 50 * len(t.split()) for i, t, _ in rows}
    middle = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    by_length = lambda i, k: 1.0 if k == 3 else math.sqrt(len(rows_by[i][1].split()))
    rows_by = {r[0]: r for r in rows}
    groups = defaultdict(list)
    for i, _, lang in rows:
        if not base[i]:
            for g in ("lang:" + lang if lang else None, "script:Latin", "all"):
                groups[g].append(i)
    out = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, corpus.schema), PIECES, WORDS, reach=2.0, least=30).collect()}
    kept = 0
    for i, _, lang in rows:
        assert [out[i][m] for m in fertility.MEASURES] == pytest.approx(measures[i]), i
        g = "lang:" + lang if lang and len(groups["lang:" + lang]) >= 30 else "script:Latin" if i < 500 else "all"
        assert out[i]["band"] == g and out[i]["base_failed"] == base[i]
        inside = True
        for k in range(4):
            mid = middle([measures[j][k] for j in groups[g]])
            scale = 1.4826 * middle([abs(measures[j][k] - mid) * by_length(j, k) for j in groups[g]])
            inside &= abs(measures[i][k] - mid) <= max(2.0 * scale / by_length(i, k), 0.03 * mid, 0.002)
        assert out[i]["kept"] == (inside and not base[i]), i
        kept += out[i]["kept"]
    assert 40 < kept < 115


LONG = [" ".join(f"w{i * 7919 % 60_000}" for i in range(400_000)), "x" * 150_000, None, ""]


def test_long_texts(spark):
    """Texts of megabytes, and one without white space."""
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(LONG)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in katz.score(df, F.lit(True)).collect()}
    assert out[0]["n_tokens"] == 400_001 and out[1]["n_tokens"] == 2 and out[0]["n_known"] == 400_001
    out = {r["doc_id"]: r for r in fertility.judge(df, PIECES, WORDS).collect()}
    assert out[0]["n_words"] == 400_000 and out[1]["word_chars"] == 150_000 and out[1]["base_failed"]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.train(df, sample=10)).collect()}
    assert out == {0: "en", 1: "en", 2: "und", 3: "und"}


def katz_by_hand(texts, learn, order):
    """Every n-gram counted in dictionaries, and a recursion over orders; each context that occurs is checked to sum to one."""
    toks = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in texts.items()}
    counts, of = [Counter() for _ in range(order + 1)], Counter()
    for i in learn:
        for k, w in enumerate(toks[i]):
            for n in range(1, order + 1):
                before = tuple(([""] * order + toks[i][:k])[order + k - n + 1 : order + k])
                counts[n][before, w] += 1
                if n > 1:
                    of[before] += 1
    factors = [None] + [katz.discounts([0] + [sum(v == r for v in c.values()) for r in range(1, katz.MOST + 2)]) for c in counts[1:]]
    one = Counter({w: v for (_, w), v in counts[1].items()})
    total = sum(one.values())
    seen = sum(factors[1][min(v, 6)] * v for v in one.values()) / total
    unknown = max(1 - seen, 1 / (total + 1))
    after, weight = defaultdict(list), {}

    def p(before, w):
        n = len(before) + 1
        if n == 1:
            return factors[1][min(one[w], 6)] * one[w] * (1 - unknown) / seen / total if one[w] else unknown
        if v := counts[n][before, w]:
            return factors[n][min(v, 6)] * v / of[before]
        return weight.get(before, 1.0) * p(before[1:], w)

    for n in range(2, order + 1):
        for before, w in counts[n]:
            after[before].append(w)
        for before in [b for b in after if len(b) == n - 1]:
            kept = sum(factors[n][min(counts[n][before, w], 6)] * counts[n][before, w] for w in after[before])
            of[before] += kept >= of[before] * (1 - 1e-12)
            weight[before] = (1 - kept / of[before]) / (1 - sum(p(before[1:], w) for w in after[before]))
    for before in list(after)[:200]:
        assert sum(p(before, w) for w in one) + p(before, "no word") == pytest.approx(1)
    out = {}
    for i, t in toks.items():
        s = sum(math.log10(p(tuple(([""] * order + t[:k])[k + 1 : order + k]), w)) for k, w in enumerate(t))
        b = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in t)
        out[i] = (len(t), sum(one[w] > 0 for w in t), total, b, s)
    return out


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("common,bucket,fan", [(1 << 16, 4_000_000, 4096), (40, 900, 3), (5, 60, 2)])
def test_katz(spark, order, common, bucket, fan, monkeypatch):
    """With words rare and common, middle words dealt to several buckets, and buckets dealt in several rounds."""
    for name, value in (("COMMON", common), ("BUCKET", bucket), ("FAN", fan), ("GROUP", 40)):
        monkeypatch.setattr(katz, name, value)
    rng = np.random.default_rng(2)
    vocabulary = [made(rng, "en", 1) for _ in range(150)]
    often = lambda n: " ".join(vocabulary[int(i)] for i in rng.zipf(1.4, n) % 150)
    texts = {i: often(int(rng.integers(0, 60))) for i in range(200)} | {500: None, 501: "", 502: "Same same SAME " * 50, 503: "ÉTÉ été\x0bx\x1cy", 504: "dup dup", 505: "dup dup", 506: "z" * 3000}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "bucket", "_train", "first")})
    want = katz_by_hand(texts, learn, order)
    out = katz.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, order=order).collect()
    assert len(out) == len(texts)
    for r in out:
        n, known, total, base, s = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] not in learn)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(s)


def test_katz_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id long, text string")
    out = katz.score(df, F.col("doc_id") == 1).collect()
    assert sorted(r["held_out"] for r in out) == [False, False, True] and {r["train_tokens"] for r in out} == {4}
    none = katz.score(df, F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["train_tokens"] for r in none} == {0}
    assert katz.score(df.limit(0), F.lit(True)).count() == 0


def test_katz_pairs_seen_once(spark):
    out = katz.score(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), F.col("doc_id") == 1).collect()
    own = next(r for r in out if r["doc_id"] == 1)
    assert own["score"] == pytest.approx(3 * math.log10(0.5))  # each triple is its context's only one and keeps half its count
    with pytest.raises(ValueError):
        katz.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True), order=4)
