"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, everything but letters becomes one space, and its n-grams of one to three characters are hashed to `BUCKETS`
places. A feature is the n-gram's share of the text's n-grams times its inverse document frequency, which is counted over all training
rows. Weights are fitted by follow-the-regularised-leader with elastic-net penalties on a sample of at most `sample` training rows, the
same number for each language, chosen by hash of the row's key, as long as their n-grams take no more than `sample_bytes` in all; a fifth of the sample is held back to fit the temperature that calibrates
the probabilities. Features of a text's n-grams are linear in its counts, so a score is a sum over the whole text in one pass.

Edge cases: a null text or one without letters is `und` with score 0. Texts of any length are read whole. Labels are compared as they
are; of equal probabilities the first label in order wins. Rows with equal keys and texts are interchangeable. Columns that
clash with internal names are never read. Rows with null text or null label aren't trained on. Without any
training rows every text is `und`; with a single language all texts with letters get it, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import slices

BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
#: Multipliers of the hash, one for each place in an n-gram (odd numbers from the golden ratio's digits).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "u8")
SPACE = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(raw: bytes | None) -> np.ndarray:
    """Code points of a text with a space for each run of other characters, and one at either end; empty without letters."""
    if not raw:
        return np.zeros(0, "u4")
    c = np.frombuffer((" " + raw.decode().lower() + " ").encode("utf-32-le"), "<u4")
    ok = letters()[c]
    if not ok.any():
        return np.zeros(0, "u4")
    c = np.where(ok, c, SPACE).astype("u4")
    stay = ok.copy()
    stay[0] = True
    stay[1:] |= ok[:-1]
    return c[stay]


def buckets(c: np.ndarray, order: int) -> np.ndarray:
    """The places of the n-grams that begin at each character but the last ones."""
    n = len(c) - order + 1
    h = np.full(max(0, n), order, "u8")
    for k in range(order):
        h = (h ^ c[k : k + n].astype("u8")) * MIX[k]
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(13) & np.uint64(BUCKETS - 1)).astype("i4")


def counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and how many n-grams fell there."""
    return np.unique(np.concatenate([buckets(c, k) for k in ORDERS]), return_counts=True)


@dataclass
class Model:
    """weights: by place and language, times the inverse document frequencies."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """For texts with at least one letter."""
        out = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for order in ORDERS:
            parts = [buckets(c, order) for c in texts]
            sizes = np.array([len(p) for p in parts])
            some = sizes > 0
            if some.any():
                at = np.cumsum(sizes[some]) - sizes[some]
                out[some] += np.add.reduceat(self.weights[np.concatenate(parts)], at, axis=0, dtype="f8")
            total += sizes
        return (out / total[:, None] * SCALE + self.bias) / self.temperature


#: Shares of single n-grams are small; this brings features to the order of one.
SCALE = 100.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(rows: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Over all rows: their number and, by place, in how many of them an n-gram falls there. A task gives at most BUCKETS + 1 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, bool), 0
        for batch in slices(batches, text):
            for raw in batch.column(text).cast(pa.large_binary()):
                c = characters(raw.as_py())
                if not len(c):
                    continue
                n += 1
                seen[:] = False
                for order in ORDERS:
                    seen[buckets(c, order)] = True
                df += seen
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[n, df[found]])], ["place", "n"])

    total = rows.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, "i8")
    inside = total["place"] >= 0
    out[total["place"][inside]] = total["n"][inside]
    return int(total["n"][~inside].sum()), out


def training_sample(rows: DataFrame, key: str, text: str, label: str, sample: int, sample_bytes: int) -> tuple[list[str], list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, and the label and counted n-grams of each row of the sample; texts are counted where they are and never sent."""
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return [], [], []
    each = max(1, sample // len(languages))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 1.5 * (each + 20) / sizes[k]))])
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    near = rows.withColumn("_spread", spread).where(F.col("_spread") < share[F.col(label)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [counts(c) if len(c := characters(raw.as_py())) else (np.zeros(0, "i4"), np.zeros(0, "i8")) for raw in batch.column(text).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(label), batch.column("_spread"), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<i4").tobytes() for _, b in found], pa.binary())], ["label", "_spread", "places", "n"])

    order = Window.partitionBy("label").orderBy("_spread", F.xxhash64("places", "n"))
    counted = near.select(label, "_spread", text).mapInArrow(run, "label string, _spread double, places binary, n binary").where(F.octet_length("places") > 0)
    ranked = counted.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= each)
    fits = F.sum(F.octet_length("places") + F.octet_length("n")).over(order) <= sample_bytes // len(languages)
    picked = ranked.withColumn("_fits", fits).where(F.col("_fits") | (F.col("_nth") == 1)).orderBy("_spread", "label", "_nth").drop("_fits").collect()
    index = {k: i for i, k in enumerate(languages)}
    return languages, [index[r["label"]] for r in picked], [(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in picked]


def follow_the_leader(data: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, rounds: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights by place and class (the last place is the bias) by FTRL-proximal steps, one text at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for (at, x), y in zip(data, labels):
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha * w
            n[at] += g2
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm from 1/20 to 20."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = 2400, sample_bytes: int = 100_000_000, rounds: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Learns from rows (key, text, label); sample bounds the rows that weights and temperature are fitted on, sample_bytes what they take on the driver (at least one row for each label)."""
    rows = rows.select(key, text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull())
    languages, labels, found = training_sample(rows, key, text, label, sample, sample_bytes)
    if not found:
        return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0), 1.0)
    n, df = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    data = [(np.r_[at, BUCKETS], np.r_[SCALE * c / c.sum() * idf[at], 1.0]) for at, c in found]
    fit, held = [i for i in range(len(data)) if i % 5], [i for i in range(0, len(data), 5)]
    w = follow_the_leader([data[i] for i in fit] or data, [labels[i] for i in fit] or labels, len(languages), rounds, alpha, beta, l1, l2)
    logits = np.array([data[i][1] @ w[data[i][0]] for i in held])
    return Model(languages, (w[:BUCKETS] * idf[:, None]).astype("f4"), w[BUCKETS], fit_temperature(logits, np.array([labels[i] for i in held])))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the calibrated probability of that language) to each document; columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score")
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS weights for each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, text, 1_000_000):
            texts = [characters(raw.as_py()) for raw in batch.column(text).cast(pa.large_binary())]
            known = [i for i, c in enumerate(texts) if len(c) and m.languages]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                p = softmax(m.logits([texts[i] for i in known]))
                for i, k, s in zip(known, p.argmax(1), p.max(1)):
                    langs[i], scores[i] = m.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return documents.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + ["lang_pred string", "score double"]))


def held_out(key: Column) -> Column:
    """A fifth of the rows, by checksum of the key; rows without a key are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))
