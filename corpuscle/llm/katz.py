"""Language-model scores by a Katz backoff model of order three (or two), learnt from some of the documents and applied to all.

Tokens are lower-cased words (A-Z) and an end after each text; a text's first tokens follow a start. Counts of every order are discounted
by Good and Turing's estimate up to `MOST`, n-grams seen once among them. What discounting frees in a context goes to the words not seen
there, in proportion to their probability one order below, by a weight that makes each context sum to one exactly; unigrams in turn
leave their freed mass to one unknown word. A context whose n-grams are all too frequent for a discount has its count raised by one, so
that it frees something. A token's probability is that of its triple, else the weight of its two words times that of its pair, else the
weight of one word times that of the word.

Words are 64-bit hashes; the commonest, a fixed number, are known to every task by their counts and travel as short codes. A use (a
triple in a document) goes to the bucket of its middle word, where all contexts that end in that word live together, so that a token's
whole recursion runs in one task. Bucket rows hold uses of a slice of documents; they are dealt in rounds of at most `FAN` ways, each of
which merges the rows of the round before, so that rows stay filled and grow in number as the corpus does. Common middle words that hold more
than their share are dealt to several buckets by the third word, and what those share is summed over them: the counts of a context by
kind, from which weights follow. A rarer word meets all its uses in its own bucket, which scores its unigram part and tells the contexts
before it what probability it has. The buckets' rows are shuffled once and read twice or three times within one plan: for counts of counts and shared
sums, then for scores. Sums by document return in groups of slices. Nothing that grows with the corpus is collected or broadcast.

Edge cases: a null or empty text is its end alone. Null keys are never learnt from. Keys may repeat; each row gets its own score. Texts
of any length are taken whole, a long one as a slice of its own. Columns of the result's names, or any other, are ignored. Equal texts get equal
scores. Without any training text every token has the unknown word's probability, 1. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import U, mixed, word_hashes
from .store import keep
from .words import raw_texts, slices

START, END = U(0x5354415254), U(0x454E44)
#: Counts up to MOST are discounted.
MOST = 5
#: So many of the commonest words are known everywhere; a bucket has about so many tokens; a slice about so many bytes of text;
#: a round deals a row to at most so many; a group of slices returns to a task of about so many documents.
COMMON, BUCKET, SLICE, FAN, GROUP = 1 << 16, 1_500_000, 8_000_000, 4096, 500_000
RARE = U(1 << 63)


def packed(x: np.ndarray) -> bytes:
    """An array of integers, byte by byte of their places, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(1).compress(x.view("u1").reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


def unpacked(raw: bytes | None, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1")
    return np.ascontiguousarray(b.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(changes(keys))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold the wanted ones, and which of these they hold."""
    if not len(keys):
        return np.zeros(len(wanted), "i8"), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, and how many each text has."""
    parts = [np.append(word_hashes(t or b""), END) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def discounts(n: list[float]) -> np.ndarray:
    """Factors for counts 0 to MOST and beyond (the last), from how many things have each count, 0 to MOST + 1.

    Where the estimate isn't between 0 and 1 (few counts of a kind), the factor is that of absolute discounting, (r - 1/2) / r.
    """
    out = np.ones(MOST + 2)
    out[0] = 0.0
    tail = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 0.0
    for r in range(1, MOST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


def weights(kept: np.ndarray, total: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count that a context's n-grams are shares of, and its weight; from their discounted count, their count and the mass that they have below."""
    total = np.where(kept >= total * (1 - 1e-12), total + 1, total)
    return total, (1 - kept / total) / (1 - below)


@dataclass
class Common:
    """What every task knows: the commonest words (sorted hashes) with their training counts, and the figures of the unigrams."""

    words: np.ndarray
    counts: np.ndarray
    heavy: np.ndarray  # middle words dealt to several buckets
    parts: np.ndarray  # to how many
    buckets: int
    groups: int
    total: int  # training tokens
    distinct: int
    factors: np.ndarray
    scale: float  # so that seen and unknown words sum to one
    unknown: float
    starts: int  # training texts

    def code(self, h: np.ndarray) -> np.ndarray:
        """Places of common words in the list; other hashes with their highest bit set."""
        at, hit = found_at(self.words, h)
        return np.where(hit, at.astype("u8"), h | RARE)

    def count(self, code: np.ndarray) -> np.ndarray:
        """Training counts of common words, 0 for others."""
        out = np.zeros(len(code), "i8")
        often = code < RARE
        out[often] = self.counts[code[often].astype("i8")]
        return out

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word by its training count."""
        return np.where(c > 0, self.factors[np.minimum(c, MOST + 1)] * c * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def is_heavy(self, middle: np.ndarray) -> np.ndarray:
        return found_at(self.heavy, middle)[1]

    def bucket(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        at, hit = found_at(self.heavy, middle)
        if hit.any():
            part = np.where(hit, mixed(last + U(1)) % self.parts[at], U(0))
            middle = middle + part * U(0xD1342543DE82EF95)
        return (mixed(middle ^ U(0x6B61747A)) % U(self.buckets)).astype("i8")


def unigram_counts(documents: DataFrame, text: str) -> DataFrame:
    """Rows (word, n): counts in training texts; without a word, the number of all tokens of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, every = np.zeros(0, "u8"), np.zeros(0, "i8"), 0
        for batch in slices(batches, text, SLICE):
            h, sizes = tokens(list(raw_texts(batch, text)))
            every += len(h)
            h = h[np.repeat(np.array(batch.column("_train").to_pylist(), bool), sizes)]
            words, counts = summed(np.r_[words, h], np.r_[counts, np.ones(len(h), "i8")])
            if len(words) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(words.view("i8")), pa.array(counts)], ["word", "n"])
                words, counts = words[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array([None, *words.view("i8").tolist()], pa.int64()), pa.array(np.r_[every, counts])], ["word", "n"])

    return keep(documents.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


def common_part(unigrams: DataFrame, texts: int, starts: int, partitions: int) -> Common:
    """The figures of the unigrams by aggregates; the commonest words by a histogram of counts first, so that only they are collected."""
    words = unigrams.where("word is not null")
    kinds = [F.sum((F.col("n") == r).cast("long")) for r in range(1, MOST + 2)]
    total, distinct, *n = [x or 0 for x in words.agg(F.sum("n"), F.count("*"), *kinds).first()]
    every = unigrams.where("word is null").agg(F.sum("n")).first()[0] or 0
    factors = discounts([0, *n])
    seen = 1.0 - sum((1 - factors[r]) * r * n[r - 1] for r in range(1, MOST + 1)) / total if total else 0.0
    unknown = max(1 - seen, 1 / (total + 1))
    size = F.floor(8 * F.log2("n")).cast("int")
    held, least = 0, 1 << 30
    for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("k")).orderBy(F.desc("size")).collect():  # at most 8 * 64 rows
        held += r["k"]
        if held >= COMMON:
            break
        least = r["size"]
    top = words.where((size >= least) | (F.col("word") == int(END))).collect()
    known = sorted({r["word"] % (1 << 64): r["n"] for r in top}.items() | ({(int(END), 0)} if not starts else set()))
    codes, counts = np.array([k for k, _ in known], "u8"), np.array([c for _, c in known], "i8")
    buckets = max(partitions, -(-every // BUCKET), 1)
    share = max(1, min(BUCKET, 2 * every // buckets))
    middle, often = np.r_[np.arange(len(codes)).astype("u8"), START | RARE], np.r_[counts, texts]  # the start is a middle as often as there are texts
    heavy = often > share
    return Common(
        codes, counts, middle[heavy], (-(-2 * often[heavy] // share)).astype("u8"), int(buckets), max(partitions, texts // GROUP), int(total), int(distinct), factors,
        (1 - unknown) / seen / total if total and seen else 0.0, unknown if total else 1.0, starts,
    )


@dataclass
class Uses:
    """Uses of triples, a row each: middle word v, last word w, first word u, slice (a place in ids), document (its place there, times two, plus one if it is learnt from) and number."""

    ids: np.ndarray
    v: np.ndarray
    w: np.ndarray
    u: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    n: np.ndarray

    def rows(self, target: np.ndarray) -> Iterator[dict]:
        """A packed row for each target, its uses by v, w and u: each v with its number of w, and so on.

        They are sorted by target and a few bits of each word, which brings nearly all equal ones together; others take a little more room.
        """
        order = np.argsort((target.astype("u8") << U(51)) | mixed(self.v) >> U(47) << U(34) | mixed(self.w) >> U(47) << U(17) | mixed(self.u) >> U(47), kind="stable")
        target, v, w, u, at, doc, n = (x[order] for x in (target, self.v, self.w, self.u, self.at, self.doc, self.n))
        first = np.flatnonzero(changes(target, v, w, u, at, doc))
        n = np.add.reduceat(n, first, dtype="u4") if len(first) else n
        target, v, w, u, at, doc = (x[first] for x in (target, v, w, u, at, doc))
        new_v = changes(target, v)
        new_w = new_v | changes(w)
        new_u = np.flatnonzero(new_w | changes(u))
        new_w, new_v = np.flatnonzero(new_w), np.flatnonzero(new_v)
        edges = np.flatnonzero(np.r_[changes(target), True]) if len(target) else []
        for a, b in zip(edges, edges[1:]):
            names, place = np.unique(at[a:b], return_inverse=True) if len(self.ids) > 1 else (slice(None), at[a:b])
            us, ws, vs = (x[slice(*np.searchsorted(x, (a, b)))] for x in (new_u, new_w, new_v))
            yield {
                "bucket": int(target[a]), "ids": self.ids[names].astype("<i8").tobytes(), "v": packed(v[vs]), "nv": packed(np.diff(np.r_[np.searchsorted(ws, vs), len(ws)]).astype("u4")), "w": packed(w[ws]),
                "nw": packed(np.diff(np.r_[np.searchsorted(us, ws), len(us)]).astype("u4")), "u": packed(u[us]), "nu": packed(np.diff(np.r_[us, b]).astype("u4")), "at": packed(place.astype("u4")), "doc": packed(doc[a:b]), "n": packed(n[a:b]),
            }


BLOBS = ("info", "ids", "v", "nv", "w", "nw", "u", "nu", "at", "doc", "n")


def schema_of(key_kind: str) -> str:
    return f"bucket int, slice long, keys array<{key_kind}>, " + ", ".join(f"{c} binary" for c in BLOBS)


def batch_of(rows: list[dict], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "slice": pa.int64(), "keys": pa.list_(key_type)} | dict.fromkeys(BLOBS, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], names=list(kinds))


def rows_in(group: pa.Table) -> Iterator[dict]:
    """The packed rows of a table, one at a time."""
    for k in range(group.num_rows):
        yield {c: group.column(c)[k].as_py() for c in BLOBS}


def joined(rows: Iterable[dict]) -> Uses:
    """The uses of packed rows."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("ids", "v", "w", "u", "at", "doc", "n")}
    base = 0
    for r in rows:
        nv, nw, nu = (unpacked(r[c], "u4").astype("i8") for c in ("nv", "nw", "nu"))
        by_pair = np.add.reduceat(nu, np.cumsum(nw) - nw) if len(nw) else nw  # uses of each pair
        by_word = np.add.reduceat(by_pair, np.cumsum(nv) - nv) if len(nv) else nv
        ids = np.frombuffer(r["ids"], "<i8")
        for c, x in (("ids", ids), ("v", np.repeat(unpacked(r["v"], "u8"), by_word)), ("w", np.repeat(unpacked(r["w"], "u8"), by_pair)), ("u", np.repeat(unpacked(r["u"], "u8"), nu))):
            parts[c].append(x)
        parts["at"].append(unpacked(r["at"], "u4") + np.uint32(base))
        parts["doc"].append(unpacked(r["doc"], "u4"))
        parts["n"].append(unpacked(r["n"], "u4"))
        base += len(ids)
    kinds = {"ids": "i8", "v": "u8", "w": "u8", "u": "u8"}
    return Uses(**{c: np.concatenate([np.zeros(0, kinds.get(c, "u4")), *parts.pop(c)]) for c in list(parts)})


def fan_widths(buckets: int) -> list[int]:
    """How many buckets a row of each round is for, down to one."""
    out = [1]
    while -(-buckets // out[0]) > FAN:
        out.insert(0, out[0] * FAN)
    return out


def occurrences(documents: DataFrame, key: str, text: str, sent, partitions: int) -> DataFrame:
    """A row for each bucket and slice (or more, after further rounds) with its uses, and one for each slice, of a bucket below 0, with its documents; dealt by bucket."""
    kind = documents.schema[key].dataType.simpleString()
    widths = fan_widths(sent.value.buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Common = sent.value
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, text, SLICE):
            h, sizes = tokens(list(raw_texts(batch, text)))
            w = know.code(h)
            firsts = np.cumsum(sizes) - sizes
            v = np.r_[START | RARE, w[:-1]]
            v[firsts] = START | RARE
            u = np.r_[START | RARE, v[:-1]]
            u[firsts] = START | RARE
            learn = np.array(batch.column("_train").to_pylist(), "u4")
            doc = np.repeat(np.arange(len(sizes), dtype="u4") * 2 + learn, sizes)
            uses = Uses(np.array([number]), v, w, u, np.zeros(len(w), "u4"), doc, np.ones(len(w), "u4"))
            keys = batch.column(key)
            own = {"bucket": -1 - number % 1_000_003 % 997, "slice": number, "keys": keys, "info": packed(np.c_[sizes, learn].astype("u8").ravel())}
            yield batch_of([own, *uses.rows(know.bucket(v, w) // widths[0])], keys.type)
            number += 1

    def again(width: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            know: Common = sent.value

            def split(rows: list[dict]) -> pa.RecordBatch:
                uses = joined(rows)
                return batch_of(list(uses.rows(know.bucket(uses.v, uses.w) // width)), key_type)

            held, size = [], 0
            for batch in batches:
                key_type = batch.schema.field("keys").type.value_type
                for r in batch.to_pylist():
                    if r["bucket"] < 0:
                        yield batch_of([r], key_type)
                        continue
                    if held and (r["bucket"] != held[0]["bucket"] or size > SLICE):
                        yield split(held)
                        held, size = [], 0
                    held.append(r)
                    size += sum(len(r[c] or b"") for c in BLOBS)
            if held:
                yield split(held)

        return run

    rows = documents.select(key, text, "_train").mapInArrow(run, schema_of(kind))
    for width in widths[1:]:
        rows = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(again(width), schema_of(kind))
    return rows.repartition(partitions, "bucket")


class Counted:
    """The uses of one bucket, sorted, with the counts of its triples, pairs, middle words and contexts (first and middle word)."""

    def __init__(self, rows: Iterable[dict], know: Common):
        x = joined(rows)
        (vs, v), (ws, w), (us, u) = (np.unique(c, return_inverse=True) for c in (x.v, x.w, x.u))
        x.v = x.w = x.u = None
        order = np.argsort((v * len(ws) + w) * len(us) + u) if len(vs) * len(ws) * len(us) < 1 << 63 else np.lexsort((u, w, v))
        v, w, u, self.at, self.doc, self.n = v[order], w[order], u[order], x.at[order], x.doc[order], x.n[order].astype("i8")
        self.know, self.ids = know, x.ids
        del order, x
        new = changes(v, w, u)
        first = np.flatnonzero(new)
        self.triple = np.cumsum(new, dtype="i4") - 1  # of each use
        v, w, u = v[first], w[first], u[first]
        self.c3 = np.add.reduceat(self.n * (self.doc & 1), first)
        new = changes(v, w)
        first = np.flatnonzero(new)
        self.pair = np.cumsum(new, dtype="i4") - 1  # of each triple
        self.w, self.middle = ws[w[first]], v[first].astype("i4")  # of each pair; every middle word is there
        self.c2 = np.add.reduceat(self.c3, first)
        self.v, self.total = vs, np.add.reduceat(self.c2, np.flatnonzero(changes(self.middle)))
        both = v * len(us) + u
        order = np.argsort(both)
        new = changes(both[order])
        self.context = np.empty(len(order), "i4")  # of each triple
        self.context[order] = np.cumsum(new, dtype="i4") - 1
        first = order[new]
        self.context_u, self.context_v = us[u[first]], v[first]
        self.context_total = np.bincount(self.context, self.c3).astype("i8")
        self.heavy = know.is_heavy(self.v)
        self.rare = (self.v >= RARE) & (self.v != START | RARE)


def keyed(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A hash of a context of two words."""
    return mixed(mixed(v + U(0x9E3779B97F4A7C15)) ^ u)


#: Where rows of shared sums go: a bucket, or one of these.
TO_HEAVY, TALLY = -1, -2


def shared_sums(rows: DataFrame, sent) -> DataFrame:
    """Rows (key, dest, amount): counts of counts (16 times the order plus the count), and, for each context of one word, the probability of the rare words seen after it."""

    def run(group: pa.Table) -> pa.Table:
        key, dest, amount = np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0)
        if group.column("bucket")[0].as_py() >= 0:
            know: Common = sent.value
            x = Counted(rows_in(group), know)
            kinds = [np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[1 : MOST + 2] for c in (x.c2, x.c3)]
            some = x.rare[x.context_v] & (x.context_total > 0)
            before, mass = summed(x.context_u[some], know.unigram(x.total[x.context_v[some]]))
            to = np.where(know.is_heavy(before), TO_HEAVY, know.bucket(before, np.zeros(len(before), "u8")))
            key = np.r_[[16 * k + r for k in (2, 3) for r in range(1, MOST + 2)], before.view("i8")]
            dest = np.r_[np.full(2 * (MOST + 1), TALLY), to].astype("i4")
            amount = np.r_[np.concatenate(kinds), mass].astype("f8")
        return pa.table([pa.array(key), pa.array(dest), pa.array(amount)], names=["key", "dest", "amount"])

    parts = rows.groupBy("bucket").applyInArrow(run, "key long, dest int, amount double")
    sums = parts.groupBy("key", "dest").agg(F.sum("amount").alias("amount"))
    return sums.mapInArrow(lambda batches: batches, "key long, dest int, amount double")  # what follows is chosen after one shuffle, which all share


#: Of a context: its count, how many n-grams have each count to MOST and the sum of larger counts, the same by their counts one order below, and the mass below where that is known.
SUMS = ["total", *[f"n{r}" for r in range(1, MOST + 1)], "big", *[f"s{r}" for r in range(1, MOST + 1)], "below", "mass"]


def by_count(of: np.ndarray, c: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """By group: how many have each kind of count up to MOST, and the sum of the larger counts. Only where c is above 0."""
    out = np.zeros((size, MOST + 1))
    for r in range(1, MOST + 1):
        out[:, r - 1] = np.bincount(of[(c > 0) & (kind == r)], minlength=size)
    big = (c > 0) & (kind > MOST)
    out[:, MOST] = np.bincount(of[big], kind[big], size)
    return out


def heavy_sums(rows: DataFrame, sent) -> DataFrame:
    """Rows (key, dest, SUMS) for the contexts of middle words that are dealt to several buckets, as far as this bucket (dest) knows."""

    def run(group: pa.Table) -> pa.Table:
        keys, sums, number = np.zeros(0, "i8"), np.zeros((0, len(SUMS))), group.column("bucket")[0].as_py()
        know: Common = sent.value
        if number >= 0 and any(know.is_heavy(unpacked(v.as_py(), "u8")).any() for v in group.column("v")):
            x = Counted(rows_in(group), know)
            c1 = know.count(x.w)
            mass = np.bincount(x.middle, np.where((x.c2 > 0) & (x.w < RARE), know.unigram(c1), 0.0), len(x.v))
            one = np.c_[x.total, by_count(x.middle, x.c2, x.c2, len(x.v)), np.zeros((len(x.v), MOST + 1)), mass][x.heavy]
            two = np.c_[x.context_total, by_count(x.context, x.c3, x.c3, len(x.context_v)), by_count(x.context, x.c3, x.c2[x.pair], len(x.context_v)), np.zeros(len(x.context_v))]
            some = x.heavy[x.context_v]
            keys = np.r_[x.v[x.heavy], keyed(x.v[x.context_v[some]], x.context_u[some])].view("i8")
            sums = np.r_[one, two[some]]
        return pa.table([pa.array(keys), pa.array(np.full(len(keys), number, "i4")), *[pa.array(c) for c in sums.T]], names=["key", "dest", *SUMS])

    return rows.groupBy("bucket").applyInArrow(run, "key long, dest int, " + ", ".join(f"{c} double" for c in SUMS))


def answers(rows: DataFrame, sent) -> DataFrame:
    """What each bucket has to know beside its own uses, rows (bucket, key, amount, sums, tally): tallies of counts for all, shared sums by key."""
    shared = shared_sums(rows, sent)
    none = F.lit(None)
    light = shared.where("dest >= 0").select(F.col("dest").alias("bucket"), "key", "amount", none.cast("array<double>").alias("sums"), none.cast("array<double>").alias("tally"))
    tally = shared.where(F.col("dest") == TALLY).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "amount"))), lambda x: x["amount"]).alias("tally"))  # 12 rows
    every = tally.select(F.explode(F.sequence(F.lit(0), F.lit(sent.value.buckets - 1))).alias("bucket"), none.cast("long").alias("key"), none.cast("double").alias("amount"), none.cast("array<double>").alias("sums"), "tally")
    out = light.union(every)
    if len(sent.value.heavy):
        given = shared.where(F.col("dest") == TO_HEAVY).select("key", "dest", *[(F.col("amount") if c == "mass" else F.lit(0.0)).alias(c) for c in SUMS])
        own = heavy_sums(rows, sent).union(given)
        whole = own.select("key", "dest", F.array(*[F.sum(c).over(Window.partitionBy("key")) for c in SUMS]).alias("sums")).where("dest >= 0")
        out = out.union(whole.select("dest", "key", none.cast("double"), "sums", none.cast("array<double>")))
    return out


class Told:
    """What a bucket was told: tallies of counts of pairs and of triples, probabilities of rare words by context, shared sums by context."""

    def __init__(self, table: pa.Table):
        some = lambda c: table.filter(pc.is_valid(table.column(c)))
        tally = some("tally").column("tally")[0].as_py()
        self.f2, self.f3 = (discounts([0, *tally[k : k + MOST + 1]]) for k in (0, MOST + 1))
        light, dealt = some("amount"), some("sums")
        self.keys, self.mass = summed(light.column("key").to_numpy().astype("i8").view("u8"), light.column("amount").to_numpy())
        keys, sums = dealt.column("key").to_numpy().astype("i8").view("u8"), np.array(dealt.column("sums").to_pylist(), "f8").reshape(-1, len(SUMS))
        order = np.argsort(keys)
        self.shared_keys, self.shared = keys[order], sums[order]

    def rare_mass(self, contexts: np.ndarray) -> np.ndarray:
        at, hit = found_at(self.keys, contexts)
        return np.where(hit, self.mass[at], 0.0) if len(self.keys) else np.zeros(len(contexts))

    def shared_of(self, contexts: np.ndarray) -> np.ndarray:
        """The shared sums of contexts that have some."""
        return self.shared[found_at(self.shared_keys, contexts)[0]]


def kept_of(sums: np.ndarray, factors: np.ndarray, first: int) -> np.ndarray:
    """Discounted counts from how many have each count, from a column on, and the sum of the larger ones after them."""
    return sums[:, first : first + MOST] @ (factors[1 : MOST + 1] * np.arange(1, MOST + 1)) + sums[:, first + MOST]


def recursion(x: Counted, told: Told, know: Common, order: int) -> np.ndarray:
    """By triple, the logarithm of the probability of its last word, but for the unigram part of a rare word that was never seen after its middle word."""
    shares = lambda factors, c: factors[np.minimum(c, MOST + 1)] * c
    often = x.w < RARE
    p1 = know.unigram(know.count(x.w))
    kept, total = np.bincount(x.middle, shares(told.f2, x.c2), len(x.v)), x.total.astype("f8")
    below = np.bincount(x.middle, np.where((x.c2 > 0) & often, p1, 0.0), len(x.v)) + told.rare_mass(x.v)
    if x.heavy.any():
        sums = told.shared_of(x.v[x.heavy])
        total[x.heavy], kept[x.heavy], below[x.heavy] = sums[:, 0], kept_of(sums, told.f2, 1), sums[:, -1]
    of_word, weight = weights(kept, total, below)
    with np.errstate(divide="ignore"):
        pair = shares(told.f2, x.c2) / of_word[x.middle]
        value = np.where(x.c2 > 0, np.log10(pair), np.log10(np.where(total > 0, weight, 1.0))[x.middle] + np.where(often, np.log10(p1), 0.0))[x.pair]
    if order == 2:
        return value
    kept, total = np.bincount(x.context, shares(told.f3, x.c3), len(x.context_v)), x.context_total.astype("f8")
    below = np.bincount(x.context, np.where(x.c3 > 0, pair[x.pair], 0.0), len(x.context_v))
    dealt = x.heavy[x.context_v]
    if dealt.any():
        sums = told.shared_of(keyed(x.v[x.context_v[dealt]], x.context_u[dealt]))
        total[dealt], kept[dealt], below[dealt] = sums[:, 0], kept_of(sums, told.f3, 1), kept_of(sums, told.f2, MOST + 2) / of_word[x.context_v[dealt]]
    of_two, weight = weights(kept, total, below)
    with np.errstate(divide="ignore"):
        return np.where(x.c3 > 0, np.log10(shares(told.f3, x.c3) / of_two[x.context]), np.log10(np.where(total > 0, weight, 1.0))[x.context] + value)


def scored(rows: DataFrame, told: DataFrame, sent, key_kind: str, order: int) -> DataFrame:
    """Rows by group of slices: those of documents as they are (first), and sums of scores, base scores and known tokens by document."""
    blobs = ("info", "ids", "at", "doc", "score", "base", "known")

    def sums(left: pa.Table, right: pa.Table, know: Common) -> Iterator[dict]:
        x = Counted(rows_in(left), know)
        value = recursion(x, Told(right), know, order)
        # what common words add as last words, and rare ones as middle words
        c = know.count(x.w)[x.pair]
        often = (x.w < RARE)[x.pair]
        base, known = np.where(often, know.base(c), 0.0), (c > 0).astype("i8")
        own = x.context_v[x.context]
        rare, c = x.rare[own], x.total[own]
        base, known = base + np.where(rare, know.base(c), 0.0), known + (rare & (c > 0))
        value = value + np.where(rare & (x.context_total[x.context] == 0), np.log10(know.unigram(c)), 0.0)
        key, value, base, known = summed((x.at.astype("u8") << U(32)) | (x.doc >> 1).astype("u8"), value[x.triple] * x.n, base[x.triple] * x.n, known[x.triple] * x.n)
        at, doc = (key >> U(32)).astype("i8"), (key & U(0xFFFFFFFF)).astype("u4")
        group = np.array([group_of(i, know.groups) for i in x.ids.tolist()])[at]
        for g in np.unique(group).tolist():
            some = group == g
            names, place = np.unique(at[some], return_inverse=True)
            yield {"grp": g, "first": False, "ids": x.ids[names].astype("<i8").tobytes(), "at": packed(place.astype("u4")), "doc": packed(doc[some]), "score": value[some].tobytes(), "base": base[some].tobytes(), "known": packed(known[some].astype("u4"))}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        know: Common = sent.value
        out: list[dict] = []
        if left.num_rows and left.column("bucket")[0].as_py() < 0:
            out = [{"grp": group_of(r["slice"], know.groups), "first": True} | r for r in left.select(["slice", "keys", "info"]).to_pylist()]
        elif left.num_rows:
            out = list(sums(left, right, know))
        kinds = {"grp": pa.int32(), "first": pa.bool_(), "slice": pa.int64(), "keys": left.schema.field("keys").type} | dict.fromkeys(blobs, pa.binary())
        return pa.table([pa.array([r.get(c) for r in out], k) for c, k in kinds.items()], names=list(kinds))

    schema = f"grp int, first boolean, slice long, keys array<{key_kind}>, " + ", ".join(f"{c} binary" for c in blobs)
    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, schema)


def group_of(number: int, groups: int) -> int:
    """The group of slices that a slice returns in."""
    return (number * 0x9E3779B97F4A7C15 >> 17) % groups


def score(documents: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """A row (key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document; the model learns where `train` holds. order: 2 or 3 words."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = documents.select(key, text, F.coalesce(train, F.lit(False)).alias("_train"))
    texts, starts = documents.agg(F.count("*"), F.coalesce(F.sum(F.col("_train").cast("long")), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(common_part(unigram_counts(documents, text), texts, starts, partitions))  # bounded by COMMON
    rows = occurrences(documents, key, text, sent, partitions)
    sums = scored(rows, answers(rows, sent), sent, kind, order)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        group = None

        def results() -> Iterator[pa.RecordBatch]:
            for keys, sizes, learn, total, base, known in held.values():
                yield pa.RecordBatch.from_arrays([keys, pa.array(learn == 0), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), sent.value.total)), pa.array(base), pa.array(total)], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                if get("grp") != group:
                    yield from results()
                    group = get("grp")
                if get("first"):
                    sizes, learn = unpacked(get("info"), "u8").reshape(-1, 2).T.astype("i8")
                    held[get("slice")] = (batch.column("keys")[k].values, sizes, learn, np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), "i8"))
                    continue
                at, doc = unpacked(get("at"), "u4"), unpacked(get("doc"), "u4")
                values = [np.frombuffer(get("score")), np.frombuffer(get("base")), unpacked(get("known"), "u4")]
                for place, number in enumerate(np.frombuffer(get("ids"), "<i8").tolist()):
                    some = at == place
                    for sums_, x in zip(held[number][3:], values):
                        sums_[doc[some]] += x[some].astype(sums_.dtype)
        yield from results()

    ordered = sums.repartition(partitions, "grp").sortWithinPartitions("grp", F.desc("first"))
    return ordered.mapInArrow(finish, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
