"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

The index holds the postings of lower-cased words with their BM25 weights, as shares of what an item scores against itself, so that one
threshold suits items of any length. Postings are in blocks of items, with the largest weight of each term in each block. Items are in
classes by length, each an index of its own. A document is cut into chunks as long as the longest item of the
class; a passage is two chunks in a row, so that a copied item lies inside a passage. Block-max
bounds of all passages come first, by array operations; passages with a live block go through block-max WAND, which returns every
item at or above the threshold. An item is a leak if the passage has enough of the five-word shingles of its question and of its
answer (the last third of its words, where the items come as one text), or `share` of the shingles of the whole item and of the words of
its answer, as an edit or a lost end leaves it.

The benchmark is collected and broadcast in slices of at most about `slice_items` items and `slice_bytes` bytes of text, over each
of which documents are scanned; weights follow the figures of the whole benchmark. No text of a document is shuffled.

Edge cases: null or empty texts and items match nothing; an item of fewer than five words is one shingle. Items alike are each found; of
passages with equal scores the first counts. Texts and items of any length are taken whole; an item longer than a slice is
a slice of its own. Keys may repeat: copies of a document are scanned one by one. scan() reads key and text only, clean() gives all columns back
as they are, so that no names clash. An empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep
from .words import raw_texts, slices

K1, B = 1.2, 0.75
SHINGLE = 5
END = 1 << 60
#: Everything in ASCII but digits and lower-case letters parts words.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.decode().lower().encode().translate(PARTS).split() if raw else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return set(zip(*[words[i : len(words) - k + 1 + i] for i in range(k)])) if k else set()


@dataclass
class Item:
    key: object
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)
    across: set = field(default_factory=set)  # shingles of both
    ending: set = field(default_factory=set)  # words of the answer, or of the item if it has none


@dataclass
class Whole:
    """Of a whole benchmark: in how many items words occur (those that a slice has), items with words and their mean length."""

    df: dict[bytes, int]
    count: int
    mean: float


class Index:
    """Items with at least one word, in the order given; postings by term, blocks of `size` items."""

    def __init__(self, rows: list[tuple[object, str | None]], size: int = 2, cells: int = 16_000_000, whole: Whole | None = None):
        texts = [(k, w) for k, t in rows if (w := words_of((t or "").encode()))]
        self.items: list[Item] = []
        if whole is None:
            whole = Whole(Counter(t for _, w in texts for t in set(w)), len(texts), sum(len(w) for _, w in texts) / max(1, len(texts)))
        df, count, mean = whole.df, whole.count, whole.mean
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, (key, w) in enumerate(texts):
            cut = max(1, len(w) - max(SHINGLE, len(w) // 3)) if len(w) > 2 * SHINGLE else len(w)
            self.items.append(Item(key, shingles(w[:cut]), shingles(w[cut:]), shingles(w[cut - SHINGLE + 1 : cut + SHINGLE - 1]) if cut < len(w) else set(), set(w[cut:] or w)))
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: math.log1p((count - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings[t].append((i, x / own))
        self.longest = max((len(w) for _, w in texts), default=1)
        self.size = max(size, -(-len(texts) * len(postings) // cells))  # coarser blocks for a large benchmark
        self.blocks = -(-len(texts) // self.size)
        self.term = {t: n for n, t in enumerate(postings)}
        self.postings = list(postings.values())
        self.most = [max(x for _, x in p) for p in self.postings]
        self.block_most = np.zeros((len(self.postings) + 1, max(1, self.blocks)), "f4")  # the last row is for other words
        for n, p in enumerate(self.postings):
            for i, x in p:
                self.block_most[n, i // self.size] = max(self.block_most[n, i // self.size], x)

    def live(self, terms: np.ndarray, chunk: int, least: float) -> np.ndarray:
        """Which passages (rows) have a bound of `least` or more in which blocks (columns). terms: of each word; len(postings) for others."""
        n = -(-len(terms) // chunk)
        width = len(self.postings) + 1
        cells = np.unique(np.repeat(np.arange(n), chunk)[: len(terms)] * width + terms)
        at = np.searchsorted(cells, np.arange(n) * width)  # each chunk has a word
        sums = np.add.reduceat(self.block_most[cells % width], at, axis=0)
        both = sums if n == 1 else sums[:-1] + sums[1:]
        return both >= least - 1e-4

    def search(self, terms: Iterable[int], live: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Items of the live blocks that score `least` or more against these terms, by block-max WAND."""
        lists = [[self.postings[t][0][0], 0, t] for t in terms]  # current item, place, term
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // self.size
            if not live[block] or sum(float(self.block_most[x[2], block]) for x in lists[: pivot + 1]) < least - 1e-6:
                # no item up to the end of the block, or up to the next list's, can do it
                to = (block + 1) * self.size
                if live[block] and pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                lists = self.advance(lists, pivot + 1, max(to, item + 1))
            elif lists[0][0] == item:
                score = sum(self.postings[t][place][1] for i, place, t in lists[: pivot + 1])
                if score >= least - 1e-9:
                    found.append((item, score))
                lists = self.advance(lists, pivot + 1, item + 1)
            else:
                lists = self.advance(lists, pivot, item)
        return found

    def advance(self, lists: list[list[int]], count: int, to: int) -> list[list[int]]:
        """Moves the first lists to their first item that isn't before `to`; lists that end go."""
        for x in lists[:count]:
            p, at = self.postings[x[2]], x[1]
            while at < len(p) and p[at][0] < to:
                at += 1
            x[0], x[1] = (p[at][0], at) if at < len(p) else (END, at)
        return [x for x in lists if x[0] < END]

    def leaks(self, raw: bytes | None, least: float, overlap: float, share: float) -> dict[int, tuple[int, float, float, float]]:
        """By item: the first word of its best passage, the score, and the shares of the question's and the answer's shingles there."""
        words = words_of(raw)
        if not words or not self.items:
            return {}
        other, term, chunk = len(self.postings), self.term, self.longest
        terms = np.fromiter((term.get(w, other) for w in words), "i8", len(words))
        live = self.live(terms, chunk, least)
        out: dict[int, tuple[int, float, float, float]] = {}
        for p in np.flatnonzero(live.any(1)).tolist():
            part = words[p * chunk : (p + 2) * chunk]
            inside, had = None, set(part)
            for i, score in self.search(set(terms[p * chunk : (p + 2) * chunk].tolist()) - {other}, live[p], least):
                if inside is None:
                    inside = shingles(part)
                q, a = self.items[i].question, self.items[i].answer
                of_q = len(q & inside) / len(q) if len(part) >= SHINGLE or len(q) == 1 else 0.0
                of_a = len(a & inside) / len(a) if a else of_q
                if len(next(iter(q))) < SHINGLE:  # a short item: its words in a row anywhere
                    k = next(iter(q))
                    of_q = of_a = float(any(tuple(part[j : j + len(k)]) == k for j in range(len(part) - len(k) + 1)))
                enough = min(of_q, of_a) >= overlap
                if not enough and len(next(iter(q))) == SHINGLE:
                    every, ending = q | a | self.items[i].across, self.items[i].ending
                    enough = len(every & inside) >= share * len(every) and len(ending & had) >= share * len(ending)
                if enough and score > out.get(i, (0, 0.0))[1]:
                    out[i] = (p * chunk, score, of_q, of_a)
        return out


#: Items of up to so many words, four times as many, and so on, are classes.
SHORTEST = 64


def by_length(rows: list[tuple[object, str | None]], whole: Whole | None = None) -> list[Index]:
    """An index for each class of items by length, with the figures of all."""
    sizes = [len(words_of((t or "").encode())) for _, t in rows]
    if whole is None:
        whole = Whole(Counter(w for _, t in rows for w in set(words_of((t or "").encode()))), sum(n > 0 for n in sizes), sum(sizes) / max(1, sum(n > 0 for n in sizes)))
    of = [0 if n <= SHORTEST else math.ceil(math.log(n / SHORTEST, 4) - 1e-9) for n in sizes]
    return [Index([r for r, k in zip(rows, of) if k == c], whole=whole) for c in sorted(set(of))]


def term_counts(rows: DataFrame, text: str) -> DataFrame:
    """(word, n, total): in how many items each word occurs; without a word, items that have words, and their words."""
    names = ["word", "n", "total"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [w for raw in raw_texts(batch, text) if (w := words_of(raw))]
            df = Counter(t for w in found for t in set(w))
            columns = [[None, *df], [len(found), *df.values()], [sum(map(len, found))] + [0] * len(df)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.binary()) for k, c in enumerate(columns)], names)

    counts = rows.mapInArrow(run, "word binary, n long, total long")
    return keep(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "terms")


def indexes(benchmark: DataFrame, item: str, text: str, slice_items: int, slice_bytes: int) -> Iterator[tuple[list[Index], bool]]:
    """The indexes of each slice, and whether it is the only one; a benchmark that fits one slice is read once."""
    spark = benchmark.sparkSession
    rows = benchmark.select(item, text).where(F.col(text).isNotNull())
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = max(1, -(-n // slice_items), -(-size // slice_bytes))
    if parts > 1:
        counts = term_counts(rows, text)
        all_ = counts.where("word is null").first()
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(item, text), F.lit(parts)) == k)
        found = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        own = {w for _, t in found for w in words_of(t.encode())}
        if own and parts == 1:
            yield by_length(found), True
        elif own:
            df = counts.join(spark.createDataFrame([(w,) for w in own], "word binary"), "word").select("word", "n").collect()
            yield by_length(found, Whole({bytes(r["word"]): r["n"] for r in df}, all_["n"], all_["total"] / all_["n"])), False


def scan(documents: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.8, share: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slice_items: int = 20_000, slice_bytes: int = 20_000_000) -> DataFrame:
    """A row (key, item, first_word, score, question_overlap, answer_overlap) for each leak of an item into a document."""
    kinds = [(key, documents.schema[key].dataType.simpleString()), (item, benchmark.schema[item].dataType.simpleString())]
    schema = f"`{key}` {kinds[0][1]}, `{item}` {kinds[1][1]}, first_word long, score double, question_overlap double, answer_overlap double"
    spark, out = documents.sparkSession, None
    for found, only in indexes(benchmark, item, item_text, slice_items, slice_bytes):
        sent = spark.sparkContext.broadcast(found)  # bounded by slice_items and slice_bytes

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                rows = [(n, ix.items[i].key, *x) for n, raw in enumerate(raw_texts(batch, text)) for ix in sent.value for i, x in ix.leaks(raw, least, overlap, share).items()]
                if rows:
                    take, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(take)), *[pa.array(x) for x in rest]], [key, item, "first_word", "score", "question_overlap", "answer_overlap"])

        part = documents.select(key, text).mapInArrow(run, schema)
        if not only:
            part = keep(part, "leaks")
            sent.destroy()  # one slice at a time
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.8, share: float = 0.5, text: str = "text", item: str = "item_id", item_text: str = "text", slice_items: int = 20_000, slice_bytes: int = 20_000_000) -> DataFrame:
    """The documents without those that any item leaked into."""
    schema = documents.schema
    for found, only in indexes(benchmark, item, item_text, slice_items, slice_bytes):
        sent = documents.sparkSession.sparkContext.broadcast(found)  # bounded by slice_items and slice_bytes

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                yield batch.filter(pa.array([not any(ix.leaks(raw, least, overlap, share) for ix in sent.value) for raw in raw_texts(batch, text)], pa.bool_()))

        documents = documents.mapInArrow(run, schema)
        if not only:
            documents = keep(documents, "clean")
            sent.destroy()  # one slice at a time
    return documents
