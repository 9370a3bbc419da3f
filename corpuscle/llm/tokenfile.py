"""A binary format of token ids: canonical Huffman codes of limited length, in blocks that are decoded on their own.

A store is a folder with two tables. `codebook` has a row (id, length) for each id that occurs; the codes are canonical, by length and
then id, and no longer than 16 bits where there are at most 65,536 ids. `segments` has rows of up to about a million ids of
consecutive documents: `first` (orders the segments), the documents' keys and numbers of ids, `checkpoints` (where each block of
`BLOCK` ids begins, in bits, as little-endian 64-bit integers) and `payload` (the codes, high bits first, in big-endian 32-bit words). A
reader decodes all blocks of a segment side by side, a table look-up and an array operation for the n-th id of each.

Edge cases: a null or empty text is the end id alone. Null keys come first; rows with equal keys are all written, in no set order. An
empty table gives a store without segments and codes. Texts of any length are encoded whole; a document of more ids than a segment is a
segment of its own. Only key and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep
from .words import raw_texts, slices, word_bpe

BLOCK, SEGMENT = 512, 1 << 20


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Lengths of an optimal prefix code of at most so many bits (or as many as needed), by package-merge. counts are positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, "i8")
    most = max(most, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype("f8")
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    lengths, take = np.zeros(n, "i8"), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, "i8")
    out[order] = lengths
    return out


class Codes:
    """Canonical codes for ids and their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, "i8")[order], np.asarray(lengths, "i8")[order]
        self.bits = int(self.lengths.max(initial=1))
        span = 1 << (self.bits - self.lengths)
        first = np.cumsum(span) - span
        size = int(self.ids.max(initial=0)) + 1
        self.code = np.zeros(size, "u4")  # a code and, in the last byte, its length
        self.code[self.ids] = (first >> (self.bits - self.lengths)) << 8 | self.lengths
        self.symbol = np.zeros(1 << self.bits, "u4")
        self.step = np.ones(1 << self.bits, "i8")
        used = int(span.sum())
        self.symbol[:used], self.step[:used] = np.repeat(self.ids, span), np.repeat(self.lengths, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Checkpoints and payload."""
        if not len(ids):
            return b"", bytes(8)
        kind = "i4" if len(ids) < 1 << 26 else "i8"
        code = self.code[ids]
        lengths = (code & 255).astype(kind)
        ends = np.cumsum(lengths, dtype=kind)
        starts = ends - lengths
        word = starts >> 5
        value = (code >> 8).astype("u8") << (64 - (starts & 31) - lengths).astype("u8")
        # codes don't overlap, so the bits of a word are the sum of its codes' parts; each word has a code that begins in it, but the last
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        at = word[first]
        words = np.zeros((int(ends[-1]) + 31 >> 5) + 2, "u8")
        words[at] += np.add.reduceat(value >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return starts[::BLOCK].astype("<i8").tobytes(), words.astype(">u4").tobytes()

    def decode(self, checkpoints: bytes, payload: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(checkpoints, "<i8").copy()
        words = np.frombuffer(payload, ">u4").astype("u8")
        out = np.zeros((BLOCK, len(at)), "u4")
        right = np.uint64(64 - self.bits)
        for k in range(min(BLOCK, n)):
            live = len(at) if len(at) * BLOCK == n or k < n - (len(at) - 1) * BLOCK else len(at) - 1  # the last block may end before
            here = at[:live]
            i = here >> 5
            window = (words[i] << np.uint64(32) | words[i + 1]) << (here & 31).astype("u8") >> right
            window = window.astype("i8")
            out[k, :live] = self.symbol[window]
            here += self.step[window]
        return out.T.reshape(-1)[:n]


def encode_texts(documents: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """Rows (key, ids, counts) in the same order, counts null; each task ends with a row that has only counts: ids that occurred and how often, as 64-bit integers."""
    kind, end = documents.schema[key].dataType.simpleString(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total, keys = word_bpe(tokenizer), np.zeros(1, "i8"), None
        for batch in slices(batches, text):
            found, keys = [bpe.ids(raw) + end for raw in raw_texts(batch, text)], batch.column(key)
            c = np.bincount(np.frombuffer(b"".join(found), "<u4"), minlength=len(total))
            c[: len(total)] += total
            total = c
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], [key, "ids", "counts"])
        if keys is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, keys.type), pa.nulls(1, pa.binary()), pa.array([np.r_[at, total[at]].astype("<i8").tobytes()], pa.binary())], [key, "ids", "counts"])

    return documents.mapInArrow(run, f"{key} {kind}, ids binary, counts binary")


def global_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and how often, summed over the tasks' rows; bounded by the vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, "i8")
        for batch in batches:
            for raw in batch.column("counts"):
                at, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
                total = np.pad(total, (0, max(0, int(at[-1]) + 1 - len(total))))
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    return rows["id"].to_numpy("i8"), rows["n"].to_numpy("i8")


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Writes all documents, in ascending order of the key, to a new store."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema[key].dataType.simpleString()
    order = [F.col(key).asc_nulls_first(), F.col("_tie")]
    dealt = documents.select(key, text, F.rand(23).alias("_tie")).repartitionByRange(n, *order).sortWithinPartitions(*order)  # the random column deals out a frequent key
    table = keep(encode_texts(dealt.drop("_tie"), tokenizer, end_id, key, text).withColumn("_pos", F.monotonically_increasing_id()), "tokens")
    ids, counts = global_counts(table.select("counts").where("counts is not null"))
    tokens = table.where("ids is not null").drop("counts")
    lengths = code_lengths(counts)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*book.value)
        for batch in batches:
            sizes, pos = [len(x.as_buffer()) // 4 for x in batch.column("ids")], batch.column("_pos").to_pylist()
            at = total = 0
            for i, x in enumerate([*sizes, SEGMENT]):
                if i > at and (total + x > SEGMENT or pos[i] != pos[i - 1] + 1):  # a batch may go on in another file
                    part = batch.slice(at, i - at)
                    check, payload = codes.encode(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in part.column("ids")]))
                    keys = pa.ListArray.from_arrays(pa.array([0, i - at], pa.int32()), part.column(key))
                    yield pa.RecordBatch.from_arrays([part.column("_pos").slice(0, 1), keys, pa.array([sizes[at:i]], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([check], pa.binary()), pa.array([payload], pa.binary())], ["first", "keys", "sizes", "n", "checkpoints", "payload"])
                    at, total = i, 0
                total += x

    schema = f"first long, keys array<{kind}>, sizes array<long>, n long, checkpoints binary, payload binary"
    tokens.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32, ids) of all documents of a store; start counts the ids of all before.

    ids are little-endian unsigned 32-bit integers, ids_crc32 their checksum; ids=False decodes and checks them but leaves them out.
    """
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    table = spark.sparkContext.broadcast((book["id"].to_numpy("i8"), book["length"].to_numpy("i8")))  # bounded by the vocabulary
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    # the high bits of `first` number the tasks that wrote the segments, in the order of the keys
    parts = segments.select("first", "n", F.shiftright("first", 33).alias("part"))
    totals = parts.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("first", "part", within.alias("within")).join(before, "part").select("first", (F.col("before") + F.col("within")).alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*table.value)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes = batch.column("keys")[i].values, np.array(batch.column("sizes")[i].as_py(), "i8")
                found = codes.decode(batch.column("checkpoints")[i].as_py(), batch.column("payload")[i].as_buffer(), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(found).cast("B")
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                columns = [keys, pa.array(ends - sizes + batch.column("start")[i].as_py()), pa.array(sizes), pa.array(checks, pa.int64())]
                if ids:
                    columns.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, 4 * ends].astype("i8")), pa.py_buffer(found)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    placed = segments.select("first", "keys", "sizes", "checkpoints", "payload").join(keep(starts, "starts"), "first")  # still compressed
    return placed.mapInArrow(run, f"{key} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
