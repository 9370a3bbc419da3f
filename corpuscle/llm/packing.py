"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised once and cut into pieces of at most `capacity` ids; full pieces are sequences of their own. The others are
dealt by hash to blocks of about `block` pieces. Several islands work on a block, each a row of a table with its population. Crossover
injects whole well-filled bins of one parent into the other, drops the bins that share a document with them, and puts the displaced
documents back by best fit, largest first. It goes on while a block has more than one bin that isn't full, since a few ill-filled bins
are what the block leaves to others. Between epochs each island takes in the elite of its neighbour, by a join; the best packing over
all islands of a block wins. Full bins are then settled. The pieces of all others, a small share of the pieces, are pooled and
dealt to new blocks, as often as that saves sequences, until the whole is at its lower bound or `rounds` are over. A round that
saves nothing is dropped. The search is seeded, so that equal tables give equal packings.

Edge cases: a null or empty text is one piece of the end id alone. Repeated rows and null ids are packed as rows of their own. A text of
any length is tokenised whole and cut. Pieces of equal length are ordered by the row's number. Columns other than key and text are
ignored, so that their names can't clash. An empty table gives no pieces.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep
from .words import raw_texts, slices, word_bpe

Packing = list[list[int]]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids, ids_crc32), ids as little-endian unsigned 32-bit integers; the last id of a document is end_id."""
    kind = documents.schema[key].dataType.simpleString()
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in slices(batches, text):
            keys, rows = batch.column(key), []
            for i, raw in enumerate(raw_texts(batch, text)):
                ids = bpe.ids(raw) + end
                rows += [(i, k, ids[at : at + step]) for k, at in enumerate(range(0, len(ids), step))]
            take, nth, blobs = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(take)), pa.array(nth, pa.int32()), pa.array([capacity * k for k in nth], pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(blobs, pa.binary()), pa.array([zlib.crc32(b) for b in blobs], pa.int64())],
                [key, "piece", "start", "length", "ids", "ids_crc32"],
            )

    return documents.select(key, text).mapInArrow(cut, f"{key} {kind}, piece int, start long, length long, ids binary, ids_crc32 long")


def best_fit(sizes: list[int], items: Iterable[int], bins: Packing, capacity: int) -> Packing:
    """Puts items, in their order, each into the fullest bin with room for it, else into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return bins


def fitness(sizes: list[int], bins: Packing, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], a: Packing, b: Packing, capacity: int, rng: random.Random, full: float = 0.995) -> Packing:
    """Whole well-filled bins of b into a."""
    good = [x for x in b if sum(sizes[i] for i in x) >= full * capacity]
    injected = rng.sample(good, max(1, len(good) // 3)) if good else []
    inside = {i for x in injected for i in x}
    stay, displaced = [list(x) for x in injected], []
    for x in a:
        if inside.isdisjoint(x) and sum(sizes[i] for i in x) >= full * capacity:
            stay.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, displaced, stay, capacity)


def disturbed(sizes: list[int], capacity: int, rng: random.Random, share: float) -> Packing:
    """Best fit of the items by size, largest first, of which a share comes at random places: 0 is best-fit decreasing."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 + share * (rng.random() - 0.5)), i))
    return best_fit(sizes, order, [], capacity)


def evolve(sizes: list[int], population: list[Packing], capacity: int, rng: random.Random, generations: int) -> list[Packing]:
    """The population, best first, after so many crossovers, each of whose children takes the place of the worst if better.

    It ends early once all bins but one are full, than which nothing is better.
    """
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(generations):
        if len(ranked) < 2 or sum(sum(sizes[i] for i in b) < capacity for b in ranked[0][2]) < 2:
            break
        a, b = rng.sample(ranked, 2)
        child = crossover(sizes, a[2], b[2], capacity, rng)
        score = fitness(sizes, child, capacity)
        if score > ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked[-1] = (score, len(population) + g, child)
            ranked.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [r[2] for r in ranked]


def as_bytes(population: list[Packing], n: int) -> bytes:
    """The bin of each item, by packing."""
    out = np.zeros((len(population), n), "<i4")
    for row, bins in zip(out, population):
        for k, b in enumerate(bins):
            row[b] = k
    return out.tobytes()


def from_bytes(raw: bytes, n: int) -> list[Packing]:
    out = []
    for row in np.frombuffer(raw, "<i4").reshape(-1, n).tolist() if n else []:
        bins: Packing = [[] for _ in range(max(row) + 1)]
        for i, k in enumerate(row):
            bins[k].append(i)
        out.append(bins)
    return out


def packed_blocks(sizes: DataFrame, capacity: int, block: int, islands: int, population: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """One round: rows (_row, length, block, bin, offset, fill) for a table (_row, length); fill is the length of all in the bin."""
    blocks = max(1, -(-sizes.count() // block))
    dealt = sizes.groupBy(F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_row", "length"))).alias("items"))  # about `block` items each
    dealt = dealt.select("block", F.col("items")["_row"].alias("rows"), F.col("items")["length"].alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    schema = "block long, island int, rows array<long>, sizes array<long>, population binary, elite binary, bins int, fill double"

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    rng = random.Random(f"{seed} {number} {r['block']} {r['island']}")
                    s = r["sizes"]
                    if number:
                        live = from_bytes(r["population"], len(s))[: population - 1] + from_bytes(r["elite"], len(s))
                    else:
                        live = [disturbed(s, capacity, rng, 0.0 if not k and not r["island"] else 0.1 * (k + r["island"])) for k in range(population)]
                    live = evolve(s, live, capacity, rng, generations)
                    score = fitness(s, live[0], capacity)
                    out.append({k: r[k] for k in ("block", "island", "rows", "sizes")} | {"population": as_bytes(live, len(s)), "elite": as_bytes(live[:1], len(s)), "bins": -score[0], "fill": score[1]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        arrow = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("population", pa.binary()), ("elite", pa.binary()), ("bins", pa.int32()), ("fill", pa.float64())])
        return run

    live = keep(dealt.mapInArrow(epoch(0), schema), "islands")
    for number in range(1, epochs):
        elites = live.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "elite")
        live = keep(live.drop("elite").join(elites, ["block", "island"]).mapInArrow(epoch(number), schema), "islands")
    best = live.groupBy("block").agg(F.max_by(F.struct("rows", "sizes", "elite"), F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))).alias("best")).select("block", "best.*")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins = np.frombuffer(r["elite"], "<i4")
                sizes, rows = np.array(r["sizes"]), np.array(r["rows"])
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                starts = ends - sizes[order]
                first = np.r_[True, np.diff(bins[order]) > 0]
                base = np.maximum.accumulate(np.where(first, starts, 0))
                fill = np.bincount(bins, sizes)[bins[order]].astype("i8")
                columns = [rows[order], sizes[order], np.full(len(rows), r["block"]), bins[order].astype("i8"), starts - base, fill]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_row", "length", "block", "bin", "offset", "fill"])

    return keep(best.mapInArrow(place, "_row long, length long, block long, bin long, offset long, fill long"), "packed")


def assignments(sizes: DataFrame, capacity: int = 4096, block: int = 2048, islands: int = 3, population: int = 4, epochs: int = 2, generations: int = 6, rounds: int = 5, seed: int = 7) -> DataFrame:
    """Rows (_row, round, block, bin, offset) for a table (_row, length), whose lengths are from 1 to capacity and whose _row are unique."""
    first = F.col("offset") == 0
    counts = [F.count_if(first), F.count_if(first & (F.col("fill") == capacity))]
    pool, settled, given = sizes.select("_row", "length"), None, None  # given: the pool as the round before left it, and its bins
    for number in range(rounds):
        found = packed_blocks(pool, capacity, block, islands, population, epochs, generations, seed + number).withColumn("round", F.lit(number))
        total, count, full = found.agg(F.coalesce(F.sum("length"), F.lit(0)), *counts).first()
        if given is not None and count >= given[1]:
            break  # nothing saved: the round before stays
        full_ones = found.where(F.col("fill") == capacity)
        settled = full_ones if settled is None else settled.union(full_ones)
        given = found.where(F.col("fill") < capacity), count - full
        if given[1] <= -(-(total - full * capacity) // capacity) or given[1] < 2:
            break  # at the lower bound
        pool = given[0].select("_row", "length")
    out = given[0] if settled is None else settled.union(given[0])
    return out.select("_row", "round", "block", "bin", "offset")


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", **search) -> DataFrame:
    """The pieces of all documents (as from pieces()) with sequence_id and offset; ids of a sequence follow each other without gaps.

    Only lengths take part in the search; ids stay in the table of pieces and are joined at the end, if they are asked for at all.
    """
    table = keep(pieces(documents, tokenizer, capacity, end_id, key, text).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    open_ = F.col("length") < capacity
    placed = assignments(table.where(open_).select("_row", "length"), capacity, **search)
    number = (F.col("block") * F.lit(1 << 20) + F.col("bin")) * 16 + F.col("round") * 2  # even; those of full pieces are odd
    placed = keep(placed.select("_row", number.alias("sequence_id"), "offset"), "placed")
    own = placed.unionByName(table.where(~open_).select("_row", (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return table.join(own, "_row").drop("_row")
