"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is the multiset of its shingles of five lower-cased words. Each distinct shingle sends out points of a Poisson process whose
rate is its count; a point falls on a random register, which keeps the shingle of its earliest point, and a shingle stops once its next
point comes later than all registers hold. Two documents agree in a register with the probability Jaccard similarity of their shingles.
Documents with an equal band of registers are candidates; whether they are links is decided by the exact similarity.

Equal texts are one node from the start, so that thousands of copies cost as much as one. Within a bucket a star is verified, not all
pairs, around the node that shares most buckets; classes of what is linked so far are then found. What is left are nodes of buckets that
still hold several classes, such as texts with the same boilerplate. Of these, nodes go on that share one of their rarest shingles
with a node of another class, which loses nothing. If common shingles hold the shares a and b of two texts, their similarity s is at
most 1 / (1/a + 1/b - 1): each term of it is at most pq / (p + q - pq') for shares p, q and what is not common, and such terms add
up to no more than that of their sums. So a and b are s or more, and one of them is 2s / (1 + s) or more. The rarest common shingle is
then among the rarest of either text that hold more than 1 - s of it, and for one text among those that hold more than
1 - 2s / (1 + s). Boilerplate is frequent and isn't among these. The pairs of classes in what is left of a bucket are compared by their
registers, in chunks, and verified unless those rule them out by five standard deviations.

Edge cases: a text of one to four words is one shingle. An empty text is alike only to empty texts, white space only to equal texts, and
a null text to nothing. Texts of any length are taken whole. Keys may repeat and be null: rows are told apart by their place in the
written table; of a class the row that was written first stays. Columns that clash with internal ones are set aside and given back. An
empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import BASE, U, mixed, word_hashes
from .store import keep
from .words import forget, raw_texts, slices

WORDS, ROWS, BANDS, LEAST = 5, 7, 30, 0.8
STARS = 1
#: Nodes of a bucket that are compared with each other in one group.
CHUNK = 1024
#: Registers by which they are compared; six times those of the bands, so that few pairs are left to be verified.
REGISTERS = 6 * ROWS * BANDS


def bag(raw: bytes | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as sorted hashes, and how often each occurs."""
    w = word_hashes(raw or b"")
    if not len(w):
        return w, np.zeros(0, "i4")
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, "u8")
    for i in range(k):
        h = mixed(h * U(BASE) + w[i : len(w) - k + 1 + i])
    found, n = np.unique(h, return_counts=True)
    return found, n.astype("i4")


def signature(h: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The shingle in each of m registers."""
    if len(h) == 1:
        return np.full(m, h[0], "u8")
    first, held = np.full(m, np.inf), np.zeros(m, "u8")
    at, done = np.zeros(len(h)), 0
    rate = counts.astype("f8")
    while len(h):
        block = max(1, min(64, 2 * m // len(h)))
        n = np.arange(done, done + block, dtype="u8")
        z = mixed(h[:, None] + (n * U(2) + U(1))[None, :] * U(0xD1342543DE82EF95))
        gap = -np.log1p(-((z >> U(11)).astype("f8") * 2.0**-53)) / rate[:, None]
        time = at[:, None] + np.cumsum(gap, axis=1)
        register = (mixed(z + U(BASE)) % U(m)).astype("i8").ravel()
        flat = time.ravel()
        np.minimum.at(first, register, flat)
        won = first[register] == flat
        held[register[won]] = np.repeat(h, block)[won]
        live = time[:, -1] < first.max()
        h, rate, at, done = h[live], rate[live], time[live, -1], done + block
    return held


def band_hashes(raw: bytes | None, words: int, rows: int, bands: int) -> list[int]:
    h, n = bag(raw, words)
    if not len(h):
        return []
    held = signature(h, n, rows * bands).reshape(bands, rows)
    out = np.arange(bands, dtype="u8")
    for i in range(rows):
        out = mixed(out * U(BASE) + held[:, i])
    return out.astype("i8").tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two bags: the sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = a[1][i] / a[1].sum(), b[1][j] / b[1].sum()
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    last = np.searchsorted(ratio, ratio, "right")  # all of the same ratio count with a
    left = np.r_[0, np.cumsum(p)][last] + (1 - p.sum())
    right = q.sum() - np.r_[0, np.cumsum(q)][last] + (1 - q.sum())
    return float((1 / (left / p + right / q)).sum())


def signed(documents: DataFrame, text: str, words: int, rows: int, bands: int) -> DataFrame:
    """The documents with _bands, _node (a digest of the text) and _row, in the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker may have run other operators before
        for batch in slices(batches, text):
            found = [band_hashes(raw, words, rows, bands) for raw in raw_texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "_bands"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return keep(documents.mapInArrow(run, own + ", _bands array<long>").withColumns({"_node": F.unhex(F.md5(text)), "_row": F.monotonically_increasing_id()}), "signed")


def bags(texts: DataFrame, words: int) -> DataFrame:
    """Rows (id, h, n) for rows (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [bag(raw, words) for raw in raw_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["id", "h", "n"])

    return keep(texts.mapInArrow(run, "id long, h binary, n binary"), "bags")


def verified(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is `least` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(batch, side):
            return [(np.frombuffer(h.as_buffer(), "u8"), np.frombuffer(n.as_buffer(), "i4")) for h, n in zip(batch.column(f"h{side}"), batch.column(f"n{side}"))]

        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array([similarity(x, y) >= least - 1e-12 for x, y in zip(load(batch, "a"), load(batch, "b"))], pa.bool_()))

    side = lambda s: known.select(F.col("id").alias(s), F.col("h").alias(f"h{s}"), F.col("n").alias(f"n{s}"))
    return keep(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "na", "hb", "nb").mapInArrow(run, "a long, b long"), "links")


def rarest(known: DataFrame, least: float) -> DataFrame:
    """Rows (group, id, first) for bags (id, h, n): each bag's rarest shingles, up to more than 1 - least of its size, as far as others have them.

    first: among those that hold more than 1 - 2 least / (1 + least). Groups without any of these are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, n = np.frombuffer(batch.column("h")[k].as_buffer(), "i8"), np.frombuffer(batch.column("n")[k].as_buffer(), "i4")
                for at in range(0, len(h), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), batch.column("id")[k].as_py())), pa.array(h[part]), pa.array(n[part] / n.sum())], ["id", "group", "share"])

    each = keep(known.mapInArrow(run, "id long, group long, share double"), "shingles")
    often = each.groupBy("group").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("id").orderBy("df", "group").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(often, "group", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    before = F.coalesce(F.sum("share").over(order), F.lit(0.0))
    first = F.col("before") <= 1 - 2 * least / (1 + least) + 1e-9
    rows = keep(ranked.withColumn("before", before).where((F.col("before") <= 1 - least + 1e-9) & (F.col("df") > 1)).select("group", "id", first.alias("first")), "rarest")
    return rows.join(rows.where("first").select("group").distinct(), "group", "left_semi")


def promising(shared: DataFrame, known: DataFrame, m: int, least: float) -> DataFrame:
    """Pairs (a, b) of different labels in a group whose registers agree as often as those of links do, but for one in 3,000,000.

    A group is cut into chunks of about `CHUNK` nodes, and each two chunks meet in a task's group of their own, so that none grows with the
    group. Registers are compared by a byte of each; what they can't rule out goes on to be verified.
    """
    sure = least - 5 * (least * (1 - least) / m) ** 0.5

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(np.frombuffer(h.as_buffer(), "u8"), np.frombuffer(n.as_buffer(), "i4"), m).astype("u1").tobytes() for h, n in zip(batch.column("h"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "registers"])

    def compare(group: pa.Table) -> pa.Table:
        ids, labels, chunks = (group.column(c).to_numpy() for c in ("id", "label", "chunk"))
        held = np.frombuffer(b"".join(group.column("registers").to_pylist()), "u1").reshape(-1, m)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(chunks == lo), np.flatnonzero(chunks == hi)
        a, b = [], []
        for i in left.tolist():
            near = (held[right] == held[i]).sum(1) >= sure * m
            near &= labels[right] != labels[i]
            if lo == hi:
                near &= ids[right] > ids[i]
            j = right[near]
            a.append(np.minimum(ids[j], ids[i]))
            b.append(np.maximum(ids[j], ids[i]))
        none = np.zeros(0, "i8")
        return pa.table([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    some = keep(shared.select("id").distinct(), "open-nodes")
    registers = keep(known.join(some, "id", "left_semi").mapInArrow(sign, "id long, registers binary"), "registers")
    chunks = F.ceil(F.col("n") / CHUNK)
    rows = shared.select("group", "id", "label", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), chunks.cast("int").alias("chunks")).join(registers, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = rows.select("group", "id", "label", "chunk", "registers", other.alias("other")).withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    return met.select("group", "id", "label", "chunk", "registers", "lo", "hi").groupBy("group", "lo", "hi").applyInArrow(compare, "a long, b long")


def open_groups(shared: DataFrame) -> DataFrame:
    """The rows (group, id, label) of groups with several labels, with the number of nodes of the group."""
    span = shared.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return keep(shared.join(keep(span.select("group", "n"), "spans"), "group"), "open")


def components(links: DataFrame) -> DataFrame:
    """Rows (id, label) for every id in the links (a, b): ids have equal labels if links join them.

    In each round a node goes to the neighbour (or itself) of least hash, and the graph is contracted by that; rounds end when no link
    is left. Hashes change from round to round, so that a long chain shrinks by a share of its length each time.
    """
    hooks, rest = [], links
    while True:
        number = len(hooks)
        both = rest.union(rest.select("b", "a"))
        order = lambda c: F.xxhash64(c, F.lit(number))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min_by("b", F.struct(order("b"), F.col("b"))).alias("b"))
        goes = F.when(F.struct(order("b"), F.col("b")) < F.struct(order("a"), F.col("a")), F.col("b")).otherwise(F.col("a"))
        to = keep(near.select(F.col("a").alias("id"), goes.alias("to")), "hooks")
        hooks.append(to)
        a, b = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = rest.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        rest = keep(moved, "contracted")
        if rest.isEmpty():
            break
    labels = hooks[0].withColumnRenamed("to", "label")
    for to in hooks[1:]:
        labels = labels.join(to.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return keep(labels, "labels")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """The documents' table with _node and _row, and a table (_node, label, first_row, first_key) of its distinct texts.

    Nodes with the same label are one class; first_row and first_key are the least of the whole class. Rows with null text have no node.
    """
    table = signed(documents, text, words, rows, bands)
    nodes = table.where(F.col("_node").isNotNull()).groupBy("_node", "_bands").agg(F.min("_row").alias("row"), F.min(key).alias("key"))
    nodes = keep(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("id", F.explode("_bands").alias("group"))
    full = keep(members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = keep(members.join(full, "group"), "shared")
    weight = keep(shared.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    shared = shared.select("group", "id").join(weight, "id").withColumn("label", F.col("id"))
    involved = weight.select("id").join(nodes.select("id", F.col("row").alias("_row")), "id")
    known = bags(table.select("_row", F.col(text).alias("text")).join(involved, "_row").select("id", "text"), words)
    links = labels = None
    for star in range(STARS + 1):
        shared = open_groups(shared)
        if shared.isEmpty():
            break
        if star < STARS:
            # first around the nodes that share most buckets, which are close to the middle of their group
            order = F.struct(F.col("weight") if star == 0 else F.xxhash64("id", F.lit(star)), F.col("id"), F.col("label"))
            hubs = keep(shared.groupBy("group").agg(F.max(order).alias("hub")).select("group", F.col("hub")["id"].alias("x"), F.col("hub")["label"].alias("of")), "hubs")
            pairs = shared.join(hubs, "group").where("label <> of").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
        else:
            # only nodes that share a rare shingle with a node of another label can have a link
            left = keep(shared.groupBy("id").agg(F.first("label").alias("label")), "left")
            near = open_groups(rarest(known.join(left.select("id"), "id", "left_semi"), least).join(left, "id"))
            shared = open_groups(shared.drop("n").join(near.select("id").distinct(), "id", "left_semi"))
            if shared.isEmpty():
                break
            pairs = promising(shared, known, REGISTERS, least)
        found = verified(keep(pairs.distinct(), "pairs"), known, least)
        shared = shared.drop("n")
        links = found if links is None else keep(links.union(found), "links")
        if found.isEmpty():
            continue
        labels = components(links)
        shared = shared.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = nodes.select("_node", "id", "row", "key")
    own = own.withColumn("label", F.col("id")) if labels is None else own.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = keep(own, "labelled")
    firsts = keep(own.groupBy("label").agg(F.min("row").alias("first_row"), F.min("key").alias("first_key")), "firsts")
    return table, keep(own.select("_node", "label").join(firsts, "label"), "classes")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row (key, class_id) for each document: the least key of its class, or a negative number of the class's own if that has no key or another class has the same least key.

    A document with null text is a class of its own, named by its key. Keys are integers of 0 or more.
    """
    table, found = classes(documents.select(key, text), key, text, **how)
    holder = found.where("first_key is not null").groupBy("first_key").agg(F.min("label").alias("holder"))
    found = found.join(holder, "first_key", "left")
    name = F.when(F.col("label") == F.col("holder"), F.col("first_key")).otherwise(-1 - F.col("label"))
    return table.select(key, "_node").join(found, "_node", "left").select(key, F.when(F.col("_node").isNull(), F.col(key)).otherwise(name).alias("class_id"))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without all but the first row of each class; those with null text stay."""
    aside = {c: f"_given{i}" for i, c in enumerate(documents.columns) if c in ("_bands", "_node", "_row")}
    table, found = classes(documents.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in documents.columns]), key, text, **how)
    names = table.select("_row", "_node").join(found, "_node").where("_row <> first_row").select("_row")
    return table.join(keep(names, "copies"), "_row", "left_anti").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in documents.columns])
