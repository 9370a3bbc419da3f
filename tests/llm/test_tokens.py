"""Packing, token files and the word cache against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscle.llm import packing, store, tokenfile, words

PATH = public_tokenizers.path("word_bpe_49k.json")
T = Tokenizer.from_file(PATH)
TEXTS = [None, "", "Hello, world. ", "naïve Ünïted 漢字 don't 1234!!", "word " * 3000, "dup", "dup", "\x1c\x85 odd\u00a0space", "x" * 9000, "end<|endoftext|>Of <|startoftext|>text <|ENDOFTEXT|>"]


def ids_of(text):
    return T.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*"aBé.,'s \n\t\x1c\u00a0ſİß漢1", "<|endoftext|>", "<|startoftext|>", "<|"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_word_cache(text):
    assert np.frombuffer(words.word_bpe(PATH).ids(text.encode()), "<u4").tolist() == ids_of(text)


def test_cache_forgets():
    small = words.WordIds(lambda new, _: [w.upper() for w in new], most=3)
    for text in (b"a b c", b"c d e f g", b"a a h", b"", None):
        assert small.ids(text) == (text or b"").replace(b" ", b"").upper()


def test_packing(spark):
    out = packing.pack(frame(spark, TEXTS * 3, ids=list(range(len(TEXTS))) * 3), PATH, capacity=512, end_id=1).collect()
    by_doc = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) // 4 <= 512 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["start"] == 512 * r["piece"]
        by_doc[r["doc_id"], r["piece"]].append(r["ids"])
    for i, t in enumerate(TEXTS):
        ids = ids_of(t) + [1]
        for k in range(0, len(ids), 512):
            assert by_doc.pop((i, k // 512)) == [np.array(ids[k : k + 512], "<u4").tobytes()] * 3
    assert not by_doc
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.1 * sum(r["length"] for r in out) / 512 + 1


def test_packing_small_blocks(spark):
    sizes = spark.createDataFrame([(i, 1 + i * 37 % 99) for i in range(300)], "_row long, length long")
    out = packing.assignments(sizes, 100, block=40, islands=3, epochs=3).collect()
    assert sorted(r["_row"] for r in out) == list(range(300))
    assert packing.assignments(sizes.limit(0), 100).count() == 0
    assert packing.pack(frame(spark, ["a"]).limit(0), PATH).count() == 0


def test_crossover_wins(spark):
    """Triples of a whole sequence, none of which best fit finds: crossover and migration save a sequence of each eight."""
    import random

    rng = random.Random(0)
    sizes = []
    for _ in range(8):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    table = spark.createDataFrame(list(enumerate(sizes)), "_row long, length long")
    count = lambda **how: packing.assignments(table, 1000, **how).select("round", "block", "bin").distinct().count()
    fit = len(packing.disturbed(sizes, 1000, rng, 0.0))
    assert count(islands=1, population=1, epochs=1) == fit == 10
    assert count(islands=3, population=10, epochs=5, generations=60, rounds=1) < fit


def test_rounds_pool_what_blocks_leave(spark):
    """Blocks of 20 small pieces leave an ill-filled sequence each; pooled, the whole is at its lower bound."""
    import random

    rng = random.Random(5)
    sizes = [rng.randint(1, 60) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(sizes)), "_row long, length long")
    least = -(-sum(sizes) // 100)
    one, more = (packing.assignments(table, 100, block=20, rounds=n).select("round", "block", "bin").distinct().count() for n in (1, 6))
    assert least <= more <= least + 1 < one
    out = packing.assignments(table, 100, block=20, rounds=6).collect()
    assert sorted(r["_row"] for r in out) == list(range(400))


def test_crossover_keeps_items():
    import random

    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    a, b = packing.disturbed(sizes, 100, rng, 0.0), packing.disturbed(sizes, 100, rng, 0.5)
    child = packing.crossover(sizes, a, b, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 100 for x in child)
    best = packing.evolve(sizes, [a, b], 100, rng, 20)[0]
    assert len(best) <= min(len(a), len(b))
    assert packing.from_bytes(packing.as_bytes([best], 200), 200)[0] == [sorted(x) for x in best]


@pytest.mark.parametrize("counts", [[1], [1, 1], [5, 1, 1, 1], list(range(1, 3000)), [2**i for i in range(30)]])
def test_code_lengths(counts):
    lengths = tokenfile.code_lengths(np.array(counts))
    assert (2.0**-lengths).sum() <= 1 + 1e-12 and lengths.max() <= 16
    if len(counts) > 1:
        assert (2.0**-lengths).sum() == pytest.approx(1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000))
def test_codes_round_trip(ids):
    a = np.array(ids, "u4")
    found, n = np.unique(a, return_counts=True)
    codes = tokenfile.Codes(found.astype("i8"), tokenfile.code_lengths(n))
    check, payload = codes.encode(a)
    assert codes.decode(check, payload, len(a)).tolist() == ids


def test_token_files(spark):
    path = store.place(spark, "test-store")
    tokenfile.write(frame(spark, TEXTS, ids=[9, 3, 4, 5, 1, 2, 2, None, 0, 8]), path, PATH, end_id=2)
    out = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, 0, 1, 2, 2, 3, 4, 5, 8, 9]
    text = {9: None, 3: "", 4: TEXTS[2], 5: TEXTS[3], 1: TEXTS[4], 2: "dup", None: TEXTS[7], 0: TEXTS[8], 8: TEXTS[9]}
    at = 0
    for r in out:
        ids = ids_of(text[r["doc_id"]]) + [2]
        assert r["start"] == at and r["n_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)


def test_empty_token_file(spark):
    path = store.place(spark, "empty-store")
    tokenfile.write(frame(spark, ["a"]).limit(0), path, PATH)
    assert tokenfile.read(spark, path).count() == 0
