"""Quality rules by the fertility of public tokenisers.

Each whole text is measured once: counts of its words, symbols, repeated lines and repeated three-word windows, and what two
vocabularies make of it: characters per token by either, the share of byte-fallback tokens and the entropy of its tokens (as a share of
the largest that so many tokens can have). Texts that fail the base rules are rejected. Of the others, each measure must lie in a band
around the median of the text's language, narrower for longer texts; languages with few texts take the band of their script, scripts
with few the band of all. Medians are over all texts that pass the base rules; a row for each language and task is shuffled for them.

Edge cases: a null or empty text has no words and fails the base rules. A null language is judged by script, the script of a text
without letters is "none". A measure that doesn't exist is in every band. Repeated rows are judged one by one, alike. Texts of
any length are measured whole, words of any length too (a text without white space is one word). Of scripts with equally many letters the
first of SCRIPTS counts. An empty table gives an empty one. For columns of the results' names see measure() and judge().
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .words import LOADED, WordIds, raw_texts, slices, word_bpe

SYMBOLS = b"#*$%&|<>"
MEASURES = ("piece_chars", "word_chars_per_token", "byte_share", "entropy")
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Hiragana", "Katakana", "Han")
LETTERS = regex.compile("|".join(rf"(?P<{s}>\p{{Script={s}}}+)" for s in SCRIPTS))
#: Ids of the byte-fallback pieces <0x00> to <0xFF>.
FIRST_BYTE, LAST_BYTE = 3, 258


#: Marks a number of a word's tokens by the second vocabulary among its ids by the first, which are all below. Larger numbers are sums of several.
COUNT = 1 << 15


def by_both(pieces: str, words_file: str) -> WordIds:
    """For each word, on its own, the ids of its pieces and after them marked numbers that add up to its tokens by the other vocabulary, as unsigned 16-bit integers."""
    if (pieces, words_file) not in LOADED:
        import sentencepiece

        model, other = sentencepiece.SentencePieceProcessor(model_file=pieces), word_bpe(words_file)
        if model.get_piece_size() > COUNT:
            raise ValueError(f"more than {COUNT} pieces")

        stems: dict[bytes, bytes] = {}

        def encode(words: list[bytes], _: dict[bytes, bytes]) -> list[bytes]:
            if len(stems) > 150_000:
                stems.clear()
            ids = model.encode([w.decode() for w in words], num_threads=1)
            numbers = [divmod(len(y) // 4, COUNT - 1) for y in other.encode(words, stems)]
            return [array("H", [*x, *[2 * COUNT - 1] * whole, COUNT | rest]).tobytes() for x, (whole, rest) in zip(ids, numbers)]

        LOADED[pieces, words_file] = WordIds(encode, 250_000)
    return LOADED[pieces, words_file]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def script_of(text: str) -> str:
    """The script that most letters of a text without white space are in, the first of SCRIPTS in a tie."""
    try:
        return "Latin" if any(map(str.isalpha, text.encode("latin-1").decode("latin-1"))) else "none"  # no other script's letters are there
    except UnicodeEncodeError:
        found = Counter()
        for part in LETTERS.finditer(text):
            found[part.lastgroup] += part.end() - part.start()
        return max(SCRIPTS, key=lambda s: found[s]) if found else "none"


def entropy_share(ids: np.ndarray) -> float | None:
    if len(ids) < 2:
        return None
    n = np.bincount(ids) if len(ids) > 8000 else np.unique(ids, return_counts=True)[1]
    p = n[n > 0] / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(min(len(ids), 32_000)))


def measure(documents: DataFrame, pieces: str, words_file: str, text: str = "text") -> DataFrame:
    """Adds the base counts, base_failed, script and the four measures to each document; columns of these names are replaced.

    Base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. piece_chars and word_chars_per_token are characters per token by
    a vocabulary with byte fallback and by one of lower-cased words.
    """
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("script", pa.string()), *[(m, pa.float64()) for m in MEASURES]]
    documents = documents.drop(*[f for f, _ in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = by_both(pieces, words_file)
        for batch in slices(batches, text):
            rows = []
            for raw in raw_texts(batch, text):
                raw = raw or b""
                words = raw.split()
                joined = b"".join(words).decode()
                ids = np.frombuffer(both.ids(raw), "<u2")
                counts = ids >= COUNT
                n_word_tokens, ids = int((ids[counts] - COUNT).sum(dtype="i8")), ids[~counts]
                lines = [x for x in raw.split(b"\n") if x.strip()]
                rows.append((
                    len(words), len(joined), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
                    script_of(joined),
                    len(joined) / len(ids) if len(ids) else None, len(joined) / n_word_tokens if n_word_tokens else None,
                    float(((ids >= FIRST_BYTE) & (ids <= LAST_BYTE)).mean()) if len(ids) else None, entropy_share(ids),
                ))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), fields)]], [*batch.schema.names, *[f for f, _ in fields]])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    out = documents.mapInArrow(run, own + "".join(f", {f} {kinds[k]}" for f, k in fields))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def by_length(m: str) -> Column:
    """What a deviation is multiplied by to be comparable between lengths: a mean over words spreads as one by the root of their number."""
    return F.lit(1.0) if m == "entropy" else F.sqrt(F.col("n_words").cast("double"))


def bands(measured: DataFrame, lang: str, least: int) -> DataFrame:
    """Rows (group, n, and mid and scale of each measure): the median, and the quartiles' distance from it, both ways, as a normal deviation.

    Groups are "lang:...", "script:..." and "all"; those with fewer than `least` texts are left out, but for "all".
    """
    groups = F.array_compact(F.array(F.concat(F.lit("lang:"), F.col(lang)), F.concat(F.lit("script:"), F.col("script")), F.lit("all")))
    sound = measured.where(~F.col("base_failed")).select(F.explode(groups).alias("group"), "n_words", *MEASURES)
    middles = keep(sound.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(m, F.lit(0.5), 10_000).alias(f"mid_{m}") for m in MEASURES]), "middles")
    middles = middles.where((F.col("n") >= least) | (F.col("group") == "all"))
    near = sound.join(middles, "group")
    scales = near.groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"mid_{m}")) * by_length(m), F.lit(0.5), 10_000).alias(f"scale_{m}") for m in MEASURES])
    found = middles.join(scales, "group")
    return found.select("group", "n", *[F.struct(F.col(f"mid_{m}").alias("mid"), (1.4826 * F.col(f"scale_{m}")).alias("scale")).alias(m) for m in MEASURES])


def verdict(bands_: Column, reach: float, slack: float) -> Column:
    """Within `reach` deviations of the middle, which count for less the longer a text is, or within `slack` of it."""
    inside = [F.coalesce(F.abs(F.col(m) - bands_[m]["mid"]) <= F.greatest(reach * bands_[m]["scale"] / by_length(m), slack * bands_[m]["mid"], F.lit(0.002)), F.lit(True)) for m in MEASURES]
    return ~F.col("base_failed") & reduce(Column.__and__, inside)


def judge(documents: DataFrame, pieces: str, words_file: str, reach: float = 4.5, slack: float = 0.03, least: int = 200, lang: str = "lang", text: str = "text") -> DataFrame:
    """The columns of measure(), band (the group whose bands were used) and kept. The table is written once and read again.

    Columns of these names are replaced; those named _lang, _script, _lang_key and _script_key are used inside and dropped.
    """
    documents = documents.drop("_lang", "_script", "_lang_key", "_script_key")
    measured = keep(measure(documents, pieces, words_file, text), "measured")
    known = keep(bands(measured, lang, least), "bands")
    whole = known.where("group = 'all'").first()
    out = measured.drop("band", "kept")
    for name, key in (("lang", F.col(lang)), ("script", F.col("script"))):
        side = known.where(F.startswith("group", F.lit(name + ":"))).select(F.substring("group", len(name) + 2, 1 << 20).alias(f"_{name}_key"), F.struct("group", *MEASURES).alias(f"_{name}"))
        out = out.join(side, key == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")  # a row for each language; Spark broadcasts it if it is small
    if whole is None:
        return out.withColumns({"band": F.lit(None).cast("string"), "kept": F.lit(False)}).drop("_lang", "_script")
    default = F.struct(F.lit("all").alias("group"), *[F.struct(F.lit(whole[m]["mid"]).alias("mid"), F.lit(whole[m]["scale"]).alias("scale")).alias(m) for m in MEASURES])
    best = F.coalesce(F.col("_lang"), F.col("_script"), default)
    return out.withColumns({"band": best["group"], "kept": verdict(best, reach, slack)}).drop("_lang", "_script")
