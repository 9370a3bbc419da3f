"""Token ids of whole texts, word by word.

The vocabularies used here never join characters across ASCII white space, so a text's ids are those of its words in a row. Tokens that
a file adds beside its vocabulary (such as marks of a text's end) are found as the library finds them. Each worker keeps the ids of the
words (or of their parts) that it has met; only new ones go to the tokenizer's library. The number kept is bounded: the older half is
forgotten when a limit is reached. Results don't depend on it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

#: A worker's tokenizers by their arguments; they stay from task to task.
LOADED: dict[Any, Any] = {}


def forget() -> None:
    """Frees a worker's tokenizers and the words that they have met, for operators that need the memory and no tokenizer."""
    LOADED.clear()


class WordIds:
    """The ids of words, as bytes in whatever form `encode` gives them; encode gets new words and what is known by now."""

    def __init__(self, encode: Callable[[list[bytes], dict[bytes, bytes]], list[bytes]], most: int = 250_000):
        self.encode, self.most, self.known, self.older = encode, most, {}, {}

    def ids(self, raw: bytes | None) -> bytes:
        return self.joined((raw or b"").split())

    def joined(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.learn(words).__getitem__, words))

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of these words, and perhaps of others."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.older, self.known, new = self.known, {}, set(words)
        if new:
            if self.older:
                seen = [w for w in new if w in self.older]
                self.known.update((w, self.older[w]) for w in seen)
                new.difference_update(seen)
            part = list(new)
            self.known.update(zip(part, self.encode(part, self.known)))
        return self.known


#: Letters of ASCII and Latin-1 that a tokenizer's normalising only lower-cases, then marks that are one token's text; no apostrophe, which
#: may begin a token with the letters after it.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)")


def visible_bytes() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: In Latin-1: letters, and all else that a plain text may hold: white space, digits and marks, but no apostrophe.
LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0xC0 and c not in (0xD7, 0xF7))
PLAIN_TEXT = LETTERS + bytes(c for c in range(33, 127) if c != 39 and not chr(c).isalpha()) + b" \t\n\v\f\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: A few words of many scripts, with marks, to try a vocabulary on.
SCRIPTS = "Ещё один текст, 12. Άλλο ένα! עוד טקסט؟ نص آخر 漢字かなカナ 한국어 हिन्दी में ภาษาไทย e\u0301 ﬁne Ǆ ſ İstanbul"
TOKENS = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class TextIds:
    """ids(raw) of whole texts. Plain ones are split as the tokenizer would split them, and what occurs is asked for once; others go by words.

    Texts that hold one of the file's added tokens aren't plain. Those tokens have no white space, so the library finds them in words, too.
    """

    def __init__(self, words: WordIds, tokens: WordIds | None, added: list[bytes]):
        self.words, self.tokens, self.encode = words, tokens, words.encode
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None

    def ids(self, raw: bytes | None) -> bytes:
        if self.tokens and raw and not (self.added and self.added.search(raw)):
            try:
                plain = raw.decode().encode("latin-1")
            except UnicodeEncodeError:
                return self.words.ids(raw)
            if not plain.translate(None, PLAIN_TEXT):
                return self.tokens.joined(TOKENS.findall(plain.translate(LOWER)))
        return self.words.ids(raw)


def word_bpe(path: str) -> TextIds:
    """Ids as little-endian unsigned 32-bit integers by a tokenizers file, without special tokens.

    The library's model is asked directly for words and tokens that its normaliser would only lower-case, which saves most of the time;
    whether that holds is tried when the file is loaded, and otherwise all words take the whole way.
    """
    if path not in LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks have a core each
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        table, model = visible_bytes(), t.model
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        if any(len(x.split()) != 1 or x != x.strip() for x in added):
            raise ValueError("an added token has white space")

        def whole(words: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)]

        def stem(s: str) -> bytes:
            return array("I", [k.id for k in model.tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(table))]).tobytes()

        letters = "".join(chr(c) for c in range(256) if PLAIN.fullmatch(chr(c).encode()) and chr(c).isalpha())
        trial = [a + b for a in letters for b in ("", "e", "Ö")] + ["Streaming", "naïve", "Ünïted", "ñandú", letters]
        ends = [".", ",", "###", "?!", "-", "...", "|", "<|", "_$%&"]
        direct = whole(trial) == [stem(w.lower()) for w in trial] and whole([w + m for w in trial for m in ends]) == [a + b for a in whole(trial) for b in whole(ends)]
        marks: dict[bytes, bytes] = {b"": b""}

        def encode(words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
            out: list[bytes] = [b""] * len(words)
            rest = []
            for i, w in enumerate(words):
                mark = b""
                if w.isalpha():  # of ASCII letters only
                    raw = w.lower()
                elif direct and (plain := PLAIN.fullmatch(w)):
                    raw, mark = plain.groups()
                    raw = raw.lower() if raw.isascii() else raw.decode().lower().encode()
                else:
                    rest.append(i)
                    continue
                if not direct:
                    rest.append(i)
                    continue
                ids = known.get(raw) if raw else b""
                if ids is None:
                    ids = known[raw] = stem(raw.decode())
                if mark:
                    if mark not in marks:
                        if len(marks) > 10_000:
                            marks.clear()
                        marks[mark] = whole([mark.decode()])[0]
                    ids += marks[mark]
                out[i] = ids
            for i, ids in zip(rest, whole([words[i].decode() for i in rest]) if rest else []):
                out[i] = ids
            return out

        def tokens(found: list[bytes], _: dict[bytes, bytes]) -> list[bytes]:
            return [stem(w.decode("latin-1")) for w in found]

        texts = [" ".join(trial), "".join(a + b for a in letters for b in ends), "Ab12-3c4. <|x|> (é)ÜÉ7%"]
        split = WordIds(tokens)
        direct = direct and whole(texts) == [split.joined(TOKENS.findall(x.encode("latin-1").translate(LOWER))) for x in texts]
        own = TextIds(WordIds(encode), split if direct else None, [a.encode() for a in added])
        texts += [f"One{a}two {a.upper()} {a}{a}. don't{a}" for a in added] + [SCRIPTS]
        if whole(texts) != [own.ids(x.encode()) for x in texts]:
            raise ValueError(f"{path} joins characters across white space")
        LOADED[path] = own
    return LOADED[path]


def raw_texts(batch: pa.RecordBatch, text: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one at a time."""
    column = batch.column(text).cast(pa.large_binary())
    for i in range(len(column)):
        yield column[i].as_py()


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, so that a step's arrays stay small; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0).to_pylist()
        at = total = 0
        for i, x in enumerate(sizes):
            if total and total + x > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += x
        if at < len(sizes):
            yield batch.slice(at)
