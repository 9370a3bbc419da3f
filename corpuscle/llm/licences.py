"""Licence scans: digests of canonical texts, looked up among those of known licences.

A text is brought to a canonical form (case, white space, punctuation, copyright lines and equivalent spellings) and its SHA-256 is
joined with the digests of the known licences in the same form. A text is a whole document or a whole line of it, so that notices
inside other text are found too; a licence body that is only a part of a document isn't.

The known licences are whole texts by SPDX name, kept as files beside this module, and short notices.

Edge cases: a null text or one with nothing but punctuation and copyright lines has no digest and no licence. Texts of any length are taken
whole. Two licences of the same canonical text count as the first by name. Documents are never
merged: each row gives a row, and columns of the same names as the result's are replaced,
and those named _lines, _line and _row, which are used inside, dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep

# Equivalent spellings, as licence matching guidelines treat them. Applied in order, inside longer words too.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"),
    ("categoris", "categoriz"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasise", "emphasize"), ("favour", "favor"), ("fulfill", "fulfil"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"), ("merchantibility", "merchantability"), ("modelled", "modeled"), ("modelling", "modeling"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("signalling", "signaling"), ("sub-license", "sublicense"),
    ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("willful", "wilful"), ("https://", "http://"), ("&", " and "),
)
MARKS = "‘’“”«»–—…•·¡¿"
#: A line that says who holds the copyright. The form before "\\n" is put in front of each line first.
COPYRIGHT = r"\n[^a-z0-9©\n]*(copyright +(\(c\)|©|[0-9]{4})|\(c\) +[0-9]{4}|c\) +[0-9]{4}|© *[0-9]{4}|all rights reserved)[^\n]*"
PUNCTUATION = rf"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f{MARKS}]+"

# Short notices by SPDX name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEXTS = Path(__file__).parent / "licence_texts"
#: The end of the terms of some licences; what follows says how to apply them.
TERMS_END = "END OF TERMS AND CONDITIONS"


def forms(text: str) -> list[str]:
    """A licence's text as it is, without its title, and both without what follows its terms."""
    out = [text]
    if TERMS_END in text:
        out.append(text[: text.index(TERMS_END) + len(TERMS_END)])
    title, _, rest = text.lstrip().partition("\n\n")
    return out + [x.lstrip().partition("\n\n")[2] for x in out if len(title) < 200 and rest]


def known_texts() -> list[tuple[str, str]]:
    """Licences by SPDX name: the texts beside this file in their forms, the short notices, and an identifier line for each name."""
    whole = [(p.stem, form) for p in sorted(TEXTS.glob("*.txt")) for form in forms(p.read_text())]
    names = sorted({k for k, _ in (*whole, *NOTICES)})
    return [*whole, *NOTICES, *[(k, f"SPDX-License-Identifier: {k}") for k in names]]


def canonical_lines(text: Column) -> Column:
    """The lines of the canonical form that have something left, as an array."""
    t = F.concat(F.lit("\n"), F.translate(F.lower(text), "\t\r\x0b\x0c", "    "))
    t = F.regexp_replace(t, COPYRIGHT, "\n")
    for word, same in SPELLINGS:
        t = F.replace(t, F.lit(word), F.lit(same))
    t = F.regexp_replace(t, PUNCTUATION, " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def digest(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_licences(spark: SparkSession, texts: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (digest, license) of the known texts, digests once each."""
    rows = spark.createDataFrame(list(texts or known_texts()), "license string, text string")
    return rows.select(digest(canonical_lines(F.col("text"))).alias("digest"), "license").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(documents: DataFrame, known: DataFrame | None = None, text: str = "text", most: int = 1000) -> DataFrame:
    """Adds digest, license (of the whole text, null if unknown), n_lines, and notices (the sorted licences of whole lines, with repeats).

    known: rows (digest, license), one for each digest. Whole texts are joined with it by digest. Up to `most` rows, counted before, it
    is broadcast, and lines are looked up in it as a map of literals; beyond that both are joins that Spark is free to split.
    """
    known = known if known is not None else known_licences(documents.sparkSession)
    few = known.limit(most + 1).collect()  # bounded
    base = documents.drop("digest", "license", "n_lines", "notices", "_lines", "_line", "_row").withColumn("_lines", canonical_lines(F.col(text)))
    base = base.withColumns({"digest": digest(F.col("_lines")), "n_lines": F.coalesce(F.size("_lines"), F.lit(0))})
    none = F.array().cast("array<string>")
    if len(few) <= most:
        table = F.create_map(*[F.lit(x) for r in few for x in (r["digest"], r["license"])]).cast("map<string,string>")
        hits = F.transform(F.col("_lines"), lambda x: F.try_element_at(table, F.sha2(x, 256)))
        base = base.withColumn("notices", F.coalesce(F.array_sort(F.filter(hits, lambda x: x.isNotNull())), none))
        return base.drop("_lines").join(F.broadcast(known), "digest", "left")
    base = keep(base.withColumn("_row", F.monotonically_increasing_id()), "canonical")
    lines = base.select("_row", F.explode("_lines").alias("_line")).select("_row", F.sha2("_line", 256).alias("digest"))
    notices = lines.join(known, "digest").groupBy("_row").agg(F.array_sort(F.collect_list("license")).alias("notices"))
    found = base.drop("_lines").join(known, "digest", "left").join(notices, "_row", "left").drop("_row")
    return found.withColumn("notices", F.coalesce("notices", none))
