"""From raw documents to packed training sequences: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All but the last
return the columns of `documents`, so that stages can be left out or run again from what was written.

Edge cases, for all stages: extra columns are kept as they are, whatever they are called; those named as an operator's own results are set
aside while it runs. Texts of any length are read whole. Rows with equal keys or texts are judged one by one, but for near-duplicates, of
which the row that was written first stays. An empty table gives an empty one. Null texts: language ID rejects them, so later
stages get none; on their own, quality rules reject them, near_dedup and decontamination keep them, packing makes them a piece of the end id.
A null language or key is no reason to reject a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontam, fertility, langid, neardup, packing, store
from corpuscle.llm.catalogue import tokenizer

#: A document whose language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def beside(docs: DataFrame, needed: tuple[str, ...], judge) -> DataFrame:
    """The documents that judge(docs) keeps, when only the needed columns go by their own names inside; the rest is set aside and given back."""
    aside = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    kept = judge(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; the classifier learns from the labels and texts of four fifths of them."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return beside(docs, ("text",), lambda d: langid.predict(d, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of tokeniser fertility."""
    return beside(docs, ("text", "lang"), lambda d: fertility.judge(d, tokenizer("piece_bpe_32k.model"), tokenizer()).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, placed in sequences of 4096."""
    return packing.pack(docs, tokenizer(), 4096, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisers and learnt weights have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
