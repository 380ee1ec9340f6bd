"""A corpus pipeline out of the training-data operators: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquill.llm import op2_substring, op3_decontamination, op5_jaccard, op7_language, op10_packing
from folioquill.llm.common import materialize
from folioquill.llm.queries import TOKENIZER

#: Ids of dropped documents are broadcast up to this many; beyond, both sides are shuffled.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``."""
    ids = materialize(ids.select("doc_id"), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject; those without a letter go."""
    told = op7_language.identify(docs, op7_language.learn(docs))
    return told.where("not _rejected").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of every group of near copies; documents without words stay."""
    return without(docs, op5_jaccard.jaccard_components(docs).where("not kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents that lose all their text go. n_chars follows the text."""
    cut = op2_substring.remove_repeats(docs)
    cut = cut.where("_n_removed = 0 or length(trim(text)) > 0")
    return cut.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else c for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, op3_decontamination.decontaminate(docs, benchmark).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    return op10_packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language identification and tokenizing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
