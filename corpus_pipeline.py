"""The document pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Null
texts are empty texts to every stage, rows with a null doc_id are no one's copies, repeated rows go through alike, an
empty table stays empty, and further columns of documents pass through.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import classifier, decontamination, minhash, suffix_dedup
from tideline.llm.common import start, stash, table
from tideline.llm.queries import packed

#: Documents with a lower quality score go.
QUALITY = 0.3
#: Similarity of near-duplicates in hundredths.
SIMILARITY = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on the labelled ones of these documents, gives a score of QUALITY or more."""
    start(spark)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return classifier.at_least(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    start(spark)
    return minhash.remove_near_duplicates(docs, SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out the bytes that an earlier document has too; every document stays, n_chars follows the text."""
    start(spark)
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences."""
    start(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontaminate), ("packing", pack),
]
#: SQL can state neither the learned stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stash(docs), sf_dir)
    return docs
