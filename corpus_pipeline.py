"""From raw documents to token ids: the text operators as one pipeline.

Every stage keeps extra columns, whatever their names.  Null and empty texts are of no language and go in the first stage; a stage on its own treats a null
as an empty text.  Rows that repeat one another are copies (exact dedup keeps one), ties are settled by doc_id, an empty table stays empty.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``
(the last one: token ids).  ``run`` writes each stage's result as Parquet to the shared folder and reads it
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from riskspark.llm.common import documents, drop, shared_folder
from riskspark.session import shuffles_freed, tables_freed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents of no language (``und``: without any letter) go; the others stay with their own columns, a missing lang filled in."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document as often as the mix takes it (0 to 3 times)."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids with their digests and the digest of the decoded text."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier, the rounding draws or the token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``.

    A stage's inner tables are deleted when its result is written, and its result when that of the next one is.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with shuffles_freed(spark), tables_freed():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            drop(docs)
        docs = spark.read.parquet(f"{folder}/{k}")
        docs.written_to = f"{folder}/{k}"
    return docs
