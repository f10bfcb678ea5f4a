"""A training corpus from the documents table, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, pii, quality, subword
from tidemark.llm.common import table, written

#: Bytes of text that a worker gets at a time for subword ids. Executor and worker hold
#: a batch several times over, and Spark's own limit lets a whole task's text be one.
PIECES_BATCH = "2m"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a host share go, and documents that fail the rules or have little else.

    Null and empty texts have no words and go. Repeated rows stay, null sources are a
    host of their own, an empty table stays empty, other columns stay as they are.
    """
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest doc_id stays.

    Of repeated rows one stays, of texts of one doc_id in one class that of smallest
    hash. Texts without words are classes of their own; an empty table stays empty.
    """
    return neardup.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    Null texts and those without personal data stay as they are, and so do repeated rows
    and an empty table.
    """
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, taken or taken twice, so that sources meet their targets.

    Rows of one doc_id are taken alike. Null texts weigh nothing, null sources are a
    source of their own, an empty table stays empty.
    """
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and size and digest of what they decode to, for each row taken.

    A null or empty text has no ids; repeated rows give repeated rows, an empty table none.
    The rows are written, as the limit of a batch holds only for a job that is run here.
    """
    out = subword.encode_pieces(docs.select("doc_id", "text"))
    decoded = F.col("decoded")
    out = out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.length(decoded).cast("long").alias("decoded_chars"),
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
    )
    return written(out, "subword-ids", batch=PIECES_BATCH)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("subword ids", pieces),
]

#: SQL can't express the sketches, the trees and the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
