"""Pipeline over ``documents``: quality classifier, near-duplicate removal, passage removal, packing.

``STAGES`` holds (name, function) pairs; every function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Each stage works on all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import cut, table
from sqlprism.llm.near_dedup import near_duplicates
from sqlprism.llm.packing import pack
from sqlprism.llm.quality import THRESHOLD, score, train
from sqlprism.llm.substring_dedup import remove_repeats


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the trees are fitted on the training labels."""
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= THRESHOLD).select("whole.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every group of near-duplicates, once."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole")).select(
        "whole", F.col("whole.doc_id").cast("long").alias("_id"), F.xxhash64("whole.text").alias("_row"))
    return rows.join(gone, ["_id", "_row"], "left_anti").dropDuplicates(["_id", "_row"]).select("whole.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier elsewhere; n_chars follows the text."""
    out = remove_repeats(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 4096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("near-duplicates", one_of_each),
          ("substring dedup", without_repeats), ("packing", packed)]

#: The trees, tokenizer and union-find stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
