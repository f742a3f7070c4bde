"""From raw documents to token ids: toxicity, exact and near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir); ``docs`` are the rows that its predecessor kept, and all but the last return the
columns of documents. A stage may be run by itself over any rows of that shape.

For all stages: a row is known by its doc_id and text, so missing or repeated ids do no harm and rows that repeat both are
decided alike; texts are read whole, however long; an empty table gives an empty result; further columns stay as they are,
whatever their names (the last stage returns its own alone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm import queries
from veilsift.llm.common import settled
from veilsift.llm.decontamination import decontaminated
from veilsift.llm.exact_dedup import deduplicated
from veilsift.llm.sentencepiece import encoded
from veilsift.llm.simhash import without_similar
from veilsift.llm.toxicity import untoxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, doesn't reject. A null or empty text
    scores as the intercept alone; without labels of both classes the smoothed share of toxic labels decides for all."""
    return untoxic(docs, queries.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: that with the most code points, then the
    smallest doc_id. Null and blank texts are one group; a null doc_id comes last; of rows that repeat both one stays."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents that are connected by sets of five-word shingles with a similarity of
    0.8 or more. Texts of fewer words are one shingle, texts without any are one group; a null doc_id comes last; rows that
    repeat the one that stays stay with it."""
    return without_similar(docs, 0.8)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has leaked into. Null and empty texts stay; items shorter than a seed or without an
    item_id are never found."""
    return decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and ids of each document; a null or empty text has none."""
    ids = encoded(docs, queries.piece_model())
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("simhash near-dedup", near), ("decontamination", leaks), ("sentencepiece", encode)]

#: No SQL states training, tiling or Viterbi search; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
