"""A corpus made ready for training: good documents, without near copies and secrets, packed into sequences.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and works on all that the stage before it has kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.classifier import keep_classified
from vellum.llm.common import shared_folder, table
from vellum.llm.packing import pack_documents
from vellum.llm.quality_rules import keep_good_documents
from vellum.llm.secret_scan import redact_documents
from vellum.llm.simhash import drop_similar_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their host share."""
    return keep_good_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    return keep_classified(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    SimHash proposes them: fingerprints of whole sets within two bits, and Golay-code keys of the fingerprints of parts.
    """
    return drop_similar_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them replaced."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in the sequences."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_copies", near_copies), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL expresses neither the fingerprints nor the forest nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written as Parquet to the shared folder, so a lost executor costs one stage at most."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
