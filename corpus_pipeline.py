"""A training-corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; what one returns is written as Parquet and
read again as the next one's documents. Stages keep the columns of documents; the last adds what the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import packed, shared_dir, stored, table
from eventide.llm.op03_mixing import plan_mix, take, with_size
from eventide.llm.op05_secret_links import redacted
from eventide.llm.op06_importance_resampling import keep_good
from eventide.llm.op07_circulant_minhash import first_of_each
from eventide.llm.op09_decontaminate import clean

#: Documents are near-duplicates from this share of their united shingles on, in percent.
NEAR_PERCENT = 80

#: The pipeline's result depends on learnt models and on masks from position arrays, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go. Null and empty texts count as target-like and take part; rows of equal
    keys (repeated rows among them) stay or go together; very long texts count whole; no documents give none."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the least doc_id
    stays, null last. Null and empty texts are like nothing and all stay. Of repeated rows one stays; very long texts are compared
    by all their shingles; no documents give none."""
    return first_of_each(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts have none and stay. Repeated rows go or stay together; very
    long texts are scanned whole; an empty benchmark lets all stay, no documents give none."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null and empty texts as they are. Repeated rows are masked alike, overlapping
    spans as one; very long texts are scanned whole; no documents give none."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, or that have no words (null and empty texts), with size, source_size,
    target, taken. Of columns with these four names the mix's stay; all others pass through. Rows of one doc_id are taken
    together; a very long text is taken or left as a whole; no documents give none."""
    rows = packed(docs).select("doc", F.col("doc.source").alias("source"), *with_size(docs, "doc.text", "doc.doc_id"))
    plan = plan_mix(stored(rows.select("source", "hash", "size"), "sizes"))
    others = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    return take(rows, plan).filter("taken > 0 or size = 0").select(*others, "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
