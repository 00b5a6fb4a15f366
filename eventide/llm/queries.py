"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import oracles
from eventide.llm.common import table
from eventide.llm.op01_toxicity import classify
from eventide.llm.op02_media_sequences import described, media_columns, media_table, page_sequences
from eventide.llm.op03_mixing import mix
from eventide.llm.op04_recurrent_lm import score
from eventide.llm.op05_secret_links import secrets
from eventide.llm.op06_importance_resampling import resample
from eventide.llm.op07_circulant_minhash import near_duplicates
from eventide.llm.op08_license_diagonals import scan
from eventide.llm.op09_decontaminate import decontaminate
from eventide.llm.op10_pii_votes import personal_data
from eventide.llm.op11_extendible_hash import exact_duplicates
from eventide.llm.op12_fill_in_middle import fim_digests
from eventide.llm.op13_whitening import whitened


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op11_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all web pages; references are looked up among the payloads of all documents."""
    return page_sequences(table(spark, sf_dir, "pages"), described(media_table(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media_sequences": op2_media_sequences,
    "op3_mixing": op3_mixing,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_secret_links": op5_secret_links,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii_votes": op10_pii_votes,
    "op11_extendible_hash": op11_extendible_hash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
    "media_pages": media_pages,
}

ORACLES: dict[str, str] = {
    "op3_mixing": oracles.OP3,
    "op7_circulant_minhash": oracles.OP7,
    "op9_decontaminate": oracles.OP9,
    "op11_extendible_hash": oracles.OP11,
    "op12_fill_in_middle": oracles.OP12,
}
