"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target texts (labelled good) and one of all raw texts, give every
document the logarithm of its likelihood ratio. Its mean over n-grams is taken to a length of LENGTH n-grams, Gumbel noise
is added and the k largest are kept: sampling without replacement in proportion to the ratio at equal length, so that
neither long nor short texts are favoured. The k-th largest is found by histograms of the keys, not by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_bytes, md5_unit, packed, stored
from eventide.llm.op03_mixing import hash_thresholds

#: Buckets of words, of word pairs and of two-byte word endings, one after the other; the last is of repeated words.
WORDS, PAIRS, ENDS = 1 << 14, 1 << 14, 1 << 12
BUCKETS = WORDS + PAIRS + ENDS
#: Target texts are at most so many rows labelled good, chosen by a hash of doc_id. The raw model counts all rows.
TARGET_ROWS = 20_000
#: Mean log ratio of an n-gram from which a document counts as target-like; k is the number of such documents.
LIKE_TARGET = -0.2
#: Keys are log ratios of so many n-grams at the document's mean: noise decides within a few hundredths of LIKE_TARGET.
LENGTH = 50
#: Kept keys are compared with this resolution.
KEY_SCALE, KEY_MIDDLE = 1 << 20, 1 << 59


def ngram_buckets(text: bytes | None) -> np.ndarray:
    """Bucket numbers of a text's words, word pairs and word endings; empty for null and empty texts."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    word = np.fromiter(map(crc32, words), np.uint64, n)
    ends = np.fromiter(map(crc32, [w[-2:] for w in words]), np.uint64, n)
    first, second = word[:-1], word[1:]
    pair = ((first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(50)
    pair = WORDS + np.where(first == second, PAIRS - 1, pair.astype(np.int64) % (PAIRS - 1))
    return np.concatenate([(word % np.uint64(WORDS)).astype(np.int64), pair, WORDS + PAIRS + (ends % np.uint64(ENDS)).astype(np.int64)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, chosen in zip(batch.column(0), batch.column(1)):
            own = np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
            raw += own
            if chosen.as_py():
                target += own
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())],
        names=["bucket", "raw", "target"],
    )


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, with one pseudo-count a bucket; each of the three kinds is a model of its own."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(TARGET_ROWS)
    chosen = docs.join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left")
    counted = chosen.select(as_bytes("text").alias("text"), F.col("_good").isNotNull().alias("chosen"))
    sums = (
        counted.mapInArrow(_counts, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()  # BUCKETS rows at most
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    out = np.zeros(BUCKETS)
    for a, b in ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, BUCKETS)):
        p, q = target[a:b] + 1, raw[a:b] + 1
        out[a:b] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out if target.any() else np.zeros(BUCKETS)


def scored(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id of docs with _n (n-grams) and _w (log importance weight), made in one pass; with keep, all columns as `doc`."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs.select("doc_id", "text"), labels))

    @F.arrow_udf("struct<n:long,w:double>")
    def weigh(texts: pa.Array) -> pa.Array:
        own, n, w = ratios.value, [], []
        for text in texts:  # the buckets of one text at a time are held
            at = ngram_buckets(text.as_py())
            n.append(len(at))
            w.append(float(own[at].sum()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["n", "w"])

    rows = packed(docs).select("doc", F.col("doc.doc_id").alias("doc_id"), weigh(as_bytes("doc.text")).alias("_s"))
    return rows.select(*(["doc"] if keep else []), "doc_id", F.col("_s.n").alias("_n"), F.round("_s.w", 6).alias("_w"))


def with_decision(weighed: DataFrame) -> DataFrame:
    """Adds _key and _kept to stored rows with doc_id, _n, _w: the k largest keys of all rows, k being the number of
    target-like ones. Texts without n-grams have weight 0 and count as target-like. Equal keys stay or go together."""
    unit = (md5_unit("doc_id") + 0.5) / F.lit(float(1 << 60))
    mean = F.coalesce(F.try_divide("_w", F.col("_n")), F.lit(0.0))
    noisy = weighed.withColumn("_key", F.round(LENGTH * mean - F.log(-F.log(unit)), 6))
    place = F.lit(KEY_MIDDLE) - (F.greatest(F.lit(-1e9), F.least(F.lit(1e9), "_key")) * KEY_SCALE).cast("long")
    noisy = noisy.withColumn("_place", place)
    k = weighed.agg(F.count(F.when(mean >= LIKE_TARGET, 1)).cast("double").alias("budget")).select(
        F.lit(0).alias("g"), F.lit(0).alias("budget_no"), "budget"
    )
    keys = noisy.select(F.lit(0).alias("g"), F.col("_place").alias("hash"), F.lit(1).alias("weight"))
    bound = hash_thresholds(keys, k, "g").first().threshold
    return noisy.withColumn("_kept", F.col("_place") <= F.lit(bound)).drop("_place")


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> doc_id, n_grams, log_weight, gumbel_key, kept.

    One row a document row. Null and empty texts have no n-grams and weight 0. Without good labels all weights are 0
    and all rows stay. Noise hangs on doc_id: rows of one doc_id share it, and so do all without one. Keys are compared to
    six decimals; rows of equal keys stay or go together, so that k may be missed by as many. Very long texts count with
    all their n-grams; no rows give none. Other columns are ignored."""
    done = with_decision(stored(scored(docs.select("doc_id", "text"), labels), "weights"))
    return done.select(
        "doc_id", F.col("_n").alias("n_grams"), F.col("_w").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.col("_kept").alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, in all their columns, that importance resampling keeps. Null and empty texts have weight 0 and count
    as target-like; ties, repeated rows, long texts and empty tables as in `resample`. Columns of any name pass through."""
    return with_decision(stored(scored(docs, labels, keep=True), "weights")).filter("_kept").select("doc.*")
