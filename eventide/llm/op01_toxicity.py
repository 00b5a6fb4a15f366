"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The model of a category is a logistic regression on hashed words and word
beginnings and on the probabilities of all earlier categories. In training these are out-of-fold predictions, so that
a later model sees what it will see on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import alnum_words, as_bytes, stored

#: In the order of the chain: name and condition on a row of labels.
CATEGORIES = (
    ("low_quality", "quality = 0"),
    ("toxic", "toxic = 1"),
    ("toxic_low_quality", "toxic = 1 and quality = 0"),
)
#: The classifiers are fitted on at most so many labelled rows, chosen by a hash of doc_id.
SAMPLE_ROWS = 10_000
FOLDS = 3
BUCKETS = 1 << 20
#: A model keeps the features with the largest chi-square, of at least MIN_CHI, among those in at least MIN_ROWS sample rows.
FEATURES, MIN_ROWS, MIN_CHI = 4096, 4, 6.0
EPOCHS, RATE, L2 = 6, 0.3, 1e-5
THRESHOLD = 0.4


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed features: words, word beginnings of four and five bytes, two-byte endings with punctuation, and
    whether words repeat at once. Null and empty texts have none."""
    text = text or b""
    words = alnum_words(text)
    found = set(map(crc32, set(words)))
    found.update(map(crc32, {b"4" + w[:4] for w in words}))
    found.update(map(crc32, {b"5" + w[:5] for w in words}))
    raw = text.split()
    found.update(map(crc32, {b"$" + w[-2:] for w in raw}))
    same = sum(map(bytes.__eq__, raw[1:], raw[:-1]))
    if same * 5 > len(raw):
        found.add(crc32(b"=repeats"))
    return np.unique(np.fromiter(found, np.int64, len(found)) % BUCKETS).astype(np.int32)


def _joined(rows: list[np.ndarray], at_once: int = 500) -> Iterator[np.ndarray]:
    for i in range(0, len(rows), at_once):
        yield np.concatenate(rows[i : i + at_once])


class Logistic:
    """Sparse logistic regression with adaptive steps over 0/1 features and a few dense ones."""

    def __init__(self, dense: int):
        self.keys, self.w, self.d, self.b = np.empty(0, np.int64), np.empty(0), np.zeros(dense), 0.0

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Logistic:
        n, pos = len(rows), float(y.sum())
        if not n or pos in (0.0, float(n)):
            self.b = 8.0 if n and pos else -8.0
            return self
        count = lambda some: sum((np.bincount(r, minlength=BUCKETS) for r in _joined(some)), np.zeros(BUCKETS))
        all_n, pos_n = count(rows), count([r for r, v in zip(rows, y) if v])
        expected = np.maximum(all_n * pos / n, 1e-9)
        chi = (pos_n - expected) ** 2 / (expected * (1 - pos / n) * np.maximum(1 - all_n / n, 1e-9))
        best = np.argsort(-np.where(all_n >= MIN_ROWS, chi, -1), kind="stable")[:FEATURES]
        self.keys = np.sort(best[(all_n[best] >= MIN_ROWS) & (chi[best] >= MIN_CHI)])
        self.w = np.zeros(len(self.keys))
        own = [self._at(r) for r in rows]
        self.b = float(np.log(pos / (n - pos)))
        gw, gd, gb, rng = np.full(len(self.w), 1e-8), np.full(len(self.d), 1e-8), 1e-8, np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in rng.permutation(n):
                x = own[i]
                g = 1 / (1 + np.exp(-np.clip(self.w[x].sum() + dense[i] @ self.d + self.b, -30, 30))) - y[i]
                step = g + L2 * self.w[x]
                gw[x] += step * step
                self.w[x] -= RATE * step / np.sqrt(gw[x])
                gd += (g * dense[i]) ** 2
                self.d -= RATE * g * dense[i] / np.sqrt(gd)
                gb += g * g
                self.b -= RATE * g / np.sqrt(gb)
        return self

    def _at(self, row: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, row)
        i[i == len(self.keys)] = 0
        return i[self.keys[i] == row] if len(self.keys) else np.empty(0, np.int64)

    def probability(self, row: np.ndarray, dense: np.ndarray) -> float:
        z = self.w[self._at(row)].sum() + float(np.dot(dense, self.d)) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def parts(self) -> pd.DataFrame:
        head = [(-1, self.b), *((-2 - i, v) for i, v in enumerate(self.d))]
        keys = np.concatenate([[k for k, _ in head], self.keys]).astype(np.int64)
        return pd.DataFrame({"key": keys, "value": np.concatenate([[v for _, v in head], self.w])})

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, dense: int) -> Logistic:
        m, order = cls(dense), np.argsort(keys)
        keys, values = keys[order], values[order]
        split = np.searchsorted(keys, 0)
        m.b, m.d = float(values[split - 1]), values[split - 1 - dense : split - 1][::-1].copy()
        m.keys, m.w = keys[split:], values[split:]
        return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(0)]
        columns = [pa.array(rows, pa.list_(pa.int32())), *batch.columns[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=["x", *batch.schema.names[1:]])


def _fitter(i: int):
    """Fits category i on the rows outside of a fold, or on all, and predicts for the rows of the fold."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        own, dense = list(rows["x"]), np.array([np.asarray(p, float) for p in rows["p"]]).reshape(len(rows), i)
        out, y = rows["fold"].to_numpy() == key[0], rows[f"y{i}"].to_numpy()
        inside, left = np.flatnonzero(~out), np.flatnonzero(out)
        m = Logistic(i).fit([own[j] for j in inside], dense[inside], y[inside])
        if key[0] == FOLDS:
            return m.parts().assign(kind="model")
        said = [m.probability(own[j], dense[j]) for j in left]
        return pd.DataFrame({"key": rows["_id"].to_numpy()[left], "value": said, "kind": "p"})

    return fit


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> list[Logistic]:
    """The chain's models. Every fold's model and the final one of a category are fitted in tasks of their own, each on
    the bounded sample; predictions for the rows that a fold left out go on to the next category."""
    marks = [F.expr(c).cast("double").alias(f"y{i}") for i, (_, c) in enumerate(categories)]
    # of several rows of a label or a document the least counts, whatever the order they come in
    one = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l")).select("doc_id", "l.*")
    chosen = one.select(F.col("doc_id").alias("_id"), *marks).dropna()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    named = [f"y{i}" for i in range(len(categories))]
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    fold = (F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS))).cast("int").alias("fold")
    sample = picked.groupBy("_id", *named).agg(F.min("text").alias("text")).select(as_bytes("text").alias("text"), "_id", fold, *named)
    schema = "x array<int>, _id long, fold int, " + ", ".join(f"{y} double" for y in named)
    sample = stored(sample.mapInArrow(_featured, schema).withColumn("p", F.array().cast("array<double>")), "sample")
    models = []
    for i in range(len(categories)):
        copies = sample.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        made = copies.groupBy("model").applyInPandas(_fitter(i), "key long, value double, kind string")
        made = stored(made, "chain")
        parts = made.filter("kind = 'model'").toPandas()
        models.append(Logistic.of(parts["key"].to_numpy(), parts["value"].to_numpy(), i) if len(parts) else Logistic(i).fit([], np.empty((0, i)), np.empty(0)))
        said = made.filter("kind = 'p'").select(F.col("key").alias("_id"), F.col("value").alias("_v"))
        sample = stored(sample.join(said, "_id").withColumn("p", F.concat("p", F.array("_v"))).drop("_v"), "sample")
    return models


def classify(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality, toxic) -> doc_id, p_<category> for each category, toxic.

    One row a document row; toxic: p_toxic of at least THRESHOLD. Null and empty texts get the chain's answer for no
    features. Rows of labels with a null don't train; without labels every probability is near 0. Of rows with one
    labelled doc_id the least text trains. Texts count whole, however long; repeated rows get equal answers; no rows give
    none. Other columns are ignored."""
    names = [f"p_{n}" for n, _ in categories]
    models = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[list[float]] = [[] for _ in names]
            for text in batch.column(1):
                x, p = features(text.as_py()), []
                for i, m in enumerate(models.value):
                    p.append(m.probability(x, np.array(p)))
                    said[i].append(round(p[-1], 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in said)], names=["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names)
    out = docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("text")).mapInArrow(run, schema)
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
