"""Linear models from one distributed Gram matrix, and selection by score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import exact_percentiles, stored, with_top


def standardised(df: DataFrame, features: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Each feature less its mean over its population deviation, both taken from `fitted_on` (rows of the training days) or
    from df itself; unknown or constant: 0."""
    row = (df if fitted_on is None else fitted_on).agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    z = lambda f: F.coalesce(F.try_divide(F.col(f) - F.lit(row[f"m_{f}"]), F.lit(row[f"s_{f}"])), F.lit(0.0))
    return df.withColumns({f"z_{f}": z(f) for f in features})


def ridge(df: DataFrame, xs: list[str], y: str, alpha: float) -> np.ndarray:
    """(X'X + alpha I)^-1 X'y. The Gram matrix is one aggregate; the driver solves a system as large as there are features."""
    d = df.filter(F.col(y).isNotNull())
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = d.agg(*[F.coalesce(F.sum(F.col(xs[i]) * F.col(xs[j])), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs], *[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    g = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return np.linalg.solve(g + alpha * np.eye(len(xs)), np.array([row[f"b{i}"] for i in range(len(xs))]))


def score(xs: list[str], weights) -> Column:
    out = F.lit(0.0)
    for x, w in zip(xs, weights):
        out = out + F.col(x) * F.lit(float(w))
    return out


def most_certain(df: DataFrame, s: str, coverage: float, ties: list[str]) -> DataFrame:
    """The given share of rows with the largest |score|; rows without a score go."""
    scored = stored(df.filter(F.col(s).isNotNull()), "scored")
    return with_top(scored, [], F.abs(s), lambda n: F.round(n * coverage), coverage, ties).filter("_top").drop("_top")


def rank_tails(df: DataFrame, keys: list[str], s: str, coverage: float, ties: list[str]) -> DataFrame:
    """Per cross-section the top share long and the bottom share short."""
    d = df.filter(F.col(s).isNotNull())
    w = Window.partitionBy(*keys)
    n = F.greatest(F.lit(1), F.round(F.count("*").over(w) * coverage).cast("int"))
    d = d.withColumn("_top", F.row_number().over(w.orderBy(F.desc(s), *ties))).withColumn("_low", F.row_number().over(w.orderBy(F.asc(s), *ties))).withColumn("_n", n)
    side = F.when(F.col("_top") <= F.col("_n"), "LONG").when(F.col("_low") <= F.col("_n"), "SHORT")
    return d.withColumn("side", side).filter("side is not null").drop("_top", "_low", "_n")


def _assembled(df: DataFrame, xs: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=xs, outputCol="_x").transform(df)


def logistic(train: DataFrame, test: DataFrame, xs: list[str], label: Column, penalty: float = 0.01) -> DataFrame:
    """test with `score`, the probability of the label; rows of train whose label is unknown don't count."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = _assembled(train.withColumn("_l", label.cast("double")).filter("_l is not null"), xs)
    model = LogisticRegression(featuresCol="_x", labelCol="_l", regParam=penalty, maxIter=80, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(rows)
    return model.transform(_assembled(test, xs)).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_c")


def stumps(train: DataFrame, test: DataFrame, xs: list[str], y: str, rounds: int = 40, step: float = 0.1) -> DataFrame:
    """test with `score` of boosted stumps fitted on the rows of train with a known y."""
    from pyspark.ml.regression import GBTRegressor

    rows = _assembled(train.filter(F.col(y).isNotNull()), xs)
    model = GBTRegressor(featuresCol="_x", labelCol=y, maxDepth=1, maxIter=rounds, stepSize=step, seed=7, predictionCol="score").fit(rows)
    return model.transform(_assembled(test, xs)).drop("_x")


def by_coverage(scored: DataFrame, s: str, y: str, shares: tuple, ties: list[str]) -> DataFrame:
    """Mean of y times the score's sign over the given shares of rows with the largest |score|."""
    d = stored(scored.filter(F.col(s).isNotNull()), "scored")
    signed, parts = F.signum(s) * F.col(y), []
    for share in shares:
        top = with_top(d, [], F.abs(s), lambda n, share=share: F.floor((n - 1) * share) + 1, share, ties).filter("_top")
        parts.append(top.agg(F.lit(share).alias("coverage"), F.count("*").alias("n"), F.avg(signed).alias("mean"), F.avg((signed > 0).cast("double")).alias("win_rate")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage_verdict(coverages: DataFrame, least: int, floor: float, slack: float) -> DataFrame:
    """PASS or KILL of each row of by_coverage, with the first reason that applies: sample, sign, size. Where both the most
    selective coverage and the widest pass, the selective one is killed (monotonicity) if its mean falls short of the
    widest's by more than `slack`: the surest rows must do no worse. A few rows take part."""
    reason = F.when(F.col("n") < least, "sample").when(F.col("mean") < 0, "sign").when(F.col("mean") < floor, "size")
    c = stored(coverages.withColumn("reason", reason), "coverages")
    ends = c.agg(F.min_by(F.struct("coverage", "reason"), "coverage").alias("_sure"), F.max_by(F.struct("reason", "mean"), "coverage").alias("_all"))
    j = c.crossJoin(F.broadcast(ends))
    both = F.col("_sure.reason").isNull() & F.col("_all.reason").isNull()
    worse = both & (F.col("coverage") == F.col("_sure.coverage")) & (F.col("mean") < F.col("_all.mean") - slack)
    reason = F.when(worse, "monotonicity").otherwise(F.col("reason"))
    return j.select("coverage", "n", "mean", "win_rate", reason.alias("reason"), F.when(reason.isNull(), "PASS").otherwise("KILL").alias("decision"))


def ridge_path(train: DataFrame, test: DataFrame, xs: list[str], y: str, penalties: tuple, ties: list[str]) -> DataFrame:
    """Error and decile spread of each penalty on rows of test. The penalties are few; all are scored in one job."""
    d = test.filter(F.col(y).isNotNull())
    scores = F.array(*[F.struct(F.lit(a).alias("penalty"), score(xs, ridge(train, xs, y, a)).alias("s")) for a in penalties])
    d = d.select(*ties, F.col(y).alias("_y"), F.explode(scores).alias("_s")).select(*ties, "_y", "_s.penalty", "_s.s")
    d = stored(d, "scored")
    cut = exact_percentiles(d, ["penalty"], "s", (0.1, 0.9)).withColumnRenamed("q", "_q")
    j = d.join(F.broadcast(cut), "penalty")
    top, low = F.avg(F.when(F.col("s") >= F.col("_q")[1], F.col("_y"))), F.avg(F.when(F.col("s") <= F.col("_q")[0], F.col("_y")))
    return j.groupBy("penalty").agg(F.avg(F.pow(F.col("s") - F.col("_y"), 2)).alias("error"), (top - low).alias("spread"), F.count("*").alias("n"))


def day_moments(panel: DataFrame, xs: list[str], y: str, day: str = "session_date") -> DataFrame:
    """day, m0_0, m0_1, ...: sums of products of (1, xs, y) by day; unknown features count as 0, rows without y not at all.
    Sums of these rows give the normal equations of any set of days, any scaler and any penalty."""
    a = [F.lit(1.0), *[F.coalesce(F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")), F.lit(0.0)) for x in xs], F.col(y).cast("double")]
    sums = [F.sum(a[i] * a[j]).alias(f"m{i}_{j}") for i in range(len(a)) for j in range(i, len(a))]
    return panel.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).groupBy(F.col(day).alias("day")).agg(*sums)


def split_moments(moments: DataFrame, shares: tuple[float, ...]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """For each share the moments of the first days, which together hold at most that share of the rows, and of the rest."""
    names = [c for c in moments.columns if c != "day"]
    size = max(int(c.split("_")[1]) for c in names) + 1
    d = moments.withColumn("_seen", F.sum("m0_0").over(Window.orderBy("day"))).withColumn("_all", F.sum("m0_0").over(Window.partitionBy(F.lit(1))))
    d = d.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("first", F.col("_seen") <= F.col("share") * F.col("_all") + 1e-9)
    out = {s: [np.zeros((size, size)), np.zeros((size, size))] for s in shares}
    for r in d.groupBy("share", "first").agg(*[F.sum(c).alias(c) for c in names]).collect():
        for c in names:
            i, j = map(int, c[1:].split("_"))
            out[r.share][not r.first][i, j] = out[r.share][not r.first][j, i] = r[c]
    return {s: tuple(m) for s, m in out.items()}


@dataclass
class Ridge:
    """A ridge with its scaler: prediction = weights[0] + sum of weights[i] * (x - mean) / deviation."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def design(self) -> np.ndarray:
        """The matrix that turns (1, xs) into the scaled row."""
        t = np.eye(len(self.mean) + 1)
        t[1:, 0] = -self.mean / self.deviation
        t[1:, 1:] = np.diag(1 / self.deviation)
        return t

    def score(self, xs: list[str]) -> Column:
        out = F.lit(float(self.weights[0]))
        for x, m, s, w in zip(xs, self.mean, self.deviation, self.weights[1:]):
            out = out + (F.coalesce(F.col(x).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
        return out


def scaler(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the features in moments of (1, xs, y); a constant one is divided by 1."""
    mean = m[0, 1:-1] / m[0, 0]
    s = np.sqrt(np.maximum(np.diag(m)[1:-1] / m[0, 0] - mean**2, 0))
    return mean, np.where(s < 1e-12, 1.0, s)


def ridge_of(m: np.ndarray, penalty: float) -> Ridge:
    """The ridge on the rows behind the moments, scaled by themselves; the intercept isn't penalised."""
    r = Ridge(*scaler(m), np.zeros(len(m) - 1))
    t = r.design()
    a = t @ m[:-1, :-1] @ t.T + penalty * np.eye(len(t))
    a[0, 0] -= penalty
    r.weights = np.linalg.solve(a, t @ m[:-1, -1])
    return r


def squared_error(r: Ridge, m: np.ndarray) -> float:
    """Mean squared error of a ridge on the rows behind the moments."""
    w = r.design().T @ r.weights
    return float((w @ m[:-1, :-1] @ w - 2 * w @ m[:-1, -1] + m[-1, -1]) / m[0, 0])


def picked_ridge(first: np.ndarray, rest: np.ndarray, penalties: tuple[float, ...], train_scaler: bool = True) -> tuple[Ridge, float, dict[float, float]]:
    """The ridge on the first rows whose penalty has the least error on the rest (the earlier of equal ones), its penalty, and
    all errors. With train_scaler=False predictions scale by all rows. Up to fifty rows everything is both."""
    whole = first + rest
    if whole[0, 0] <= 50 or not rest[0, 0] or not first[0, 0]:
        first = rest = whole
    fits = {p: ridge_of(first, p) for p in penalties}
    if not train_scaler:
        fits = {p: Ridge(*scaler(whole), r.weights) for p, r in fits.items()}
    errors = {p: squared_error(r, rest) for p, r in fits.items()}
    best = min(penalties, key=lambda p: errors[p])
    return fits[best], best, errors


def decile_spread(scored: DataFrame, s: str, y: str) -> DataFrame:
    """Mean of y in the top tenth of scores less that in the bottom tenth; 0 with under 50 rows or five a side."""
    d = stored(scored.filter(F.col(s).isNotNull() & F.col(y).isNotNull()).select(F.col(s).alias("s"), F.col(y).cast("double").alias("y")), "scored")
    j = d.crossJoin(F.broadcast(exact_percentiles(d, [], "s", (0.1, 0.9))))
    top, low = F.when(F.col("s") >= F.col("q")[1], F.col("y")), F.when(F.col("s") <= F.col("q")[0], F.col("y"))
    ok = (F.count("*") >= 50) & (F.least(F.count(top), F.count(low)) >= 5)
    return j.agg(F.count("*").alias("n"), F.when(ok, F.avg(top) - F.avg(low)).otherwise(0.0).alias("spread"))
