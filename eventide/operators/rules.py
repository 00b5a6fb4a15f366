"""Tables on rules and jobs: baselines, day-block errors, neighbouring cuts, stability over half samples, splits, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import exact_percentiles, small, stored

#: Floor of a mean return: this much at 15 minutes, growing with the root of time.
FLOOR, FLOOR_MINUTES = 0.0012, 15


def signed_baseline(returns: DataFrame, keys: list[str], x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Moments, quantiles and signs by key and month, with a row over all months (month null)."""
    r = returns.filter(F.col(x).isNotNull()).select(*keys, F.date_format(day, "yyyy-MM").alias("month"), x)
    r = stored(r.select(*keys, x, F.explode(F.array("month", F.lit("all"))).alias("month")), "returns")
    by = [*keys, "month"]
    g = r.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(F.abs(x)).alias("abs_mean"),
        F.avg((F.col(x) > 0).cast("double")).alias("positive"), F.avg((F.col(x) < 0).cast("double")).alias("negative"),
    )
    q = small(exact_percentiles(r, by, x, (0.05, 0.5, 0.95)))
    month = F.nullif(F.col("month"), F.lit("all")).alias("month")
    return g.join(q, by).select(*keys, month, "n", "mean", "std", "abs_mean", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate(("05", "50", "95"))], "positive", "negative")


def rule_sample(returns: DataFrame, keys: list[str], x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Mean with its error from day means, and what the sample is made of."""
    r = returns.filter(F.col(x).isNotNull())
    days = r.groupBy(*keys, day).agg(F.avg(x).alias("_m")).groupBy(*keys).agg((F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("day_se"), F.count("*").alias("days"))
    r = stored(r.select(*keys, day, "instrument_id", x), "returns")
    median = exact_percentiles(r, keys, x, (0.5,)).select(*keys, F.col("q")[0].alias("median"))
    top = r.groupBy(*keys, "instrument_id").count().groupBy(*keys).agg((F.max("count") / F.sum("count")).alias("top_name_share"))
    one = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg((F.col(x) > 0).cast("double")).alias("win_rate"),
        F.countDistinct("instrument_id").alias("names"), F.countDistinct(F.struct("instrument_id", day)).alias("name_days"),
    )
    return one.join(days, keys).join(median, keys).join(top, keys)


def histogram(returns: DataFrame, keys: list[str], width: float, low: float, high: float, x: str = "forward_return") -> DataFrame:
    """Counts by bin of a width; everything beyond the ends falls into the last bins."""
    bins = math.ceil(round((high - low) / width, 6))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - low) / width))).cast("int")
    return returns.filter(F.col(x).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def neighbour_cuts(scores: DataFrame, keep: float = 0.5) -> DataFrame:
    """Whether the side above a cut keeps its sign and at least `keep` of its mean at the cuts next to it."""
    w = Window.partitionBy("feature").orderBy("cut")
    d = scores.withColumn("_a", F.lag("right_mean").over(w)).withColumn("_b", F.lead("right_mean").over(w))
    same = lambda c: F.col(c).isNull() | ((F.signum(c) == F.signum("right_mean")) & (F.abs(c) >= keep * F.abs("right_mean")))
    return d.withColumn("robust", same("_a") & same("_b")).select("feature", "cut", "right_mean", "robust")


def day_sums(panel: DataFrame, bank: DataFrame, features: list[str], target: str, day: str = "session_date") -> DataFrame:
    """Sums and counts on both sides of every cut by day; any set of days is then a sum of these rows."""
    cuts = bank.groupBy("feature").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    long = panel.filter(F.col(target).isNotNull()).select(day, F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f"))
    long = long.select(day, "y", "f.feature", "f.x").filter("x is not null").join(F.broadcast(cuts), "feature").withColumn("cut", F.explode("cuts"))
    left = F.col("x") <= F.col("cut")
    return long.groupBy(day, "feature", "cut").agg(
        F.sum(F.when(left, F.col("y"))).alias("left_sum"), F.count_if(left).alias("left_n"), F.sum(F.when(~left, F.col("y"))).alias("right_sum"), F.count_if(~left).alias("right_n")
    )


def stability(sums: DataFrame, folds: int, least: int = 5, day: str = "session_date") -> DataFrame:
    """How often each feature gives the best split over half samples of days, and how often the side above its cut is
    the better one. A fold holds the days whose salted digest begins with 0 to 7. Rows multiplied by folds are sums by day and
    cut, not rows of data."""
    fold = sums.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    digest = F.md5(F.concat_ws(":", F.col("fold").cast("string"), F.date_format(day, "yyyy-MM-dd")))
    half = fold.filter(F.substring(digest, 1, 1) < "8")
    g = half.groupBy("fold", "feature", "cut").agg(*[F.sum(c).alias(c) for c in ("left_sum", "left_n", "right_sum", "right_n")]).filter((F.col("left_n") >= least) & (F.col("right_n") >= least))
    gap = F.col("right_sum") / F.col("right_n") - F.col("left_sum") / F.col("left_n")
    best = Window.partitionBy("fold").orderBy(F.round(F.abs("gap"), 9).desc(), "feature", "cut")
    top = g.withColumn("gap", gap).withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    return top.groupBy("feature").agg(F.count("*").alias("chosen"), (F.count("*") / F.lit(folds)).alias("share"), F.avg((F.col("gap") > 0).cast("double")).alias("upward"))


def floor_of(minutes: Column) -> Column:
    return FLOOR * F.sqrt(minutes / FLOOR_MINUTES)


def split_verdict(stats: DataFrame, keys: list[str], floor: Column, least: int) -> DataFrame:
    """stats(keys, split, n, mean) of D1 to D3 -> the means side by side and a verdict: D2 needs the sample, D1's sign and a
    quarter of the floor, D3 the sign and the floor."""
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s.lower()}") for s in ("D1", "D2", "D3") for c in ("n", "mean")])
    sign = lambda c: F.signum(c) == F.signum("mean_d1")
    d2 = F.coalesce((F.col("n_d2") >= least) & sign("mean_d2") & (F.abs("mean_d2") >= floor / 4), F.lit(False))
    d3 = F.coalesce(sign("mean_d3") & (F.abs("mean_d3") >= floor), F.lit(False))
    return wide.withColumn("verdict", F.when(~d2, "D2_FAILED").when(~d3, "D3_FAILED").otherwise("HELD"))


def stage_reason(least_name_days: int, least_days: int, name_share: float, direction: Column | None, least_mean: float | None = None) -> Column:
    """Why a job of a stage is out, over its name_days, days, top_name_share and mean: sample, concentration, returns (none on
    the primary horizon), sign (against the expected direction, 1 or -1; null expects none), size. Null: it passes."""
    reason = F.when((F.col("name_days") < least_name_days) | (F.col("days") < least_days), "sample").when(F.col("top_name_share") > name_share, "concentration").when(F.col("mean").isNull(), "returns")
    if direction is not None:
        reason = reason.when(F.col("mean") * direction < 0, "sign")
    return reason if least_mean is None else reason.when(F.abs("mean") < least_mean, "size")


def directional_gate(stats: DataFrame, days: DataFrame, keys: list[str], floor: Column, least_name_days: int, least_days: int, name_share: float, win: float, agree: float) -> DataFrame:
    """First reason against a job whose returns are signed by its side: sample, concentration, returns, sign, size, win_rate,
    median, days; PASS without one. A mean or median of exactly 0 has no wrong sign."""
    d = stats.join(days.select(*keys, "positive_days", "mean_without_best_day"), keys)
    reason = (
        stage_reason(least_name_days, least_days, name_share, F.lit(1)).when(F.abs("mean") < floor, "size").when(F.col("win_rate").isNull() | (F.col("win_rate") < win), "win_rate")
        .when(F.col("median").isNull() | (F.col("median") < 0), "median").when(F.col("positive_days").isNull() | (F.col("positive_days") < agree), "days")
    )
    return d.withColumn("reason", reason).withColumn("decision", F.when(reason.isNull(), "PASS").otherwise("KILL"))


def robust_gate(gated: DataFrame, intervals: DataFrame, trimmed: DataFrame, days: DataFrame, keys: list[str], floor: Column) -> DataFrame:
    """What directional_gate lets pass must also have a bootstrap interval (ci_low, ci_high) above 0, and means without the
    top values and without the best day of at least the floor: reason ci or outliers otherwise."""
    d = gated.join(intervals, keys).join(trimmed, keys).join(days.select(*keys, F.col("mean_without_best_day").alias("_rest")), keys)
    inside = F.coalesce((F.col("ci_low") > 0) & (F.col("ci_high") > 0), F.lit(False))
    robust = F.coalesce((F.col("mean_below_q99") >= floor) & (F.col("_rest") >= floor), F.lit(False))
    d = d.withColumn("reason", F.coalesce("reason", F.when(~inside, "ci").when(~robust, "outliers")))
    return d.withColumn("decision", F.when(F.col("reason").isNull(), "PASS").otherwise("KILL"))


def estimated(
    panel: DataFrame, rules: dict[str, Column], target: str, least: int = 0, least_days: int = 0, least_names: int = 0, name_share: float = 1.0, name: str = "instrument_id", day: str = "session_date",
) -> DataFrame:
    """Sample, mean and error of many rules in one pass, and why a rule is out: sample (too few name-days, days or names) or
    concentration (one name has too large a share of the rows). The error is that of day means where there are two days or
    more. Rows are counted once by rule, name and day; all else comes from these sums."""
    each = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull()))
    y = F.col(target).cast("double")
    rows = panel.filter(y.isNotNull() & ~F.isnan(y)).select(each.alias("rule"), y.alias("_y"), F.col(name).alias("_name"), F.col(day).alias("_day"))
    cells = stored(rows.groupBy("rule", "_name", "_day").agg(F.count("*").alias("c"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")), "cells")
    names = cells.groupBy("rule", "_name").agg(F.sum("c").alias("c")).groupBy("rule").agg((F.max("c") / F.sum("c")).alias("top_name_share"), F.count("*").alias("names"))
    means = cells.groupBy("rule", "_day").agg((F.sum("s") / F.sum("c")).alias("m")).groupBy("rule").agg(F.count("*").alias("days"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("_day_se"))
    n, s, q = F.sum("c"), F.sum("s"), F.sum("q")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q - s * s / n, n - 1)) / n)
    g = cells.groupBy("rule").agg(n.alias("n"), (s / n).alias("mean"), F.count("*").alias("name_days"), spread.alias("_row_se")).join(names, "rule").join(means, "rule")
    kill = F.when((F.col("name_days") < least) | (F.col("days") < least_days) | (F.col("names") < least_names), "sample").when(F.col("top_name_share") > name_share, "concentration")
    return g.select("rule", "n", "mean", F.when(F.col("days") > 1, F.col("_day_se")).otherwise(F.col("_row_se")).alias("se"), "name_days", "days", "names", "top_name_share", kill.alias("kill"))
