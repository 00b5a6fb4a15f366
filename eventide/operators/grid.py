"""Decision-grid panel: leave-one-out market, rolling beta, residuals, cross-sections, same-clock means, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventide.functions.core import average_rank, share_true, small

CLOCK = ["trading_date", "minute_of_day"]


def clock() -> WindowSpec:
    return Window.partitionBy(*CLOCK)


def of_day() -> WindowSpec:
    return Window.partitionBy("instrument_id", "trading_date").orderBy("minute_of_day")


def grid_of(causal: DataFrame) -> DataFrame:
    """Feature rows to grid rows: r is the return over one grid step, weight the root of typical dollar volume."""
    return causal.select(
        "instrument_id",
        F.col("session_date").alias("trading_date"),
        "minute_of_day",
        "decision_ts",
        F.col("ret_1m").alias("r"),
        F.sqrt(F.col("typ_1m_vol") * F.col("prev_close") * 390).alias("weight"),
        "rvol_5m",
        "gap_pct",
    )


def with_loo_market(df: DataFrame, keys: list[str], r: str, out: str, weight: str = "weight") -> DataFrame:
    """Adds the weighted mean of r of all others in a cross-section. Weights are clipped to their 1st and 99th percentile;
    rows without return, or without a weight above 0, count for nothing."""
    w = Window.partitionBy(*keys)
    q = F.percentile(weight, F.array(F.lit(0.01), F.lit(0.99))).over(w)
    clipped = F.least(F.col("_q")[1], F.greatest(F.col("_q")[0], F.col(weight)))
    df = df.withColumn("_q", q).withColumn("_w", F.when(F.col(weight).isNotNull() & F.col(r).isNotNull() & (clipped > 0), clipped))
    own, own_r = F.coalesce("_w", F.lit(0.0)), F.coalesce(F.col("_w") * F.col(r), F.lit(0.0))
    total, total_r = F.coalesce(F.sum("_w").over(w), F.lit(0.0)), F.coalesce(F.sum(F.col("_w") * F.col(r)).over(w), F.lit(0.0))
    others = F.count("_w").over(w) - F.when(F.col("_w").isNotNull(), 1).otherwise(0)
    return df.withColumn(out, F.when(others > 0, F.try_divide(total_r - own_r, total - own))).drop("_q", "_w")


def daily_returns(grid: DataFrame) -> DataFrame:
    """Compounded return of a day's steps, gaps counting as 0, and the day's first weight."""
    d = grid.groupBy("instrument_id", "trading_date").agg((F.product(1 + F.coalesce("r", F.lit(0.0))) - 1).alias("day_ret"), F.min_by("weight", "minute_of_day").alias("weight"))
    return with_loo_market(d, ["trading_date"], "day_ret", "day_mkt")


def rolling_beta(daily: DataFrame, days: int = 20) -> DataFrame:
    """OLS slope on the market over exactly the last `days` completed trading days; null unless all of them have a pair."""
    calendar = daily.select("trading_date").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("trading_date")))
    w = Window.partitionBy("instrument_id").orderBy("day_no").rangeBetween(-days, -1)
    x = daily.join(calendar, "trading_date")
    slope = F.regr_slope("day_ret", "day_mkt").over(w)
    ok = (F.regr_count("day_ret", "day_mkt").over(w) == days) & (F.var_pop("day_mkt").over(w) >= 1e-18)
    return x.select("instrument_id", "trading_date", F.when(ok, slope).alias("beta"))


def residual_grid(grid: DataFrame, beta: DataFrame) -> DataFrame:
    """Adds market, beta and resid; an unknown beta stays unknown."""
    g = with_loo_market(grid, CLOCK, "r", "mkt").join(beta, ["instrument_id", "trading_date"], "left")
    return g.withColumn("resid", F.col("r") - F.col("beta") * F.col("mkt"))


def cross_section(grid: DataFrame, value: str = "resid", tail: float = 2.0) -> DataFrame:
    """Rank, dispersion, breadth and tail imbalance of a value at each clock, and the change of the rank. Tails are values
    more than `tail` deviations from the mean."""
    z = (F.col(value) - F.avg(value).over(clock())) / (F.stddev_samp(value).over(clock()) + 1e-12)
    g = grid.withColumn("resid_rank", average_rank(value, CLOCK)).withColumn("_z", z)
    g = (
        g.withColumn("xs_dispersion", F.percentile(F.abs(value), F.lit(0.5)).over(clock()))
        .withColumn("xs_breadth", share_true(F.col(value) > 0).over(clock()))
        .withColumn("xs_tail_imbalance", share_true(F.col("_z") > tail).over(clock()) - share_true(F.col("_z") < -tail).over(clock()))
        .withColumn("resid_rank_change", F.col("resid_rank") - F.lag("resid_rank").over(of_day()))
    )
    return g.drop("_z")


def same_clock(grid: DataFrame) -> DataFrame:
    """Mean over earlier days of the day's mean return of all names at the same minute, and the surprise against it (unknown:
    0). One row a day and minute is left after the first grouping."""
    daily = grid.groupBy(*CLOCK).agg(F.avg("r").alias("_m"))
    w = Window.partitionBy("minute_of_day").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)
    means = daily.select(*CLOCK, F.avg("_m").over(w).alias("same_clock_mean"))
    out = grid.join(small(means), CLOCK, "left")
    return out.withColumn("same_clock_surprise", F.col("r") - F.coalesce("same_clock_mean", F.lit(0.0)))


def labels(grid: DataFrame, legs: int = 3) -> DataFrame:
    """Future residual over `legs` steps of the day: compounded stock less beta times compounded market; null if a leg is
    missing. Also the next step's raw and residual return."""
    def compounded(c: str):
        out = F.lit(1.0)
        for k in range(1, legs + 1):
            out = out * (1 + F.lead(c, k).over(of_day()))
        return out - 1

    g = grid.withColumn("future_ret", compounded("r")).withColumn("future_mkt", compounded("mkt"))
    g = g.withColumn("future_residual", F.col("future_ret") - F.col("beta") * F.col("future_mkt"))
    return g.withColumn("next_ret", F.lead("r").over(of_day())).withColumn("next_resid", F.lead("resid").over(of_day()))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")
