"""The decision grid's columns of a day, each a function from frame to frame; `enriched` composes them in their fixed order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import average_rank, guarded, lag, rows, stored
from eventide.operators import grid as panel
from eventide.operators.grid import CLOCK, of_day

FLAGS = ("h004", "impulse", "high_rvol", "quiet_px", "mkt_agree")


def by_day():
    return Window.partitionBy("instrument_id", "session_date").orderBy("ts_utc")


def decision_grid(features: DataFrame, window: tuple[int, int], step: int) -> DataFrame:
    """Every step-th minute of a window (minutes from the open, both ends included)."""
    m = F.col("minutes_from_open")
    return features.filter(m.between(*window) & ((m - window[0]) % step == 0))


def is_eligible(price: float, dollars: float) -> Column:
    """A price and a typical day's dollar volume of at least so much; unknown is not eligible."""
    return F.coalesce((F.col("prev_close") >= price) & (F.col("typ_1m_vol") * F.col("prev_close") * 390 >= dollars), F.lit(False))


def eligible(grid: DataFrame, price: float, dollars: float) -> DataFrame:
    return grid.filter(is_eligible(price, dollars))


def with_weight(grid: DataFrame) -> DataFrame:
    """Root of the median dollar volume where the table has it (med20_dvol), else of a typical day's, else 1."""
    if "med20_dvol" in grid.columns:
        return grid.withColumn("weight_mkt", F.sqrt("med20_dvol"))
    if {"typ_1m_vol", "prev_close"} <= set(grid.columns):
        return grid.withColumn("weight_mkt", F.sqrt(F.col("typ_1m_vol") * F.col("prev_close") * 390))
    return grid.withColumn("weight_mkt", F.lit(1.0))


def with_residuals(grid: DataFrame, beta_days: int = 20) -> DataFrame:
    """Adds trading_date, r and weight, the market of all others over five and fifteen bars (mkt, mkt_15), beta over completed
    days, resid and resid_15; null where beta is unknown. Read twice: store what is dear."""
    g = grid.withColumns({"trading_date": F.col("session_date"), "r": F.col("ret_5m"), "weight": F.col("weight_mkt")})
    g = panel.residual_grid(g, panel.rolling_beta(panel.daily_returns(g), beta_days))
    g = panel.with_loo_market(g, CLOCK, "ret_15m", "mkt_15")
    return g.withColumn("resid_15", F.col("ret_15m") - F.col("beta") * F.col("mkt_15"))


def with_activity(grid: DataFrame) -> DataFrame:
    """Changes over five rows of the grid, the move in units of its path, the place in the day's range, distances to the day's
    extremes in units of how much absolute moves of the last fifteen rows varied, and volume."""
    d = by_day()
    swing = F.col("close") * (guarded(F.stddev_samp(F.abs("ret_5m")), "ret_5m", rows(15, d), 15) + 1e-6)
    return grid.select(
        "*",
        (F.col("ret_5m") - lag("ret_5m", 5, d)).alias("ret_accel_5m"),
        (F.col("ret_5m") / (F.col("path_abs_5") / (F.col("close") + 1e-12) + 1e-12)).alias("signed_path_eff_5m"),
        F.col("close_location_value").alias("close_location_5m"),
        F.try_divide(F.col("rth_high_so_far") - F.col("close"), swing).alias("dist_sess_high_volnorm"),
        F.try_divide(F.col("close") - F.col("rth_low_so_far"), swing).alias("dist_sess_low_volnorm"),
        F.col("rvol_5m").alias("rvol_5m_tod"),
        (F.col("volume_5m") / (lag("volume_5m", 5, d) + 1e-9)).alias("activity_acceleration"),
    )


@dataclass(frozen=True)
class Thresholds:
    shock_rvol: float = 5.0
    quiet_move: float = 0.012
    impulse: float = 0.04
    impulse_rvol: float = 3.0
    high_rvol: float = 3.0


def with_flags(grid: DataFrame, t: Thresholds) -> DataFrame:
    """The five states of a row, all of them together, and each conjunction without one."""
    made = {
        "h004": (F.col("rvol_5m") >= t.shock_rvol) & (F.abs("ret_5m") <= t.quiet_move),
        "impulse": (F.abs("ret_10m") >= t.impulse) & (F.col("rvol_10m") >= t.impulse_rvol),
        "high_rvol": F.col("rvol_5m") >= t.high_rvol,
        "quiet_px": F.abs("ret_5m") <= t.quiet_move,
        "mkt_agree": F.signum("ret_5m") == F.signum("mkt_ret_5m"),
    }
    grid = grid.select("*", *[c.alias(n) for n, c in made.items()])
    every = lambda names: reduce(lambda a, b: a & b, [F.col(n) for n in names])
    return grid.select("*", every(FLAGS).alias("full_state"), *[every([f for f in FLAGS if f != out]).alias(f"drop_{out}") for out in FLAGS])


def with_proxies(grid: DataFrame) -> DataFrame:
    """Proxies of trade size, impact and variation. What a source doesn't have is null, or 0 where none can be missing."""
    return grid.select(
        "*",
        (F.col("volume") / (F.col("transactions") + 1e-9)).alias("relative_trade_size_proxy"),
        (F.abs("resid") / (F.col("volume_5m") * F.col("close") + 1e-9)).alias("price_impact_proxy"),
        (F.col("rvol_5m") - F.abs("ret_5m") * 100).alias("volume_price_disagreement"),
        (F.col("range_15m") / (F.col("med20") + 1e-9)).alias("range_ratio_15m"),
        (F.abs("ret_15m") / (F.abs("ret_5m") + 1e-9)).alias("realized_vol_ratio_15m"),
        F.col("pm_ret").alias("premarket_residual_return"),
        F.col("gap_pct").alias("gap_market_residual"),
        F.lit(0.0).alias("missing_minute_rate_15m"),
        F.lit(None).cast("double").alias("rtxn_5m_tod"),
    )


def enriched(grid: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Activity, flags and proxies of a grid with residuals, in this order."""
    return grid.transform(with_activity).transform(with_flags, thresholds).transform(with_proxies)


def built(features: DataFrame, window: tuple[int, int], step: int, price: float, dollars: float, thresholds: Thresholds, beta_days: int = 20, tail: float = 2.0) -> DataFrame:
    """The whole day build in its fixed order: grid, eligibility, weight, beta, both residuals, activity, flags, cross-section,
    same clock, proxies, labels over three and six steps. Repeated keys are an error."""
    g = stored(features.transform(decision_grid, window, step).transform(eligible, price, dollars).transform(with_weight), "grid")
    if panel.repeated_keys(g, ["instrument_id", "session_date", "decision_ts"]).head(1):
        raise ValueError("the grid has repeated keys")
    g = with_residuals(g, beta_days).transform(with_activity).transform(with_flags, thresholds)
    g = g.transform(panel.cross_section, "resid", tail).transform(panel.same_clock).transform(with_proxies)
    six = g.transform(panel.labels, 6).withColumnRenamed("future_residual", "future_residual_six").drop("future_ret", "future_mkt", "next_ret", "next_resid")
    return panel.labels(six, 3)


def future_steps(grid: DataFrame, value: str = "resid") -> DataFrame:
    """The residual 1, 3, 6 and 12 rows of the day ahead (single steps, not added up), and rank and return three ahead."""
    g = grid.withColumn("_rank", average_rank(value, CLOCK))
    ahead = lambda c, k: F.lead(c, k).over(of_day())
    return g.select("*", *[ahead(value, k).alias(f"future_resid_{k}") for k in (1, 3, 6, 12)], ahead("_rank", 3).alias("future_rank_3"), ahead("r", 3).alias("future_ret_3")).drop("_rank")


def unit_beta(grid: DataFrame) -> DataFrame:
    """Residuals with beta 1 where it is unknown."""
    return grid.withColumn("resid", F.col("r") - F.coalesce("beta", F.lit(1.0)) * F.col("mkt"))


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns, in this order; an error names those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def filled(df: DataFrame, columns: dict[str, float | None], kind: str = "double") -> DataFrame:
    """Adds each column that isn't there yet, as the given literal."""
    return df.select("*", *[F.lit(v).cast(kind).alias(c) for c, v in columns.items() if c not in df.columns])
