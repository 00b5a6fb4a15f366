"""Replay of a transform on bars that end early, or are spoilt later on: what was decided by then must not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.core import stored

PRICES = ("open", "high", "low", "close")


def truncated(bars: DataFrame, at: Column, bar_minutes: int) -> DataFrame:
    """Bars that have ended by `at`."""
    return bars.filter(F.col("ts_utc") + F.make_dt_interval(mins=F.lit(bar_minutes)) <= at)


def poisoned(bars: DataFrame, at: Column, bar_minutes: int, factor: float = 10.0) -> DataFrame:
    """Bars whose prices are multiplied by `factor` if they end after `at`; nothing before changes."""
    late = F.col("ts_utc") + F.make_dt_interval(mins=F.lit(bar_minutes)) > at
    return bars.withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in PRICES if c in bars.columns})


#: Two doubles are one value if they differ by less than this, of their size or of 1e-3, whichever is more: sums of the same
#: rows in another order differ by their last bits, and by all digits where they cancel.
NEAR = 1e-9


def _said(column: str, kind: str) -> Column:
    """A value as text, doubles to nine digits."""
    c = F.col(f"`{column}`")
    return F.when(c.isNotNull(), F.format_string("%.8e", c + 0.0)) if kind == "double" else c.cast("string")


def _number(column: str, kind: str) -> Column:
    return F.col(f"`{column}`") if kind == "double" else F.lit(None).cast("double")


def _same(a: Column, b: Column) -> Column:
    near = F.abs(a["number"] - b["number"]) <= NEAR * F.greatest(F.abs(a["number"]), F.abs(b["number"]), F.lit(1e-3))
    return a["value"].eqNullSafe(b["value"]) | F.coalesce(near, F.lit(False))


def leaks(bars: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: list[str], at: Column, bar_minutes: int, decided: str = "decision_ts", factor: float = 10.0) -> DataFrame:
    """keys, replay (truncated or poisoned), column, before, after: every value of a row decided by `at` that is another one
    when later bars are missing or spoilt; column `(row)` for rows that only one of the two has. No rows: nothing leaks.

    The transform runs three times; rows are joined by key and values compared, doubles to nine digits, one column a row only where
    they differ."""
    kinds = None
    found = []
    for replay in ("", "truncated", "poisoned"):
        source = {"": lambda b: b, "truncated": lambda b: truncated(b, at, bar_minutes), "poisoned": lambda b: poisoned(b, at, bar_minutes, factor)}[replay](bars)
        rows = transform(source).filter(F.col(decided) <= at)
        kinds = kinds or [(c, t) for c, t in rows.dtypes if c not in keys]
        values = F.array(*[F.struct(F.lit(c).alias("column"), _said(c, t).alias("value"), _number(c, t).alias("number")) for c, t in kinds])
        found.append(stored(rows.select(*keys, values.alias(f"v{len(found)}")), "replayed"))
    full, *replays = found
    out = None
    for i, (name, other) in enumerate(zip(("truncated", "poisoned"), replays), 1):
        j = full.join(other, keys, "full")
        both = F.zip_with("v0", f"v{i}", lambda a, b: F.struct(a["column"].alias("column"), a["value"].alias("before"), b["value"].alias("after"), _same(a, b).alias("same")))
        alone = F.array(F.struct(F.lit("(row)").alias("column"), F.when(F.col("v0").isNotNull(), "there").alias("before"), F.when(F.col(f"v{i}").isNotNull(), "there").alias("after"), F.lit(False).alias("same")))
        differing = F.when(F.col("v0").isNull() | F.col(f"v{i}").isNull(), alone).otherwise(F.filter(both, lambda x: ~x["same"]))
        one = j.select(*keys, F.lit(name).alias("replay"), F.inline(differing)).drop("same")
        out = one if out is None else out.unionByName(one)
    return out
