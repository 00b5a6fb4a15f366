"""As-of, range and effective-dated joins as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], direction: str = "backward", id_col: str | None = None) -> DataFrame:
    """Each left row with `columns` of the nearest right row at or before (backward), or at or after (forward), its time.

    Both sides are laid out together by key and time and the last right row is carried on: one shuffle, no fan-out. Equal
    right times resolve to the greatest row. Null times and keys find nothing."""
    own = [c for c in left.columns if c not in columns]
    l = left.select(*by, F.col(left_ts).alias("_t"), F.lit(None).cast(right.select(F.struct(right_ts, *columns).alias("s")).schema["s"].dataType).alias("_r"), F.struct(*[left[c] for c in left.columns]).alias("_l"), F.lit(1).alias("_side"))
    r = right.filter(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("_t"), F.struct(right_ts, *columns).alias("_r"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_side"))
    both = l.unionByName(r)
    order = [F.col("_t").asc(), F.col("_side").asc(), F.col("_r").asc()] if direction == "backward" else [F.col("_t").desc(), F.col("_side").asc(), F.col("_r").desc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    ok = F.col("_t").isNotNull()
    for k in by:
        ok = ok & F.col(k).isNotNull()
    return found.select(*[F.col(f"_l.{c}").alias(c) for c in own], F.when(ok, F.col(f"_f.{right_ts}")).alias(right_ts if right_ts not in own else f"{right_ts}_found"), *[F.when(ok, F.col(f"_f.{c}")).alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, after_s: int, until_s: int, how: str = "inner", closed: str = "left") -> DataFrame:
    """Pairs with left_ts + after_s <= right_ts < left_ts + until_s (closed='left') or < .. <= (closed='right').

    Time is cut into stretches as long as the interval; a left row meets the two or three stretches its interval touches,
    so that the join is an equality on key and stretch."""
    width = max(1, until_s - after_s)
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    lo, hi = F.floor((sec(left_ts) + after_s) / width), F.floor((sec(left_ts) + until_s) / width)
    l = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns], F.floor(sec(right_ts) / width).alias("_rb"))
    a = F.col(left_ts) + F.make_dt_interval(secs=F.lit(after_s))
    b = F.col(left_ts) + F.make_dt_interval(secs=F.lit(until_s))
    t = F.col(f"_r_{right_ts}")
    inside = (t >= a) & (t < b) if closed == "left" else (t > a) & (t <= b)
    on = (F.col("_b") == F.col("_rb")) & inside
    for k in by:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    keep = [c for c in right.columns if c not in by]
    return l.join(r, on, how).drop("_b", "_rb").select(*left.columns, *[F.col(f"_r_{c}").alias(c if c not in left.columns else f"{c}_right") for c in keep])


def effective_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, from_col: str = "effective_from", to_col: str = "effective_to") -> DataFrame:
    """Slowly changing dimension: the version whose validity holds at the row's time, null where none does. Versions of a key
    don't overlap; empty ones (that end as they begin) don't count. As the last version that has begun is the only one
    that can hold, this is an as-of join: a row never meets the other versions of its key."""
    versions = right.filter(F.col(from_col).isNotNull() & (F.col(to_col).isNull() | (F.col(to_col) > F.col(from_col))))
    new = [c for c in right.columns if c not in left.columns]
    held = versions.select(*by, F.col(from_col).alias("_from"), F.struct(F.col(to_col).alias("_until"), *new).alias("_version"))
    out = asof_join(left, held, by, ts, "_from", ["_version"])
    holds = F.col("_version").isNotNull() & (F.col("_version._until").isNull() | (F.col(ts) < F.col("_version._until")))
    return out.select(*left.columns, *[F.when(holds, F.col(f"_version.{c}")).alias(c) for c in new])


def overlay_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses to multiply rows: repeated keys on the right are an error."""
    if right.groupBy(*keys).count().filter("count > 1").head(1):
        raise ValueError(f"overlay has repeated keys {keys}")
    return left.join(right, keys, "left")
