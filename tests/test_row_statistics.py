"""Ranks and associations over rows, extremes, onset, drift, times from text, overlays and progress, against plain computations."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions.core import wide_rank
from eventide.functions.tdist import t_p_values
from eventide.operators import graph, grid, jobs, models, quality
from eventide.operators import statistics as st
from eventide.sources import bars as src
from eventide.sources import stores


def test_wide_rank_with_a_hot_value_nulls_and_groups(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(4000) < 0.4, 0.0, rng.normal(size=4000).round(2))
    p = pd.DataFrame({"g": np.where(np.arange(4000) % 3 == 0, "a", "b"), "i": np.arange(4000), "x": x})
    p.loc[::97, "x"] = None
    df = spark.createDataFrame([(g, int(i), None if math.isnan(v) else float(v)) for g, i, v in p.itertuples(index=False)], "g string, i long, x double")
    got = wide_rank(df, ["g"], "x", "r").toPandas().set_index("i")["r"].sort_index()
    want = p.groupby("g")["x"].rank()
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    assert wide_rank(df.limit(0), ["g"], "x", "r").count() == 0


def test_row_association_and_its_guards(spark):
    rng = np.random.default_rng(5)
    n = 400
    p = pd.DataFrame({"day": np.arange(n) % 20, "a": rng.normal(size=n).round(1), "flat": 1.0, "y": rng.normal(size=n)})
    p["y"] += 0.3 * p["a"]
    p["few"] = np.where(np.arange(n) < 20, p["a"], np.nan)
    p.loc[3, "a"] = np.inf
    df = spark.createDataFrame(p)
    got = {r.feature: r for r in st.row_association(df, ["a", "flat", "few"], "y", "day").collect()}
    ok = np.isfinite(p["a"])
    rho = p["a"][ok].rank().corr(p["y"][ok].rank())
    t = rho * math.sqrt(ok.sum() - 2) / math.sqrt(1 - rho * rho)
    assert got["a"].n == n - 1 and abs(got["a"].rho - rho) < 1e-12
    assert abs(got["a"].p - t_p_values(np.array([t]), np.array([ok.sum() - 2.0]))[0]) < 1e-12 and got["a"].p < 1e-4
    assert got["flat"].p == 1.0 and got["flat"].rho is None and got["few"].p == 1.0
    assert st.row_association(df.filter("day < 5"), ["a"], "y", "day").first().p == 1.0
    marks = {r.feature: (r.status, r.p is None) for r in st.mechanism_tests(df, ["a", "flat", "few"], "y", "day").collect()}
    assert marks == {"a": ("SIGNAL_ONLY", False), "flat": ("NOT_EVALUATED", True), "few": ("NOT_EVALUATED", True)}
    assert {r.status for r in st.mechanism_tests(df.limit(0), ["a"], "y", "day").collect()} == {"NOT_EVALUATED"}


def test_primary_bootstrap_draws_the_primary_only(spark):
    rows = [("j", h, f"i{d % 3}", dt.date(2024, 1, 1 + d), (-1.0) ** d * (1 + d % 4)) for d in range(20) for h in ("1h", "3h")] + [("j", "3h", "i0", dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "job_id string, horizon string, instrument_id string, session_date date, forward_return double")
    signed, sizes = (jobs.primary_bootstrap(df, "3h", 50, a).collect()[0] for a in (False, True))
    assert signed.n == sizes.n == 20 and abs(sizes.mean - 2.5) < 1e-12 and sizes.positive_days == 1.0 and sizes.p_boot == 0.0
    assert signed.ci_low < signed.mean < signed.ci_high and signed.positive_days == 0.5


def test_extremes_with_ties_low_prices_and_without_k(spark):
    t = dt.datetime(2024, 1, 2, 10)
    rows = [(f"i{i}", dt.date(2024, 1, 2), t + dt.timedelta(minutes=15 * k), 10.0 if k else 300.0, 0.01 * (k + 1), 1.0) for i in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "instrument_id string, session_date date, ts_utc timestamp_ntz, high double, close double, volume double")
    got = sorted((r.kind, r.instrument_id, r.value) for r in quality.extremes(df, 200.0, 5.0, 20.0, 2, 0.015).collect())
    assert got == [("low", "i0", 0.01), ("low", "i1", 0.01), ("price", "i0", 300.0), ("price", "i1", 300.0)]
    assert quality.extremes(df, 200.0, 5.0, 20.0, None).count() == 3


def test_onset_prefers_reliable_periods(spark):
    df = lambda rows: spark.createDataFrame(rows, "week int, rate double, n long")
    found = lambda rows: [(r.week, r.level) for r in quality.news_onset(df(rows), "week").collect()]
    assert found([(1, 0.6, 90), (2, 0.9, 10), (3, 0.85, 50), (4, 0.9, 99)]) == [(3, "reliable")]
    assert found([(1, 0.4, 90), (2, 0.6, 49), (3, 0.5, 50)]) == [(3, "usable")]
    assert found([(1, 0.4, 90)]) == []


def test_columns_that_come_and_go(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", None, None), (2, "b", None, 2.0), (3, "c", 1.0, None)], "day int, k string, x double, z double")
    got = {r.day: (r.rows, r.added, r.missing) for r in quality.column_drift(df, "day").collect()}
    assert got == {1: (1, "", ""), 2: (2, "z", "x"), 3: (1, "", "")}
    assert quality.column_drift(df.limit(0), "day").count() == 0


def test_times_from_text_are_utc_in_any_session_zone(spark):
    said = ["2024-03-10T02:30:00", "2024-03-10T02:30:00Z", "2024-03-10T04:30:00.5+02:00", "2024-03-10", "no time", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r.s: r.t for r in df.select("s", src.utc_of_text(F.col("s")).cast("string").alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [got[s] for s in said] == ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "2024-03-10 02:30:00.5", "2024-03-10 00:00:00", None, None]


def test_an_overlay_with_repeated_keys_is_an_error(spark, tmp_path):
    one = spark.createDataFrame([("a", "2024-01-02", 600, 1.0)], "instrument_id string, trading_date string, minute_of_day int, x double")
    one.write.parquet(str(tmp_path / "panel"))
    over = one.withColumnRenamed("x", "y")
    over.union(over).write.parquet(str(tmp_path / "twice"))
    over.write.parquet(str(tmp_path / "once"))
    assert stores.load_panel(spark, str(tmp_path / "panel"), str(tmp_path / "once"), ["2024-01-02"], ["x", "y"]).collect() == [(1.0, 1.0)]
    with pytest.raises(ValueError):
        stores.load_panel(spark, str(tmp_path / "panel"), str(tmp_path / "twice"), ["2024-01-02"], ["x", "y"])


def test_progress_counts_the_last_line_of_a_file(spark, tmp_path):
    line = lambda f, s, c, at: json.dumps({"file": f, "status": s, "conversion": c, "bytes": 10, "rows": 5, "at": f"2024-01-01 00:00:{at:02}"})
    lines = [line("a", "failed", None, 1), line("a", "downloaded", "ok", 2), line("b", "skipped_verified", None, 4), line("c", "downloaded", "ok", 3), line("c", "failed", None, 9)]
    (tmp_path / "m.json").write_text("\n".join(lines))
    r = stores.ingest_progress(spark, str(tmp_path / "m.json"), 6).first()
    assert (r.expected, r.downloaded, r.converted, r.failed, r.bytes, r.rows, r.files_per_second, r.seconds_left) == (6, 2, 1, 1, 20, 5, 1.0, 4.0)


def test_selective_coverage_must_do_no_worse(spark):
    def judged(*means):
        rows = [(c, n, m, 0.5) for c, n, m in zip((0.05, 0.25, 1.0), (200, 300, 400), means)]
        df = spark.createDataFrame(rows, "coverage double, n long, mean double, win_rate double")
        return [r.reason for r in models.coverage_verdict(df, 100, 0.001, 0.0002).orderBy("coverage").collect()]

    assert judged(0.002, 0.001, 0.003) == ["monotonicity", None, None]
    assert judged(0.0029, 0.0005, 0.003) == [None, "size", None]
    assert judged(0.002, -0.1, -0.1) == [None, "sign", "sign"]


def test_a_graph_that_says_nothing_is_seen(spark):
    def day(gap, shock):
        rows = [(dt.date(2024, 1, 2), f"i{i}", 600, 0.1 * i, gap(0.1 * i), shock(i), True) for i in range(60)]
        return graph.overlay_days(spark.createDataFrame(rows, "trading_date date, instrument_id string, minute_of_day int, r double, response_gap double, leader_shock double, graph_available boolean"), "r").first()

    assert day(lambda r: -r, lambda i: 0.0)[1:] == (60, 60, 0, True, True)
    assert day(lambda r: 1.0 - r, lambda i: float(i))[1:] == (60, 60, 0, False, False)


def test_weights_not_above_zero_count_for_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("c", 100.0, 0.0)], "k string, r double, weight double").withColumn("g", F.lit(1))
    zero = df.withColumn("weight", F.when(F.col("k") == "b", 1.0).otherwise(0.0))
    assert {r.k: r.m for r in grid.with_loo_market(zero, ["g"], "r", "m").collect()}["b"] is None
