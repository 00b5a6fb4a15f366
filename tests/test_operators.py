"""Hand-computed values, boundaries and leakage checks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions.tdist import t_p_values
from eventide.operators import events as ev
from eventide.operators import joins, models
from eventide.operators import outcomes as oc
from eventide.operators.features import bar_features, causal_features
from eventide.sources.bars import SessionSpec, add_session

T0 = dt.datetime(2024, 1, 2, 14, 30)
MIN = dt.timedelta(minutes=1)


def minutes(spark, closes, start=T0, name="a"):
    rows = [(name, start + i * MIN, c, c * 1.001, c * 0.999, c, 100.0, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, transactions long")


def test_next_bar_entry_and_forward_return(spark):
    bars = minutes(spark, [10.0, 11.0, 12.0, 13.0])
    e = spark.createDataFrame([("e1", "a", T0 + MIN, "LONG"), ("e2", "a", T0 + MIN, "SHORT"), ("e3", "a", T0 + 9 * MIN, "LONG")], "event_id string, instrument_id string, entry_ts timestamp_ntz, side string")
    got = {(r.event_id, r.horizon): r.forward_return for r in oc.forward_returns(e, bars, {"1m": 1, "3m": 3}, 1).collect()}
    assert got[("e1", "3m")] == pytest.approx(13 / 11 - 1) and got[("e2", "3m")] == pytest.approx(1 - 13 / 11)
    assert got[("e1", "1m")] == 0.0 and got[("e3", "1m")] is None


def test_ambiguous_barrier_leaves_flags_null(spark):
    rows = [("a", T0, 10.0, 12.0, 8.0, 10.0), ("a", T0 + MIN, 10.0, 30.0, 10.0, 10.0)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double")
    e = spark.createDataFrame([("e", "a", T0, "LONG")], "event_id string, instrument_id string, entry_ts timestamp_ntz, side string")
    r = oc.barriers(e, bars, 5, 0.1, 0.1).first()
    assert r.ambiguous and r.target_first is None and r.mfe == pytest.approx(0.2) and r.mae == pytest.approx(-0.2)


def test_future_values_leave_past_features_alone(spark):
    spec = SessionSpec()
    bars = minutes(spark, [10 + 0.1 * i for i in range(40)])
    late = F.col("ts_utc") >= T0 + 25 * MIN
    poisoned = bars.select("instrument_id", "ts_utc", *[F.when(late, F.col(c) * 50).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")], "transactions")
    for f in (bar_features, causal_features):
        a, b = (f(add_session(x, spec), spec).filter(~late).orderBy("ts_utc").drop("transactions").collect() for x in (bars, poisoned))
        assert a == b and len(a) == 25


def test_asof_boundaries_and_ties(spark):
    left = spark.createDataFrame([(1, "a", T0), (2, "a", T0 - MIN), (3, "b", T0), (4, None, T0), (5, "a", None)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0, 1), ("a", T0, 2), (None, T0, 9)], "k string, at timestamp_ntz, v int")
    assert {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "at", ["v"]).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None}
    assert {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "at", ["v"], "forward").collect()}[2] == 1


def test_range_join_meets_brute_force(spark):
    rng = np.random.default_rng(1)
    l = pd.DataFrame({"k": rng.integers(0, 3, 60), "t": [T0 + MIN * int(x) for x in rng.integers(0, 500, 60)], "id": range(60)})
    r = pd.DataFrame({"k": rng.integers(0, 3, 80), "u": [T0 + MIN * int(x) for x in rng.integers(0, 500, 80)], "n": range(80)})
    ls, rs = spark.createDataFrame(l).withColumn("t", F.col("t").cast("timestamp_ntz")), spark.createDataFrame(r).withColumn("u", F.col("u").cast("timestamp_ntz"))
    for closed in ("left", "right"):
        got = {(x.id, x.n) for x in joins.range_join(ls, rs, ["k"], "t", "u", -3600, 1200, closed=closed).collect()}
        ok = lambda a, b: (a.t - 60 * MIN <= b.u < a.t + 20 * MIN) if closed == "left" else (a.t - 60 * MIN < b.u <= a.t + 20 * MIN)
        assert got == {(a.id, b.n) for a in l.itertuples() for b in r.itertuples() if a.k == b.k and ok(a, b)}


def test_effective_dates_and_overlay_fan_out(spark):
    left = spark.createDataFrame([("a", T0), ("a", T0 + MIN)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0 - MIN, T0 + MIN, "old"), ("a", T0 + MIN, None, "new")], "k string, effective_from timestamp_ntz, effective_to timestamp_ntz, v string")
    assert sorted((r.t, r.v) for r in joins.effective_join(left, right, ["k"], "t").collect()) == [(T0, "old"), (T0 + MIN, "new")]
    with pytest.raises(ValueError):
        joins.overlay_join(left, right, ["k"])


def test_cooldown_is_greedy(spark):
    rows = [(f"e{i}", "a", dt.date(2024, 1, 2), T0 + m * MIN) for i, m in enumerate((0, 5, 10, 19, 20, 31))]
    e = spark.createDataFrame(rows, "event_id string, instrument_id string, session_date date, decision_ts timestamp_ntz")
    assert {r.event_id for r in ev.cooldown(e, 10).collect()} == {"e0", "e2", "e4", "e5"}


def test_unknown_feature_is_an_error(spark):
    with pytest.raises(ValueError):
        ev.condition(spark.range(1), [("nope", ">=", 1.0)])
    with pytest.raises(ValueError):
        oc.horizon_minutes("5 weeks")
    assert oc.horizon_minutes("2h") == 120


def test_t_tail_against_known_values():
    p = t_p_values(np.array([2.228139, 1.959964, 0.0, np.nan, -12.706205]), np.array([10.0, 1e7, 5.0, 3.0, 1.0]))
    assert p[:3] == pytest.approx([0.05, 0.05, 1.0], abs=1e-5) and np.isnan(p[3]) and p[4] == pytest.approx(0.05, abs=1e-5)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 0.1 * rng.standard_normal(200)
    df = spark.createDataFrame(pd.DataFrame({"p": x[:, 0], "q": x[:, 1], "r": x[:, 2], "y": y}))
    assert models.ridge(df, ["p", "q", "r"], "y", 3.0) == pytest.approx(np.linalg.solve(x.T @ x + 3 * np.eye(3), x.T @ y))


def test_corrections_scan_no_frame_to_the_end_of_its_group(spark):
    from eventide.functions.core import with_bh, with_bh_wide

    t = spark.range(2000).selectExpr("id", "'a' as g", "case when id % 7 = 6 then null when id % 2 = 0 then 0D else (id % 13) / 13D end as p")
    found = [f(t, "p", ["g"], 0.1, ["id"]) for f in (with_bh, with_bh_wide)]
    for df in found:
        assert "currentrow$(), unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    ps = sorted((r.p, r.id) for r in t.collect() if r.p is not None)
    least, want = 1.0, {}
    for k in range(len(ps), 0, -1):
        least = min(least, ps[k - 1][0] * len(ps) / k)
        want[ps[k - 1][1]] = least
    for df in found:
        got = {r.id: r.q_value for r in df.collect()}
        assert len(got) == 2000 and all(got[i] is None if i not in want else abs(got[i] - want[i]) < 1e-12 for i in got)


def test_rounding_at_halves_is_that_of_the_sql(spark):
    import duckdb

    from eventide.plans.base import rounded

    xs = [k / 640 - 1 for k in range(1, 4000, 2)]
    got = [r.x for r in rounded(spark.createDataFrame([(x,) for x in xs], "x double")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6) + 0.0", [x]).fetchone()[0] for x in xs]


def test_percentile_between_equal_values_is_that_value(spark):
    from eventide.functions.core import exact_percentiles

    ps, xs = (0.1, 0.2, 0.3, 0.7, 0.9), [k / 48 for k in range(1, 49)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(xs) for _ in range(10 + i % 4)], "g int, x double")
    got = {r.g: r.q for r in exact_percentiles(t, ["g"], "x", ps).collect()}
    assert all(q == xs[g] for g in got for q in got[g]) and len(got) == 48


def test_last_bits_are_no_leak_but_changes_are(spark):
    from eventide.operators import leakage

    bars = spark.sql("select 'a' as instrument_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 15 * cast(id as int)) as ts_utc, double(id) as close from range(8)")

    def bits(b):  # what is missing later changes the last bits only, of a large value and of one that cancels to nearly 0
        n = b.count()
        return b.selectExpr("instrument_id", "ts_utc + interval 15 minute as decision_ts", f"0.1 * 3 + {n} * 1e-17 + 5.5e-9 as x", f"{n} * 1e-17 as y")

    at = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    assert leakage.leaks(bars, bits, ["instrument_id", "decision_ts"], at, 15).count() == 0
    moved = lambda b: bits(b).withColumn("y", F.lit(b.count() * 1e-9))
    assert leakage.leaks(bars, moved, ["instrument_id", "decision_ts"], at, 15).select("column").distinct().collect()[0][0] == "y"


def test_strongest_peers_of_blocks_are_those_of_all_pairs_and_ties_go_by_name(spark, monkeypatch):
    from eventide.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 3)
    rng, rows = np.random.default_rng(4), []
    series = [[(d, m, float(rng.normal())) for d in range(3) for m in range(0, 600, 15) if rng.random() < 0.8] for _ in range(5)]
    for k in range(10):  # names k and k + 5 are copies
        rows += [(dt.date(2024, 1, 8), f"n{k}", dt.date(2024, 1, 2 + d), m, x) for d, m, x in series[k % 5]]
    hist = spark.createDataFrame(rows, "as_of date, instrument_id string, trading_date date, minute_of_day int, r double")
    every = {}
    for p in graph.pair_statistics(hist, "r", 40).collect():
        every.setdefault(p.follower_id, []).append((-round(abs(p.corr), 12), p.leader_id, p.n, p.lag_n, round(p.lag_corr, 10)))
    near = {}
    for p in graph.structural_pairs(hist, "r", 40, peers=4)[0].collect():
        near.setdefault(p.follower_id, []).append((-round(abs(p.corr), 12), p.leader_id, p.n, p.lag_n, round(p.lag_corr, 10)))
    assert len(every) == 10 and all(len(v) == 9 for v in every.values())
    assert {f: sorted(v) for f, v in near.items()} == {f: sorted(v)[:4] for f, v in every.items()}
    x = rng.normal(size=(2, 4, 50))
    x[rng.random(x.shape) < 0.3] = np.nan
    i, j = np.array([0, 3, 2]), np.array([1, 1, 0])
    for one, all_pairs in zip(graph._of_pairs(x[0], x[1], i, j), graph._correlations(x[0], x[1])):
        assert np.allclose(one, all_pairs[i, j])


def test_pairs_of_blocks_are_handed_on_by_strips(monkeypatch):
    import numpy as np
    import pandas as pd

    from eventide.operators import graph

    monkeypatch.setattr(graph, "STRIP", 2)
    rng = np.random.default_rng(5)
    a, b = (pd.DataFrame({"instrument_id": [f"{p}{i}" for i in range(5)], "cells": [np.arange(600, 660, 15)] * 5, "xs": list(rng.standard_normal((5, 4)))}) for p in "ab")
    strips = list(graph._block_pair((None, 0, 1), a, b))
    assert [len(s) for s in strips] == [10, 10, 5] * 2
    assert len(pd.concat(strips).drop_duplicates(["leader_id", "follower_id"])) == 50


def test_stage_reads_its_returns_from_storage_and_jobs_are_tested_without_lambdas(spark):
    from pyspark.sql import functions as F

    from eventide.operators import jobs

    rows = [("i1", "2024-01-08", f"2024-01-08 10:{m:02d}:00", float(m)) for m in (0, 15, 30)] + [("i2", "2024-01-08", "2024-01-08 10:00:00", None)]
    bars = spark.createDataFrame(rows, "instrument_id string, session_date string, ts_utc string, x double").withColumn("session_date", F.to_date("session_date")).withColumn("ts_utc", F.col("ts_utc").cast("timestamp_ntz"))
    table = [jobs.Job("a", "f", "x >= 15", "'LONG'"), jobs.Job("b", "f", "x >= 0", "case when x > 0 then 'SHORT' end", entry_next=False), jobs.Job("c", "f", "x > 99", "'LONG'")]
    events = jobs.job_events(bars, table, 15)
    said = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in said(events)
    assert sorted((r.job_id, r.side, str(r.entry_ts)[11:16]) for r in events.collect()) == [("a", "LONG", "10:30"), ("b", "SHORT", "10:15")]
    returns = events.select(F.concat(F.lit("marker-"), "job_id").alias("job_id"), F.lit("3h").alias("horizon"), "event_id", "instrument_id", "session_date", F.lit(0.5).alias("forward_return"))
    stage = jobs.stage_summary(returns, "3h")
    assert "marker-" not in said(stage)
    assert {(r.job_id, r.n, r.mean) for r in stage.collect()} == {("marker-a", 1, 0.5), ("marker-b", 1, 0.5)}
