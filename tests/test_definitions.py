"""Definitions against hand-made days, plain loops and numpy; helpers that replace global sorts; trees; stores."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import core
from eventide.operators import daybuild, graph, grid, jobs, models, quality, rules, tree
from eventide.operators import events as ev
from eventide.operators import outcomes as oc
from eventide.operators import statistics as st
from eventide.operators.features import causal_features
from eventide.sources import bars as src
from eventide.sources import stores

T0 = dt.datetime(2024, 1, 2, 14, 0)  # 09:00 in New York
MIN = dt.timedelta(minutes=1)
BARS = "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, transactions long"


def test_causal_features_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    days = {}
    for k in range(2):
        close = np.round(10 + np.cumsum(rng.normal(0, 0.2, 90)), 2)
        days[T0 + dt.timedelta(days=k)] = [(close[max(0, i - 1)], close[i] + rng.random(), close[i] - rng.random(), close[i], float(rng.integers(1, 9))) for i in range(90)]
    rows = [("a", start + i * MIN, *map(float, bar), 1) for start, day in days.items() for i, bar in enumerate(day)]
    spec = src.SessionSpec()
    got = causal_features(src.add_session(spark.createDataFrame(rows, BARS), spec), spec).orderBy("ts_utc").collect()
    assert len(got) == 120  # half an hour before the open is left out, but windows have seen it
    (_, first), (start, second) = days.items()
    o, h, lo, c, v = (np.array([b[j] for b in second]) for j in range(5))
    prev_close = first[-1][3]
    day_range = (max(b[1] for b in first[30:]) - min(b[2] for b in first[30:])) / prev_close
    typ = np.median([b[4] for b in first[30:]])
    near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
    for i in range(30, 90):
        r = got[60 + i - 30]
        win = lambda x, k: x[i - k + 1 : i + 1] if i >= k - 1 else None  # noqa: B023, E731
        assert r.ret_5m == near(c[i] / c[i - 5] - 1) and r.ret_15m == near(c[i] / c[i - 15] - 1)
        assert r.ret_60m == (near(c[i] / c[i - 60] - 1) if i >= 60 else None)
        assert r.range_15m == near((win(h, 15).max() - win(lo, 15).min()) / c[i]) and r.range_1m == near((h[i] - lo[i]) / c[i])
        assert r.acceleration_5_vs_15 == near(r.ret_5m - r.ret_15m) and r.pullback_from_recent_high == near(win(h, 15).max() / c[i] - 1)
        so_high, so_low = h[30 : i + 1].max(), lo[30 : i + 1].min()
        assert r.close_location_value == near((c[i] - so_low) / (so_high - so_low + 1e-12))
        before = h[i - 15 : i].max() if i > 30 else None
        assert r.new_high_15 == (None if before is None else bool(h[i] >= before))
        assert r.volume_5m == near(win(v, 5).sum()) and r.rvol_5m == near(win(v, 5).sum() / (typ * 5 + 1e-9))
        assert r.volume_acceleration == (near(win(v, 5).sum() / (v[i - 9 : i - 4].sum() + 1e-9)) if i >= 35 else None)
        assert r.vol_vs_prev5_avg == near(v[i] / (win(v, 5).sum() / 5 + 1e-9)) and r.volume_persistence == near(r.rvol_5m / (r.rvol_15m + 1e-9))
        assert r.px_disp_per_rvol == near(abs(r.ret_5m) / (r.rvol_5m + 1e-9)) and r.vol_accel_range == near(r.range_5m / (r.range_15m + 1e-9))
        assert r.gap_pct == near(o[30] / prev_close - 1)
        # the first day has no close before it, so no range over one is known yet
        assert r.med20 is None and r.range_vs_hist is None
    assert got[0].prev_close is None and got[0].range_30m is not None and day_range > 0


def test_a_window_without_a_touch_says_nothing(spark):
    rows = [("a", T0 + i * MIN, 10.0, 10.5, 9.5, 10.0) for i in range(5)] + [("b", T0, 10.0, 10.0, 10.0, 10.0), ("b", T0 + MIN, 10.0, 10.2, 8.0, 9.0)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double")
    e = spark.createDataFrame([("quiet", "a", T0, "LONG"), ("falls", "b", T0, "SHORT"), ("lost", "b", T0, "LONG")], "event_id string, instrument_id string, entry_ts timestamp_ntz, side string")
    got = {r.event_id: (r.ambiguous, r.target_first, r.stop_first) for r in oc.barriers(e, bars, 10, 0.1, 0.1).collect()}
    assert got == {"quiet": (False, None, None), "falls": (False, True, False), "lost": (False, False, True)}


def test_hold_near_high_and_parabolic(spark):
    day = T0.date()
    rows = [("x", day, T0 + i * MIN, 570 + i, True, 12.0, h, lo, c) for i, (h, lo, c) in enumerate([(12.5, 12.0, 12.4), (12.5, 12.3, 12.45), (12.4, 12.3, 12.4), (12.6, 12.4, 12.5), (12.7, 12.4, 12.6)])]
    rows += [("y", day, T0 + i * MIN, 570 + i, True, 12.0, h, lo, c) for i, (h, lo, c) in enumerate([(12.5, 12.0, 12.4), (12.5, 11.0, 11.2), (12.6, 12.3, 12.4)])]
    bars = spark.createDataFrame(rows, "instrument_id string, session_date date, ts_utc timestamp_ntz, minute_of_day int, is_rth boolean, open double, high double, low double, close double")
    state = spark.createDataFrame([("x", day, 10.0), ("y", day, 10.0)], "instrument_id string, session_date date, prev_close double")
    got = ev.hold_near_high(bars, state, (570, 572), (572, 600), 0.15, 0.002, 0.05).collect()
    assert [(r.instrument_id, r.minute_of_day) for r in got] == [("x", 573)]  # y closed far below its high
    assert ev.hold_near_high(bars, state.withColumn("prev_close", F.lit(11.9)), (570, 572), (572, 600), 0.15, 0.002, 0.05).count() == 0


def test_tails_and_peers(spark):
    values = [1.0, 2.0, 3.0, 100.0, None]
    g = spark.createDataFrame([(f"n{i}", dt.date(2024, 1, 9), 600, v) for i, v in enumerate(values)], "instrument_id string, trading_date date, minute_of_day int, resid double")
    one = grid.cross_section(g, "resid", 1.0).first()
    assert one.xs_tail_imbalance == pytest.approx(0.25) and grid.cross_section(g, "resid").first().xs_tail_imbalance == 0.0
    edges = spark.createDataFrame([(dt.date(2024, 1, 8), "n1", "n0", 0.3), (dt.date(2024, 1, 8), "n3", "n0", 0.1), (dt.date(2024, 1, 8), "n4", "n0", 0.4), (dt.date(2024, 1, 1), "n2", "n0", 0.9)], "as_of date, leader_id string, follower_id string, lag_corr double")
    r = {x.instrument_id: x for x in graph.peer_features(g, edges).collect()}
    n0 = r["n0"]
    assert n0.leader_shock == pytest.approx((0.3 * 2 + 0.1 * 100) / 0.8) and n0.leader_agreement == pytest.approx(0.5) and n0.peer_return == pytest.approx(51.0)
    assert n0.peer_dispersion == pytest.approx(51.0) and n0.leader_count == 3 == n0.peer_count and n0.response_gap == pytest.approx(n0.leader_shock - 1.0)
    assert r["n1"].leader_shock is None and r["n1"].response_gap is None and not r["n1"].graph_available and r["n1"].leader_count == 0


def test_reality_check_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.02, 1, (30, 4))
    x[:, 3] -= 2
    x[rng.random(x.shape) < 0.2] = np.nan
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    rows = [(f"r{j}", days[i], float(x[i, j])) for i in range(30) for j in range(4) if np.isfinite(x[i, j])]
    r = st.reality_check(spark.createDataFrame(rows, "rule string, session_date date, m double"), 100).first()
    stat = lambda a, c: np.nanmax((np.nanmean(a, 0) - c) / np.maximum(np.nanstd(a, 0, ddof=1) / np.sqrt(30), 1e-12))
    seen, centre, slot = stat(x, 0), np.maximum(np.nanmean(x, 0), 0), np.arange(30)
    drawn = lambda k: [int(hashlib.md5(f"7:{k}:{j}".encode()).hexdigest()[:12], 16) % 30 for j in slot]
    draws = [stat(x[drawn(k)], centre) for k in range(100)]
    assert r.best_t == pytest.approx(seen) and r.rules == 4 and r.days == 30
    assert r.p_value == pytest.approx((sum(d >= seen - 1e-9 for d in draws) + 1) / 101)


@pytest.mark.parametrize("whole", [20_000, 10])
def test_ranks_by_brackets_equal_a_sort(spark, monkeypatch, whole):
    monkeypatch.setattr(core, "RANKED_WHOLE", whole)
    monkeypatch.setattr(core, "NEAR", 0.02)
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], i, float(np.round(rng.normal(), 1))) for i in range(3000)] + [("one", 9999, 1.5)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(5)
    top = core.with_top(df.filter("g is not null"), ["g"], F.col("x"), lambda n: F.ceil(n * 0.1), 0.1, ["id"]).filter("_top").collect()
    q = {r.g: r.q for r in core.exact_percentiles(df.filter("g is not null"), ["g"], "x", (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    for g in ("a", "b", "one"):
        own = sorted(((-x, i) for k, i, x in rows if k == g))
        assert {r.id for r in top if r.g == g} == {i for _, i in own[: int(np.ceil(len(own) * 0.1))]}
        assert q[g] == pytest.approx(np.quantile([-x for x, _ in own], [0, 0.25, 0.5, 0.99, 1]))
    everything = core.with_top(df, [], F.col("x"), lambda n: F.round(n * 0.05), 0.05, ["id"])
    assert everything.filter("_top").count() == 150 and set(everything.columns) == {"g", "id", "x", "_top", "_n"} - {"_n"} | ({"_n"} & set(everything.columns))
    assert core.with_top(df.limit(0), ["g"], F.col("x"), lambda n: n, 0.1, ["id"]).count() == 0


def test_scaler_knows_the_training_days_only(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 100.0), (2, None)], "day int, x double")
    got = [r.z_x for r in models.standardised(df, ["x"], df.filter("day = 1")).orderBy("day", "x").collect()]
    assert got == [-1.0, 1.0, 0.0, 98.0]


def planted(spark, n=4000, noise=1.0, effect=1.0):
    rng = np.random.default_rng(5)
    a, b, flag = rng.random(n), rng.random(n), rng.random(n) < 0.5
    y = noise * rng.standard_normal(n) + effect * ((a > 0.7) & flag)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i % 20)) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame({"instrument_id": [f"n{i % 7}" for i in range(n)], "session_date": day, "a": a, "b": b, "flag": flag, "y": y}))


def test_tree_finds_a_planted_rule_and_nothing_in_noise(spark):
    p = planted(spark).cache()
    rules_ = tree.grow(p, ["a", "b", "flag"], "y", depth=2, least=100)
    assert {f for r in rules_ for f, _, _ in r.path} == {"a", "flag"}
    best = max(rules_, key=lambda r: r.mean)
    cuts = {f: (op, c) for f, op, c in best.path}
    assert cuts["flag"] == ("==", 1.0) and cuts["a"][0] == ">" and abs(cuts["a"][1] - 0.7) < 0.02
    row = p.filter(tree.holds(best.path)).agg(F.count("*").alias("n"), F.avg("y").alias("m")).first()
    assert (best.n, best.direction) == (row.n, "LONG") and best.mean == pytest.approx(row.m)
    assert tree.grow(planted(spark, effect=0.0), ["a", "b", "flag"], "y", depth=2, alpha=0.01, least=100) == []
    assert tree.grow(p, ["a"], "y", depth=2, least=100_000) == []


def test_association_equals_plain_statistics(spark):
    p = planted(spark, 1200).withColumn("_node", F.lit("all"))
    got = {r.feature: r.p for r in tree.associations(p, ["a", "flag"], ["flag"], "y").collect()}
    rows = p.toPandas()
    rho = rows.groupby("session_date")[["a", "y"]].apply(lambda d: d["a"].rank().corr(d["y"].rank()))
    from eventide.functions.tdist import t_p_values

    t = rho.mean() * np.sqrt(len(rho)) / rho.std(ddof=1)
    assert got["a"] == pytest.approx(t_p_values(np.array([t]), np.array([len(rho) - 1.0]))[0], rel=1e-6)
    diff = rows.groupby("session_date")[["flag", "y"]].apply(lambda d: d["y"][d["flag"]].mean() - d["y"][~d["flag"]].mean())
    t = diff.mean() * np.sqrt(len(diff)) / diff.std(ddof=1)
    assert got["flag"] == pytest.approx(t_p_values(np.array([t]), np.array([len(diff) - 1.0]))[0], rel=1e-6)
    few = tree.associations(p.limit(20), ["a", "flag"], ["flag"], "y").collect()
    assert all(r.p == 1.0 and r.q_value == 1.0 for r in few)
    seven = tree.associations(p.filter("session_date < '2024-01-08'"), ["a", "flag"], ["flag"], "y").collect()
    assert all(r.p == 1.0 and r.days == 7 for r in seven)  # seven days are too few
    one, zero = rows[rows["flag"]]["y"], rows[~rows["flag"]]["y"]
    v1, v0 = one.var() / len(one), zero.var() / len(zero)
    df = (v1 + v0) ** 2 / (v1**2 / (len(one) - 1) + v0**2 / (len(zero) - 1))
    w = tree.welch(p, ["flag"], "y").first()
    assert w.t == pytest.approx((one.mean() - zero.mean()) / np.sqrt(v1 + v0)) and w.df == pytest.approx(df)
    assert w.p == pytest.approx(t_p_values(np.array([w.t]), np.array([df]))[0], rel=1e-6)


def test_rules_lose_conditions_that_say_nothing(spark):
    p = planted(spark, 6000, noise=0.3).cache()
    path = [("a", ">", 0.7), ("flag", "==", 1.0), ("b", ">", 0.5)]
    [short] = tree.simplified(p, [tree.Rule(path, 10, 1.0)], "y", 50, 5)
    assert [f for f, _, _ in short.path] == ["a", "flag"] and short.log
    [kept] = tree.simplified(p, [tree.Rule(path, 10, 1.0)], "y", 10**9, 5)
    assert kept.path == path


def test_paths_that_come_back(spark):
    p = planted(spark, 4000, noise=0.2).cache()
    found = tree.grow(p, ["a", "flag"], "y", depth=2, least=100)
    deep = max(found, key=lambda r: len(r.path))
    backward = tree.Rule(list(reversed(deep.path)), 5, deep.mean)
    other_way = [tree.Rule(r.path, r.n, -r.mean) for r in found]
    asked = [*found, tree.Rule([("b", ">", 0.5)], 5, 1.0), backward, *other_way]
    got = tree.path_stability(p, asked, ["a", "flag"], "y", 6, depth=2, least=50)
    own, (b, back), other = got[: len(found)], got[len(found) : len(found) + 2], got[len(found) + 2 :]
    assert max(x["found"] for x in own) == 1.0 and any(x["stable"] for x in own)
    assert b["found"] == 0.0 and not b["stable"] and b["settled"] == 4  # three of six can't be reached after four misses
    assert back["found"] == 0.0  # the order of the path counts
    assert all(o["agreed"] == 0.0 and not o["stable"] for x, o in zip(own, other) if x["stable"])
    assert got[0]["features"]["a"] == got[0]["features"]["flag"] == 6


def test_a_hundred_trees_take_the_jobs_of_one(spark):
    p = planted(spark, 3000, noise=0.3).cache()
    sc = spark.sparkContext

    def jobs_of(name, f):
        sc.setJobGroup(name, "")
        out = f()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))

    one = tree.half_samples(p.select("session_date"), "session_date", 1)
    many = tree.half_samples(p.select("session_date"), "session_date", 100)
    assert {r.n for r in many.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {10} and many.select("fold").distinct().count() == 100
    tree_args = (["a", "b", "flag"], "y", 2, 0.05, 50)
    _, few = jobs_of("one tree", lambda: tree.forest(p, one, *tree_args))
    grown, all_ = jobs_of("many trees", lambda: tree.forest(p, many, *tree_args))
    assert all_ <= few + 12, (few, all_)  # adaptive stages differ by a few; a hundred times as many they aren't
    assert sum({f for r in own for f, _, _ in r.path} >= {"a", "flag"} for own in grown.values()) >= 95
    for fold in (3, 71):
        days = [r.day for r in many.filter(F.col("fold") == fold).collect()]
        alone = tree.grow(p.filter(F.col("session_date").isin(days)), *tree_args)
        assert [(str(r), r.n, round(r.mean, 9)) for r in alone] == [(str(r), r.n, round(r.mean, 9)) for r in grown[fold]]


def test_cuts_of_folds_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=900), np.round(rng.normal(size=900), 1), rng.integers(0, 3, 900).astype(float), np.where(rng.random(900) < 0.3, np.nan, rng.random(900))])
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i % 12)) for i in range(900)]
    panel = spark.createDataFrame(pd.DataFrame({"n": "a", "day": day, **{f"f{j}": x[:, j] for j in range(4)}, "y": 1.0}))
    rows = tree.panel_rows(panel, ["f0", "f1", "f2", "f3"], "y", name="n", day="day")
    folds = tree.half_samples(rows.select("day"), "day", 5).cache()
    for bins in (200, 7):
        monkeypatch.setattr(tree, "BINS", bins)
        got = {}
        for r in tree.fold_cuts(rows, folds, [0, 1, 2, 3]).collect():
            got.setdefault((r.fold, r.f), []).append(r.cut)
        for k in range(5):
            own = {r.day for r in folds.filter(F.col("fold") == k).collect()}
            inside = np.array([d in own for d in day])
            for j in (0, 1, 3):
                want = np.unique(np.round(np.nanquantile(x[inside, j], np.arange(1, 10) / 10), 12))
                assert sorted(got[k, j]) == pytest.approx(sorted(want), abs=1e-9)
            assert (k, 2) not in got  # three different values are too few


def test_forest_keeps_no_rows_by_fold(spark, monkeypatch):
    p = planted(spark, 2000, noise=0.3).cache()
    kept, write = [], tree.stored
    monkeypatch.setattr(tree, "stored", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    folds = tree.half_samples(p.select("session_date"), "session_date", 40)
    assert len(tree.forest(p, folds, ["a", "flag"], "y", 2, 0.05, 50)) == 40
    rows = {name: df.count() for name, df in kept if name not in ("folds", "places")}
    assert sum(rows.values()) <= 2 * 2000, rows  # forty trees on half of the rows were 40000 rows a level


def test_ranks_within_nodes_equal_pandas(spark):
    rng = np.random.default_rng(8)
    n, days, folds = 1500, 3, 4
    d = rng.integers(0, days, n)
    x = np.column_stack([rng.normal(size=n), np.where(rng.random(n) < 0.6, 0.0, np.round(rng.normal(size=n), 1)), np.where(rng.random(n) < 0.2, np.nan, rng.random(n))])
    y = np.where(rng.random(n) < 0.4, -0.0, np.round(rng.normal(size=n), 1))  # frequent values on both sides
    table = spark.createDataFrame([(int(a), float(b), [None if np.isnan(v) else float(v) for v in c]) for a, b, c in zip(d, y, x)], "d int, y double, x array<double>")
    inside = rng.random((days, folds)) < 0.7
    inside[:, 0] = True
    paths = [[[(0, above, 0.1 * j)], [(0, not above, 0.1 * j), (2, True, 0.3)]] for j, above in enumerate((True, False, True, True))]
    nodes = tree.Nodes(inside, paths)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # equal values lie in many batches
    try:
        got = {(r.j, r.c, r.d, r.f): r.s for r in tree.rank_statistics(table.repartition(3), nodes, [0, 1, 2]).collect()}
        pairs = tree.name_days(table.withColumn("name", (F.col("y") > 0).cast("string")), nodes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, met = {}, {}
    for j in range(folds):
        for c, path in enumerate(paths[j], 1):
            on = inside[d, j] & np.logical_and.reduce([(x[:, f] > cut) if above else (x[:, f] <= cut) for f, above, cut in path])
            met[j, c] = len({(a, b > 0) for a, b in zip(d[on], y[on])})
            for k in range(days):
                for f in range(3):
                    at = on & (d == k) & ~np.isnan(x[:, f])
                    rho = pd.Series(x[at, f]).rank().corr(pd.Series(y[at]).rank()) if at.sum() >= 10 else np.nan
                    if not np.isnan(rho):
                        want[j, c, k, f] = rho
    assert got == pytest.approx(want, abs=1e-12) and len(want) > 40
    assert pairs == met


def test_days_of_a_study_come_from_ticks(spark, sf_dir):
    from eventide.plans import base

    days = lambda df: sorted(r.session_date for r in df.select("session_date").distinct().collect())
    assert days(base.session_days(spark, sf_dir)) == days(base.session_bars(spark, sf_dir))


def test_children_need_a_share_of_their_parents_parent(spark):
    p = planted(spark, 4000, noise=0.3).cache()
    found = tree.grow(p, ["a", "flag"], "y", depth=2, least=50)
    assert max(len(r.path) for r in found) == 2
    big = max(r.n for r in found if len(r.path) == 2)
    first = [tree.holds(r.path[:1]) for r in found if r.n == big][0]
    root_share = big / p.count()
    assert root_share < big / p.filter(first).count()
    # at the second level the share is of the first split's rows: of the whole table the same share would be too much to ask
    tight = tree.grow(p, ["a", "flag"], "y", depth=2, least=50, parent_share=root_share + 0.02)
    assert max(len(r.path) for r in tight) <= 2 and len(tight) <= len(found)
    assert tree.grow(p, ["a", "flag"], "y", depth=2, least=50, parent_share=0.99) == []


def test_estimates_of_rules_by_day(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 2.0), ("b", 2, 5.0), ("c", 3, None)]
    p = spark.createDataFrame([(n, dt.date(2024, 1, d), y, float(d)) for n, d, y in rows], "instrument_id string, session_date date, y double, x double")
    got = {r.rule: r for r in rules.estimated(p, {"all": F.lit(True), "one": F.col("x") == 1, "two": F.col("x") == 2}, "y", 2, 1, 2, 0.6).collect()}
    assert got["all"].se == pytest.approx(np.std([2.0, 5.0], ddof=1) / 2**0.5) and (got["all"].n, got["all"].name_days, got["all"].days, got["all"].names) == (4, 3, 2, 2)
    assert got["one"].se == pytest.approx(np.std([1, 3, 2], ddof=1) / 3**0.5) and got["one"].kill == "concentration" and got["all"].kill is None
    assert got["two"].kill == "sample" and got["two"].top_name_share == 1.0


def test_jobs(spark):
    one = jobs.Job("g", "gap", "x >= {cut}", "case when x > 0 then 'LONG' end")
    made = [*jobs.variants(one, "cut", {"low": "1", "high": "5"}), jobs.opposite(jobs.Job("q", "gap", "x = 2", "'LONG'"), "fade")]
    day = T0.date()
    rows = spark.createDataFrame([("a", day, T0 + i * MIN, float(x)) for i, x in enumerate((0, 2, 7, 2))], "instrument_id string, session_date date, ts_utc timestamp_ntz, x double")
    got = sorted((r.job_id, r.event_id.rsplit("-", 1)[1], r.side) for r in jobs.job_events(rows, made, 1).collect())
    assert got == [("g.high", "202401021403", "LONG"), ("g.low", "202401021402", "LONG"), ("q.fade", "202401021402", "SHORT")]
    assert [r.parent for r in jobs.job_table(spark, made).orderBy("job_id").collect()] == ["g", "g", "q"]
    with pytest.raises(ValueError):
        jobs.job_table(spark, [one, one])


def test_projection_and_filling(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert daybuild.projected(df, ["b"]).columns == ["b"]
    with pytest.raises(ValueError, match="c"):
        daybuild.projected(df, ["a", "c"])
    assert daybuild.filled(df, {"a": 9.0, "z": None}).first().asDict() == {"a": 1, "b": 2, "z": None}


def test_stores_round_trip(spark, tmp_path):
    root = str(tmp_path)
    a, b = spark.createDataFrame([("x", 1.0)], "instrument_id string, close double"), spark.createDataFrame([("y", 2.0, 3.0)], "instrument_id string, close double, vwap double")
    a.write.parquet(f"{root}/pilot/2024/01")
    b.write.parquet(f"{root}/pilot/2024/02/deep")
    name, found = stores.resolved(spark, root, "panel")
    assert name == "pilot" and {(r.instrument_id, r.vwap) for r in found.collect()} == {("x", None), ("y", 3.0)}
    with pytest.raises(FileNotFoundError):
        stores.resolved(spark, root, "nothing")
    r = spark.createDataFrame([("j1", 1.0), ("j2", 2.0), ("j1", 3.0)], "job_id string, forward_return double")
    stores.write_job_returns(r, f"{root}/returns", "b", "fast")
    stores.write_job_returns(r.filter("job_id = 'j2'"), f"{root}/returns", "b", "full")
    assert stores.read_job_returns(spark, f"{root}/returns", "b", "fast", ["j1"]).count() == 2 and stores.read_job_returns(spark, f"{root}/returns", "b", "full").count() == 1
    for e in ("H1", "H2"):
        stores.append_experiment(a, f"{root}/events", e)
    assert spark.read.parquet(f"{root}/events").filter("experiment_id = 'H2'").count() == 1
    stores.append_records(spark.createDataFrame([("Gap Up", 1), ("other", 2)], "name string, n int"), f"{root}/log")
    assert [x.n for x in stores.search_records(spark, f"{root}/log", "gap").collect()] == [1]
    week = dt.date(2024, 1, 8)
    stores.write_graph(spark.createDataFrame([(week, "a", "b", 0.5)], "as_of date, leader_id string, follower_id string, lag_corr double"), spark.createDataFrame([(week, 3)], "as_of date, tests long"), f"{root}/graph")
    edges, lineage = stores.read_graph(spark, f"{root}/graph")
    assert edges.first().lag_corr == 0.5 and lineage.first().tests == 3
    keys = "instrument_id string, trading_date string, minute_of_day int"
    spark.createDataFrame([("a", "2024-01-02", 600, 1.0), ("a", "2024-01-03", 600, 2.0)], keys + ", r double").write.parquet(f"{root}/base")
    spark.createDataFrame([("a", "2024-01-02", 600, 7.0)], keys + ", shock double").write.parquet(f"{root}/over")
    assert [tuple(x) for x in stores.load_panel(spark, f"{root}/base", f"{root}/over", ["2024-01-02"], ["r", "shock"]).collect()] == [(1.0, 7.0)]


def test_news_cache_and_manifests(spark, tmp_path):
    root = str(tmp_path)
    n = spark.createDataFrame([("a", T0 + dt.timedelta(microseconds=5), 1), ("b", T0 + dt.timedelta(days=40), 2)], "instrument_id string, published_ts timestamp_ntz, article_id long")
    stores.write_news_cache(n, f"{root}/news")
    assert sorted(tuple(r) for r in stores.read_news_cache(spark, f"{root}/news").select("article_id", "published_ts").collect()) == [(1, T0 + dt.timedelta(microseconds=5)), (2, T0 + dt.timedelta(days=40))]
    lines = [{"file": "a", "status": "FAILED", "bytes": 1, "rows": 0, "seconds": 1.0, "at": "1"}, {"file": "a", "status": "OK", "bytes": 10, "rows": 4, "seconds": 2.0, "at": "2"}, {"file": "b", "status": "OK", "bytes": 20, "rows": 6, "seconds": 1.0, "at": "1"}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    assert [tuple(r) for r in stores.manifest_status(spark, f"{root}/m.json").collect()] == [("OK", 2, 30, 10, 10.0)]
    assert stores.spec_hash({"b": 1, "a": [2]}) == stores.spec_hash({"a": [2], "b": 1}) != stores.spec_hash({"a": [2], "b": 2})
    files = spark.createDataFrame([("x", T0, 5), ("y", T0, 6)], "path string, modificationTime timestamp_ntz, length long").withColumn("modificationTime", F.col("modificationTime").cast("timestamp"))
    one, two = (stores.manifest_hash(f).first() for f in (files, files.orderBy(F.desc("path"))))
    assert one == two and (one.files, one.bytes) == (2, 11) and stores.manifest_hash(files.limit(1)).first().digest != one.digest


def test_watchdog_counts_empty_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 6)], "session_date date")
    health = spark.createDataFrame([(dt.date(2024, 1, 1), 5, 0.0), (dt.date(2024, 1, 4), 3, 1.0)], "session_date date, rows long, nulls double")
    got = [(r.rows, r.empty_streak, r.all_null) for r in quality.watchdog(health, days).orderBy("session_date").collect()]
    assert got == [(5, 0, False), (0, 1, False), (0, 2, False), (3, 0, True), (0, 1, False)]


def test_instruments_from_landed_tickers(spark):
    rows = [("A", "CS", "XNAS", "F1", None, None), ("B", "", "amex", None, "12", False), ("C", "ADRC", "XNYS", "", "", True), ("D", "etf", "XNAS", "F4", None, True), ("E", "CS", "OTC", "F5", None, True), ("F", "Warrant", "NYE", None, None, True)]
    raw = spark.createDataFrame(rows, "ticker string, type string, primary_exchange string, composite_figi string, cik string, active boolean").withColumns({"list_date": F.lit(None).cast("string"), "delisted_utc": F.lit(None).cast("string")})
    got = {r.ticker: (r.instrument_id, r.exchange, r.security_type, r.active) for r in src.instruments_from_json(raw).collect()}
    assert got == {
        "A": ("figi:F1", "NASDAQ", "COMMON_STOCK", True), "B": ("cik:12", "NYSE_AMERICAN", "COMMON_STOCK", False), "C": ("ticker:C", "NYSE", "ADRC", True), "F": ("ticker:F", "NYSE_AMERICAN", "Warrant", True),
    }


def test_false_discoveries_by_buckets_equal_a_sort(spark):
    rng = np.random.default_rng(8)
    rows = [(["a", "b"][i % 2], i, float(np.round(rng.random() ** 4, 3)) if i % 11 else None) for i in range(900)] + [("c", 1, 0.2), ("d", 1, None), ("a", 5000, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, p double").repartition(3)
    one, two = (sorted((r.g, r.id, None if r.q_value is None else round(r.q_value, 9), r.rejected) for r in f(df, "p", ["g"], 0.1, ["id"]).collect()) for f in (core.with_bh, core.with_bh_wide))
    assert one == two and len(one) == len(rows) and any(x[3] for x in one)
    assert core.with_bh_wide(df.limit(0), "p", ["g"], 0.1, ["id"]).count() == 0


def test_block_correlations_equal_pandas(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    rng, rows = np.random.default_rng(9), []
    for k in range(8):
        for day in range(3):
            for m in range(0, 200, 5):
                if rng.random() < 0.7:
                    rows.append((dt.date(2024, 1, 8), f"n{k}", dt.date(2024, 1, 2 + day), m, 0.5 if k == 7 else float(rng.normal())))
    hist = spark.createDataFrame(rows, "as_of date, instrument_id string, trading_date date, minute_of_day int, resid double")
    got = {(r.leader_id, r.follower_id): r for r in graph.pair_statistics(hist, "resid", 40).collect()}
    x = pd.DataFrame([r[1:] for r in rows], columns=["i", "d", "m", "x"]).sort_values(["i", "d", "m"])
    x["nxt"] = x.groupby(["i", "d"])["x"].shift(-1)
    wide, nxt = x.pivot(index=["d", "m"], columns="i", values="x"), x.pivot(index=["d", "m"], columns="i", values="nxt")
    assert len(got) == 56
    for (a, b), r in got.items():
        c, lag = wide[a].corr(wide[b]), wide[a].corr(nxt[b])
        assert (r.corr is None and "n7" in (a, b)) or r.corr == pytest.approx(c)
        assert (r.lag_corr is None and "n7" in (a, b)) or r.lag_corr == pytest.approx(lag)
        assert (r.n, r.lag_n) == (int((wide[a].notna() & wide[b].notna()).sum()), int((wide[a].notna() & nxt[b].notna()).sum()))
