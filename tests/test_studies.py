"""Outcomes by horizon, resampling, day build and its resumption against plain restatements."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import daybuild, grid
from eventide.operators import outcomes as oc
from eventide.operators import statistics as st
from eventide.sources import stores

T0 = dt.datetime(2024, 1, 2, 14, 30)
MIN = dt.timedelta(minutes=1)


def scanned(bars, entry, side, take, stop):
    """mfe, mae, ambiguous, target_first, stop_first of bars (high, low) in order."""
    mfe = mae = 0.0
    for high, low in bars:
        best, worst = (high / entry - 1, low / entry - 1) if side == "LONG" else (1 - low / entry, 1 - high / entry)
        mfe, mae = max(mfe, best), min(mae, worst)
        if best >= take or worst <= -stop:
            both = best >= take and worst <= -stop
            return mfe, mae, both, None if both else best >= take, None if both else worst <= -stop
    return mfe, mae, False, None, None


def test_excursions_of_each_horizon_equal_a_scan_of_its_own(spark):
    rng, bars, events = np.random.default_rng(3), {}, []
    for name in "abcd":
        c = 100 + np.cumsum(rng.normal(0, 0.6, 90))
        bars[name] = [(T0 + i * MIN, float(c[i]), float(c[i] + rng.random() * 1.5), float(c[i] - rng.random() * 1.5), float(c[i])) for i in range(90) if i % 17 and (name != "d" or not 20 < i < 45)]
        events += [(f"{name}{i}{side}", name, T0 + int(i) * MIN, side) for i in (*rng.integers(0, 88, 12), 21, 95) for side in ("LONG", "SHORT")]
    events = list({e[0]: e for e in events}.values())
    b = spark.createDataFrame([(n, *r) for n, rows in bars.items() for r in rows], "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double")
    e = spark.createDataFrame(events, "event_id string, instrument_id string, entry_ts timestamp_ntz, side string")
    horizons = {"5m": 5, "15m": 15, "1h": 60}
    got = {(r.event_id, r.horizon): r for r in oc.full_outcomes(e, b, horizons, 1, 0.015, 0.012).collect()}
    want = 0
    for event_id, name, at, side in events:
        future = [r for r in bars[name] if r[0] >= at]
        for h, minutes in horizons.items() if future else ():
            want += 1
            r, entry = got[event_id, h], future[0][1]
            own = scanned([(x[2], x[3]) for x in future if x[0] < at + minutes * MIN], entry, side, 0.015, 0.012)
            assert (r.mfe, r.mae) == pytest.approx(own[:2]) and (r.ambiguous, r.target_first, r.stop_first) == own[2:]
            exits = [x[4] for x in future if x[0] == at + (minutes - 1) * MIN]
            move = exits[0] / entry - 1 if exits else None
            assert r.forward_return == (None if move is None else pytest.approx(move if side == "LONG" else -move))
    assert len(got) == want and any(got[e[0], "5m"].mfe != got[e[0], "1h"].mfe for e in events if (e[0], "5m") in got)
    assert any(r.ambiguous for r in got.values()) and any(r.target_first for r in got.values()) and any(r.stop_first for r in got.values())
    assert oc.full_outcomes(e.limit(0), b, horizons, 1, 0.015, 0.012).count() == 0


@pytest.mark.parametrize("days", [20, 30, 31, 60])
def test_replicates_spread_as_a_sample_does(spark, days):
    rng = np.random.default_rng(days)
    m = rng.normal(size=days)
    rows = [("r", T0.date() + dt.timedelta(days=i), float(v)) for i, v in enumerate(m)]
    r = spark.createDataFrame(rows, "rule string, session_date date, forward_return double")
    got = np.array([x.m for x in st.replicate_means(r, ["rule"], 1500).collect()])
    draws = rng.integers(0, days, (4000, days))
    want = m[draws].mean(1)
    assert len(got) == 1500 and abs(got.std() / want.std() - 1) < 0.1 and abs(got.mean() - m.mean()) < 4 * want.std() / 1500**0.5
    ci = st.bootstrap(r, ["rule"], 1500).first()
    assert ci.ci_high - ci.ci_low == pytest.approx(np.quantile(want, 0.975) - np.quantile(want, 0.025), rel=0.12)
    other = np.array([x.m for x in st.replicate_means(r, ["rule"], 300, seed=8).collect()])
    assert not set(np.round(other, 12)) <= set(np.round(got, 12))


def test_reality_check_is_level_under_no_edge(spark):
    """Of many panels without an edge about a tenth have p below 0.1."""
    rng, rows = np.random.default_rng(1), []
    p = []
    for k in range(12):
        rows = [(f"r{j}", T0.date() + dt.timedelta(days=i), float(v)) for i in range(40) for j, v in enumerate(rng.normal(size=4))]
        p.append(st.reality_check(spark.createDataFrame(rows, "rule string, session_date date, m double"), 100, seed=k).first().p_value)
    assert 0.2 < np.mean(p) < 0.8 and min(p) > 0.005
    edge = [(f"r{j}", T0.date() + dt.timedelta(days=i), float(v + 0.8 * (j == 2))) for i in range(40) for j, v in enumerate(rng.normal(size=4))]
    assert st.reality_check(spark.createDataFrame(edge, "rule string, session_date date, m double"), 100).first().p_value < 0.02


COLUMNS = "ret_5m ret_10m ret_15m path_abs_5 close close_location_value rth_high_so_far rth_low_so_far rvol_5m rvol_10m volume_5m volume transactions range_15m med20 pm_ret gap_pct mkt_ret_5m typ_1m_vol prev_close resid_5m".split()


def feature_rows(spark, days=26, names="abcde", clocks=20):
    rng = np.random.default_rng(9)
    rows = []
    for d in range(days):
        for n in names:
            for k in range(clocks):
                v = {c: float(abs(rng.normal()) + 0.5) for c in COLUMNS} | {c: float(rng.normal(0, 0.02)) for c in ("ret_5m", "ret_10m", "ret_15m", "mkt_ret_5m", "gap_pct")}
                v["prev_close"], v["typ_1m_vol"] = (0.5 if n == "e" else 20.0), 1000.0 * (1 + ord(n) % 5)
                if rng.random() < 0.05:
                    v["ret_5m"] = None
                day = T0.date() + dt.timedelta(days=d)
                rows.append((n, day, T0 + dt.timedelta(days=d) + 5 * k * MIN, T0 + dt.timedelta(days=d) + (5 * k + 1) * MIN, 570 + 5 * k, 5 * k, *(v[c] for c in COLUMNS)))
    schema = "instrument_id string, session_date date, ts_utc timestamp_ntz, decision_ts timestamp_ntz, minute_of_day int, minutes_from_open int, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_activity_and_flags_by_their_formulas(spark):
    f = feature_rows(spark, days=1, names="ab")
    t = daybuild.Thresholds(1.0, 0.012, 0.02, 1.0, 1.2)
    got = daybuild.with_flags(daybuild.with_activity(f), t).orderBy("instrument_id", "ts_utc").collect()
    for name in "ab":
        own = [r for r in got if r.instrument_id == name]
        for i, r in enumerate(own):
            five = own[i - 5] if i >= 5 else None
            near = lambda v: None if v is None else pytest.approx(v, rel=1e-9)
            assert r.activity_acceleration == near(None if five is None else r.volume_5m / (five.volume_5m + 1e-9))
            known = r.ret_5m is not None
            assert r.ret_accel_5m == near(r.ret_5m - five.ret_5m if known and five is not None and five.ret_5m is not None else None)
            assert r.signed_path_eff_5m == near(r.ret_5m / (r.path_abs_5 / (r.close + 1e-12) + 1e-12) if known else None)
            last = [x.ret_5m for x in own[max(0, i - 14) : i + 1] if x.ret_5m is not None]
            swing = r.close * (np.std(np.abs(last), ddof=1) + 1e-6) if len(last) == 15 else None
            assert r.dist_sess_high_volnorm == near(None if swing is None else (r.rth_high_so_far - r.close) / swing)
            assert r.dist_sess_low_volnorm == near(None if swing is None else (r.close - r.rth_low_so_far) / swing)
            assert (r.close_location_5m, r.rvol_5m_tod) == (r.close_location_value, r.rvol_5m)
            assert r.impulse == (abs(r.ret_10m) >= 0.02 and r.rvol_10m >= 1.0) and r.high_rvol == (r.rvol_5m >= 1.2)
            if known:
                assert r.quiet_px == (abs(r.ret_5m) <= 0.012) and r.h004 == (r.quiet_px and r.rvol_5m >= 1.0)
                assert r.full_state == (r.h004 and r.impulse and r.high_rvol and r.quiet_px and r.mkt_agree)


def test_day_build_against_its_parts_and_resumed(spark, tmp_path):
    f = feature_rows(spark)
    built = daybuild.built(f, (0, 95), 5, 1.0, 1e3, daybuild.Thresholds(), beta_days=20)
    rows = built.collect()
    assert {r.instrument_id for r in rows} == set("abcd")  # e is too cheap
    assert len(rows) == 26 * 4 * 20
    first = min(r.trading_date for r in rows)
    assert all(r.beta is None and r.resid is None for r in rows if (r.trading_date - first).days < 20) and any(r.beta is not None for r in rows)
    by = {(r.instrument_id, r.trading_date, r.minute_of_day): r for r in rows}
    for r in rows[::37]:
        names = [by[n, r.trading_date, r.minute_of_day] for n in "abcd"]
        weights = dict(zip("abcd", np.clip([o.weight_mkt for o in names], *np.quantile([o.weight_mkt for o in names], [0.01, 0.99]))))
        others = [(weights[o.instrument_id], o.ret_5m) for o in names if o.instrument_id != r.instrument_id and o.ret_5m is not None]
        assert r.mkt == (pytest.approx(sum(w * x for w, x in others) / sum(w for w, _ in others), abs=1e-12) if others else None)
        ahead = [by.get((r.instrument_id, r.trading_date, r.minute_of_day + 5 * k)) for k in (1, 2, 3)]
        if r.beta is not None and all(a is not None and a.ret_5m is not None for a in ahead):
            stock, market = np.prod([1 + a.ret_5m for a in ahead]) - 1, np.prod([1 + a.mkt for a in ahead]) - 1
            assert r.future_residual == pytest.approx(stock - r.beta * market, abs=1e-12)
        elif r.beta is not None:
            assert r.future_residual is None
        past = [np.mean([o.ret_5m for o in rows if o.trading_date == d and o.minute_of_day == r.minute_of_day and o.ret_5m is not None]) for d in sorted({x.trading_date for x in rows}) if d < r.trading_date]
        assert r.same_clock_mean == (pytest.approx(np.mean(past), abs=1e-12) if past else None)
    path = f"file://{tmp_path}/built"
    half = built.filter(F.col("trading_date") <= F.lit(first + dt.timedelta(days=9)))
    assert stores.write_missing_days(half, path, "trading_date") == 10
    assert stores.write_missing_days(built, path, "trading_date") == 16
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert stores.write_missing_days(built, path, "trading_date") == 0
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    again = spark.read.schema(built.schema).parquet(path)
    key = lambda r: (r.instrument_id, r.decision_ts)
    assert [r.resid for r in sorted(again.collect(), key=key)] == [r.resid for r in sorted(rows, key=key)]
    with pytest.raises(ValueError, match="repeated keys"):
        daybuild.built(f.unionByName(f.limit(1)), (0, 95), 5, 1.0, 1e3, daybuild.Thresholds())
    assert grid.repeated_keys(built, ["instrument_id", "decision_ts"]).count() == 0


def plain_ridge(x, y, penalty):
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-12, 1.0, sd)
    z = np.hstack([np.ones((len(x), 1)), (x - mu) / sd])
    a = z.T @ z + penalty * np.eye(z.shape[1])
    a[0, 0] -= penalty
    return mu, sd, np.linalg.solve(a, z.T @ y)


def test_ridges_from_day_sums_equal_ridges_on_rows(spark):
    from eventide.operators import models

    rng = np.random.default_rng(6)
    n = 900
    x = np.column_stack([rng.normal(3, 2, n), rng.normal(size=n), np.full(n, 2.0)])
    y = 1 + 0.5 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    day = np.sort(rng.integers(0, 30, n))
    gone = rng.random(n) < 0.05
    rows = [(T0.date() + dt.timedelta(days=int(d)), None if g else float(a), float(b), float(c), float(v)) for d, g, (a, b, c), v in zip(day, gone, x, y)]
    rows += [(T0.date(), 1.0, 1.0, 1.0, None)]
    panel = spark.createDataFrame(rows, "session_date date, a double, b double, c double, y double").repartition(3)
    x[gone, 0] = 0.0
    seen = np.array([(day <= d).sum() for d in day])
    splits = models.split_moments(models.day_moments(panel, ["a", "b", "c"], "y"), (0.3, 0.7, 0.9))
    for share, (first, rest) in splits.items():
        own = seen <= share * n
        assert first[0, 0] == own.sum() and rest[0, 0] == (~own).sum()
        fit, best, errors = models.picked_ridge(first, rest, (0.1, 50.0, 5000.0))
        for p, e in errors.items():
            mu, sd, w = plain_ridge(x[own], y[own], p)
            pred = np.hstack([np.ones(((~own).sum(), 1)), (x[~own] - mu) / sd]) @ w
            assert e == pytest.approx(((pred - y[~own]) ** 2).mean(), rel=1e-8)
        assert best == min(errors, key=errors.get)
        assert fit.weights == pytest.approx(plain_ridge(x[own], y[own], best)[2], rel=1e-7, abs=1e-9)
        _, _, other = models.picked_ridge(first, rest, (50.0,), train_scaler=False)
        mu, sd, w = plain_ridge(x[own], y[own], 50.0)
        pred = np.hstack([np.ones(((~own).sum(), 1)), (x[~own] - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))]) @ w
        assert other[50.0] == pytest.approx(((pred - y[~own]) ** 2).mean(), rel=1e-8)
    scored = panel.withColumn("s", fit.score(["a", "b", "c"]))
    s = np.hstack([np.ones((n, 1)), (x - fit.mean) / fit.deviation]) @ fit.weights
    lo, hi = np.quantile(s, [0.1, 0.9])
    got = models.decile_spread(scored, "s", "y").first()
    assert got.n == n and got.spread == pytest.approx(y[s >= hi].mean() - y[s <= lo].mean())
    assert models.decile_spread(scored.limit(40), "s", "y").first().spread == 0.0
    few = models.split_moments(models.day_moments(panel.limit(30), ["a", "b", "c"], "y"), (0.7,))[0.7]
    assert models.picked_ridge(*few, (1.0,))[2][1.0] == pytest.approx(models.squared_error(models.ridge_of(few[0] + few[1], 1.0), few[0] + few[1]))


def test_news_state_equals_a_plain_count(spark):
    from eventide.operators.news_state import WINDOWS, with_news_state

    rng = np.random.default_rng(12)
    hour = dt.timedelta(hours=1)
    news = []
    for n in "abc":
        for i in range(120):
            at = T0 + int(rng.integers(0, 200)) * 15 * MIN
            news.append((n, at if rng.random() > 0.03 else None, int(rng.integers(-1, 2)) if rng.random() > 0.05 else None, int(rng.integers(0, 60)), ["p", "q", "r", None][rng.integers(0, 4)], int(rng.integers(1, 4))))
    rows = [(n, T0 + int(k) * 15 * MIN) for n in "abcd" for k in sorted(set(rng.integers(-2, 210, 60)))]
    got = with_news_state(
        spark.createDataFrame([(*r, "kept") for r in rows], "instrument_id string, decision_ts timestamp_ntz, note string"),
        spark.createDataFrame(news, "instrument_id string, available_at timestamp_ntz, sentiment_score int, article_id long, publisher string, article_ticker_count int"), ["instrument_id", "decision_ts"],
    ).collect()
    assert len(got) == len(rows) and all(r.note == "kept" for r in got)
    for r in got:
        own = [x for x in news if x[0] == r.instrument_id and x[1] is not None and x[1] <= r.decision_ts]
        last = max(own, key=lambda x: (x[1], x[3]), default=None)
        assert r.minutes_since_latest_available_news == (None if last is None else (r.decision_ts - last[1]) // MIN)
        assert r.latest_article_id == (None if last is None else last[3])
        for name, (h, closed) in WINDOWS.items():
            w = [x for x in own if x[1] > r.decision_ts - h * hour or closed and x[1] == r.decision_ts - h * hour]
            say = lambda c: r[f"{c}_{name}"]  # noqa: B023, E731
            assert [say(f"{k}_count") for k in ("positive", "neutral", "negative")] == [sum(x[2] == v for x in w) for v in (1, 0, -1)]
            assert say("single_ticker_news_count") == sum(x[5] == 1 for x in w) and say("multi_ticker_news_count") == sum(x[5] > 1 for x in w)
            assert say("article_count") == len({x[3] for x in w}) and say("publisher_count") == len({x[4] for x in w} - {None})
            assert say("net_sentiment") == sum(x[2] or 0 for x in w)
        counts = {1: r.positive_count_2h, -1: r.negative_count_2h}
        assert r.same_direction_news_count == counts.get(r.latest_news_sentiment, r.neutral_count_2h)
        assert (r.sentiment_last_2h, r.sentiment_last_4h, r.sentiment_today) == (r.net_sentiment_2h, r.net_sentiment_4h, r.net_sentiment_today)


def plain_relation(a, b):
    """Relation of two families (dicts), by the order of the definitions."""
    core = lambda x: (x["engine"], x["hypothesis"])
    if a["hypothesis"] and a["hypothesis"] == b["hypothesis"] and a["policy"] == b["policy"]:
        return "EXACT_DUPLICATE"
    if a["engine"] == b["engine"] != "unimplemented" and a["direction"] == b["direction"] and a["neighborhood"] and a["neighborhood"] != b["neighborhood"]:
        return "PARAMETER_VARIANT"
    if {a["direction"], b["direction"]} == {"long", "short"} and core(a) == core(b):
        return "DERIVED_OPPOSITE_DIRECTION"
    if a["parent"] == b["id"] or b["parent"] == a["id"] or a["derived_from"] and a["derived_from"] == b["derived_from"]:
        return "DERIVED"
    if set(a["mechanism"]) and set(a["mechanism"]) != set(b["mechanism"]):
        return "DIFFERENT_MECHANISM"
    if set(a["context"]) and not set(a["context"]) & set(b["context"]):
        return "DIFFERENT_CONTEXT_SAME_MECHANISM"
    return "RELATED_OR_UNCLEAR"


def test_family_relations_equal_plain_rules(spark):
    from eventide.operators import jobs

    rng = np.random.default_rng(3)
    pick = lambda *v: v[rng.integers(0, len(v))]
    fams = []
    for i in range(45):
        fams.append({
            "id": f"F{i:02d}", "hypothesis": pick(None, "h1", "h2", f"h{i}"), "policy": pick("first", "all"), "engine": pick("x", "y", "unimplemented"), "direction": pick("long", "short", "signed"), "neighborhood": pick("", "a", "b"),
            "parent": pick(None, None, f"F{int(rng.integers(0, 45)):02d}"), "derived_from": pick(None, None, None, "e1"), "mechanism": pick([], ["m"], ["m", "n"], ["n", "m"]), "context": pick([], ["c"], ["c", "d"], ["d"]),
        })
    got = {(r.id_a, r.id_b): r.relation for r in jobs.family_pairs(spark.createDataFrame([tuple(f.values()) for f in fams], "id string, hypothesis string, policy string, engine string, direction string, neighborhood string, parent string, derived_from string, mechanism array<string>, context array<string>")).collect()}
    want = {(a["id"], b["id"]): plain_relation(a, b) for i, a in enumerate(fams) for b in fams[i + 1 :]}
    assert got == want and len(set(want.values())) == 7
    e = spark.createDataFrame([("F00", "i", 1), ("F01", "i", 1), ("F02", "i", 1), ("F00", "i", 2), ("F02", "i", 2), ("F01", "j", 2)], "job_id string, instrument_id string, decision_ts int")
    pairs = spark.createDataFrame([("F00", "F01"), ("F00", "F02"), ("F01", "F02"), ("F00", "F09")], "id_a string, id_b string")
    assert {(r.id_a, r.id_b): r.shared for r in jobs.shared_events(pairs, e).collect()} == {("F00", "F01"): 1, ("F00", "F02"): 2, ("F01", "F02"): 1, ("F00", "F09"): 0}


def test_gates_and_corrections(spark):
    from eventide.operators import jobs, rules

    rows = [("few", 0.5, 5, 20, 0.1), ("short", 0.5, 50, 3, 0.1), ("one", 0.5, 50, 20, 0.9), ("none", None, 50, 20, 0.1), ("zero", 0.0, 50, 20, 0.1), ("down", -0.5, 50, 20, 0.1), ("up", 0.5, 50, 20, 0.1), ("small", 0.01, 50, 20, 0.1), ("lost", 0.4, 50, 20, 0.1)]
    stage = spark.createDataFrame(rows, "job_id string, mean double, name_days long, days long, top_name_share double")
    frozen = spark.createDataFrame([("down", -1), ("lost", -1), ("few", -1)], "job_id string, direction int")
    got = {r.job_id: (r.original_reason, r.original, r.reason, r.decision) for r in jobs.redirected(stage, frozen, 10, 5, 0.5, 0.05).collect()}
    assert got == {
        "few": ("sample", "KILL", "sample", "KILL"), "short": ("sample", "KILL", "sample", "KILL"), "one": ("concentration", "KILL", "concentration", "KILL"), "none": ("returns", "KILL", "returns", "KILL"),
        "zero": ("size", "KILL", "size", "KILL"), "down": ("sign", "KILL", None, "PASS"), "up": (None, "PASS", None, "PASS"), "small": ("size", "KILL", "size", "KILL"), "lost": (None, "PASS", "sign", "KILL"),
    }
    stats = spark.createDataFrame([("a", 0.5, 0.5, 0.6, 50, 20, 0.1), ("b", 0.5, -0.1, 0.6, 50, 20, 0.1), ("c", 0.5, 0.0, 0.6, 50, 20, 0.1), ("d", 0.5, 0.1, 0.2, 50, 20, 0.1), ("e", -0.5, 0.1, 0.6, 50, 20, 0.1), ("f", 0.5, 0.1, 0.6, 50, 20, 0.1)], "k string, mean double, median double, win_rate double, name_days long, days long, top_name_share double")
    days = spark.createDataFrame([(k, 0.2 if k == "f" else 0.7, 0.1) for k in "abcdef"], "k string, positive_days double, mean_without_best_day double")
    got = {r.k: r.reason for r in rules.directional_gate(stats, days, ["k"], F.lit(0.05), 10, 5, 0.5, 0.5, 0.5).collect()}
    assert got == {"a": None, "b": "median", "c": None, "d": "win_rate", "e": "sign", "f": "days"}


def test_certification_grades(spark):
    from eventide.operators import quality

    T = dt.datetime(2024, 1, 2, 15)
    bar = lambda day, i, **k: {"instrument_id": f"n{i % 4}", "session_date": (T + dt.timedelta(days=day)).date(), "ts_utc": T + dt.timedelta(days=day, minutes=i), "open": 10.0, "high": 11.0, "low": 9.0, "close": 10.0, "volume": 5.0, "transactions": 3, "is_premarket": False, "is_rth": True, "is_after_hours": False} | k
    schema = "instrument_id string, session_date date, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, transactions long, is_premarket boolean, is_rth boolean, is_after_hours boolean"
    none = lambda *names: spark.createDataFrame([], ", ".join(f"{n} boolean" for n in names) or "x int")

    def grades(bars, overnight=None, extreme=None, listed=1, missing=0):
        days = quality.by_date(spark.createDataFrame(bars, schema) if bars else spark.createDataFrame([], schema))
        rows = spark.range(listed), spark.range(missing)
        out = quality.certified(days, quality.coverage_jumps(days), none("explained") if overnight is None else spark.createDataFrame([(x,) for x in overnight], "explained boolean"), none("x") if extreme is None else spark.range(extreme), *rows)
        return {r.category: r.grade for r in out.collect()}

    clean = [bar(d, i) for d in range(4) for i in range(40)]
    want = dict.fromkeys(("coverage", "uniqueness", "ohlc", "timestamps", "splits", "extremes"), "PASS") | {"reference_pit": "WARNING", "instrument_identity": "WARNING", "verdict": "READY_FOR_EXPLORATORY_RESEARCH"}
    assert grades(clean) == want
    assert grades([*clean, bar(0, 3)])["uniqueness"] == "WARNING" and grades([*clean, *[bar(0, 3)] * 100])["uniqueness"] == "FAIL"
    assert grades([*clean, bar(0, 50, close=-1.0, low=-1.0)])["ohlc"] == "WARNING"  # a price below 0 warns
    assert grades([*clean, bar(0, 50, high=1.0)])["ohlc"] == "FAIL" and grades([*clean, bar(0, 50, transactions=-1)])["ohlc"] == "WARNING"
    assert grades([*clean, bar(0, 50, is_rth=False)])["timestamps"] == "WARNING" and grades([*clean, *[bar(0, 50 + i, is_rth=False) for i in range(9)]])["timestamps"] == "FAIL"
    assert grades([*clean, bar(0, 50, ts_utc=T + dt.timedelta(seconds=7))])["timestamps"] == "WARNING"
    assert grades(clean, overnight=[True])["splits"] == "WARNING" and grades(clean, overnight=[False] * 501)["splits"] == "FAIL"
    assert grades(clean, extreme=1)["extremes"] == "WARNING" and grades(clean, listed=0)["verdict"] == "NOT_READY"
    assert grades(clean, missing=1)["coverage"] == "FAIL" and grades([*clean, *[bar(4, i) for i in range(2)]])["coverage"] == "WARNING"
    assert grades([])["coverage"] == "FAIL"


def bars_of(spark, days=30, names="abc"):
    from eventide.sources.bars import SessionSpec, add_session

    rng, rows = np.random.default_rng(2), []
    for n in names:
        c = 50.0
        for d in range(days):
            for k in range(20):
                c = float(np.round(c + rng.normal(0, 0.4), 2))
                rows.append((n, T0 + dt.timedelta(days=d) + 5 * k * MIN, c, c + 0.3, c - 0.3, c + 0.1, float(rng.integers(1, 50)), 3))
    return add_session(spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, transactions long"), SessionSpec())


def test_replay_finds_a_planted_leak_and_nothing_else(spark):
    from pyspark.sql import Window

    from eventide.operators.features import bar_features
    from eventide.operators.leakage import leaks
    from eventide.sources.bars import SessionSpec

    spec, bars = SessionSpec(), bars_of(spark, 6)
    at = F.lit(T0 + dt.timedelta(days=3) + 50 * MIN).cast("timestamp_ntz")
    honest = lambda b: bar_features(b, spec).select("instrument_id", "decision_ts", "ret_5m", "gap_pct", "rvol_5m", "session_high")
    assert leaks(bars, honest, ["instrument_id", "decision_ts"], at, spec.bar_minutes).count() == 0
    ahead = Window.partitionBy("instrument_id").orderBy("ts_utc")
    sly = lambda b: bar_features(b, spec).withColumn("next_close", F.lead("close").over(ahead)).select("instrument_id", "decision_ts", "ret_5m", "next_close")
    got = leaks(bars, sly, ["instrument_id", "decision_ts"], at, spec.bar_minutes).collect()
    assert {(r["replay"], r["column"]) for r in got} == {("truncated", "next_close"), ("poisoned", "next_close")} and len(got) == 6  # the last bar of each of three names
    assert all(r.after is None for r in got if r.replay == "truncated")
    day_high = Window.partitionBy("session_date")
    whole = lambda b: b.withColumn("decision_ts", F.col("ts_utc")).withColumn("top", F.max("high").over(day_high)).select("instrument_id", "decision_ts", "top")
    assert {r.replay for r in leaks(bars, whole, ["instrument_id", "decision_ts"], at, spec.bar_minutes).collect()} == {"truncated", "poisoned"}
    losing = lambda b: b.withColumn("decision_ts", F.col("ts_utc")).filter(F.col("session_date") < b.agg(F.max("session_date").alias("m")).first().m).select("instrument_id", "decision_ts", "close")
    assert {r["column"] for r in leaks(bars, losing, ["instrument_id", "decision_ts"], at, spec.bar_minutes).collect() if r.replay == "truncated"} == {"(row)"}


def test_trigger_window_restarts_and_carries_the_upper_median(spark):
    from eventide.operators.features import trigger_window

    bars = bars_of(spark, 30, "ab").filter("not (instrument_id = 'b' and session_date between '2024-01-10' and '2024-01-12')")
    rows = bars.orderBy("instrument_id", "ts_utc").collect()
    start = min(r.minute_of_day for r in rows if r.is_rth)
    got = {(r.instrument_id, r.ts_utc): r for r in trigger_window(bars, (start + 10, start + 60), 5).collect()}
    assert len(got) == sum(start + 10 <= r.minute_of_day <= start + 60 for r in rows)
    days = {}
    for r in rows:
        days.setdefault((r.instrument_id, r.session_date), []).append(r)
    past = {}
    for (name, _), own in sorted(days.items()):
        closes, medians = past.setdefault(name, ([], []))
        inside = [r for r in own if start + 10 <= r.minute_of_day <= start + 60]
        for i, r in enumerate(inside):
            g = got[name, r.ts_utc]
            assert g.roll_vol_5m == sum(x.volume for x in inside[max(0, i - 4) : i + 1])
            last = sorted(medians[-20:])
            assert g.typ_1m_vol == (last[len(last) // 2] if last else None) and g.prev_close == (closes[-1] if closes else None)
            assert g.rth_open == [x for x in own if x.is_rth][0].open
        regular = [x for x in own if x.is_rth]
        closes.append(regular[-1].close)
        medians.append(float(np.median([x.volume for x in regular])))


def test_samples_are_exact_and_the_same_at_any_partitioning(spark):
    from eventide.functions.core import bottom_k

    df = spark.range(3000).select("id", (F.col("id") % 7).alias("g"))
    one, two = (sorted(r.id for r in bottom_k(d, 100, ["id"]).collect()) for d in (df.repartition(1), df.repartition(13)))
    assert one == two and len(one) == 100 and one != sorted(r.id for r in bottom_k(df, 100, ["id"], seed=8).collect())
    per = [sorted((r.g, r.id) for r in bottom_k(d, 5, ["id"], keys=["g"]).collect()) for d in (df.repartition(2), df.repartition(9))]
    assert per[0] == per[1] and len(per[0]) == 35 and {g for g, _ in per[0]} == set(range(7))
    assert bottom_k(df, 10_000, ["id"]).count() == 3000 and bottom_k(df.limit(0), 5, ["id"], keys=["g"]).count() == 0
    assert abs(np.mean(one) - 1500) < 4 * 866 / 10


def test_landed_files_are_converted_once(spark, tmp_path):
    import gzip
    import time

    head = "ticker,volume,open,close,high,low,window_start,transactions\n"
    land, store, manifest = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/manifest"
    land.mkdir()

    def put(day, close):
        at = int(dt.datetime(2024, 1, day, 15, tzinfo=dt.UTC).timestamp()) * 10**9
        with gzip.open(land / f"2024-01-{day:02d}.csv.gz", "wt") as f:
            f.write(head + "".join(f"A,{i},1,{close},2,0.5,{at + i * 60 * 10**9},1\n" for i in range(5)))

    run = lambda: stores.convert_landed(spark, f"file://{land}/*.csv.gz", store, manifest)
    closes = lambda: {str(r.date): r.c for r in spark.read.parquet(store).groupBy("date").agg(F.max("close").alias("c")).collect()}
    put(2, 1.5), put(3, 1.6)
    assert run() == 2 and run() == 0 and closes() == {"2024-01-02": 1.5, "2024-01-03": 1.6}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert run() == 0 and {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")} == before
    time.sleep(1.1)
    put(3, 1.9), put(4, 1.7)
    assert run() == 2 and run() == 0 and closes() == {"2024-01-02": 1.5, "2024-01-03": 1.9, "2024-01-04": 1.7}
    kept = [p for p in (tmp_path / "store").rglob("*.parquet") if "2024-01-02" in str(p)]
    assert all(before[p] == p.stat().st_mtime_ns for p in kept) and spark.read.parquet(store).count() == 15


def test_strongest_peers_of_blocks_equal_those_of_all_pairs(spark, monkeypatch):
    from eventide.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 3)
    rng, rows = np.random.default_rng(4), []
    lead = rng.normal(size=(4, 60))
    for k in range(9):
        for d in range(4):
            for m in range(60):
                x = rng.normal() if k else lead[d, m]
                if k == 8 and m:
                    x = lead[d, m - 1] + 0.3 * rng.normal()
                if k == 5:
                    x = lead[d, m] + 0.5 * rng.normal()
                if rng.random() < 0.9 and (k != 7 or m < 5):
                    rows.append((dt.date(2024, 1, 8), f"n{k}", dt.date(2024, 1, 2 + d), m * 5, float(x)))
    rows += [(dt.date(2024, 1, 15), "a", dt.date(2024, 1, 9), m, 1.0 * m) for m in range(50)]  # a week with one name
    hist = spark.createDataFrame(rows, "as_of date, instrument_id string, trading_date date, minute_of_day int, resid double")
    pairs, weeks = graph.structural_pairs(hist, "resid", 40, peers=3)
    every = graph.pair_statistics(hist.filter("as_of = '2024-01-08'"), "resid", 40).collect()
    want = set()
    for f in {r.follower_id for r in every}:
        own = sorted((r for r in every if r.follower_id == f and r["corr"] is not None), key=lambda r: (-abs(r["corr"]), r.leader_id))
        want |= {(r.leader_id, f) for r in own[:3]}
    assert {(r.leader_id, r.follower_id) for r in pairs.collect()} == want and "n7" not in {a for p in want for a in p}
    w = {str(r.as_of): (r.names, r.usable) for r in weeks.collect()}
    assert w == {"2024-01-08": (9, 8), "2024-01-15": (1, 1)}
    tests = graph.lag_tests(graph.structural_pairs(hist, "resid", 40)[0])
    edges = graph.edges(tests).collect()
    assert ("n0", "n8") in {(r.leader_id, r.follower_id) for r in edges}
    told = {str(r.as_of): r for r in graph.lineage(weeks, pairs, tests, graph.edges(tests)).collect()}
    assert told["2024-01-08"].tests == 56 and told["2024-01-08"].edges == len(edges) and told["2024-01-15"].edges == 0 and told["2024-01-15"].median_abs_r is None
