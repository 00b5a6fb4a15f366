"""Every event family against a plain loop over hand-made days with unknown values and ties."""

import datetime as dt
import math

import numpy as np
import pytest

from eventide.operators import directional as dr
from eventide.operators import families as fam

START = dt.datetime(2024, 1, 2, 14, 30)
FEATURES = "open high low close rvol_5m ret_5m ret_15m volume_5m volume_10m gap_pct ah_ret yday_ret yday_high yday_low med20 hi_3 hi_5 lo_5 hi_15 lo_15 prev_close range_15m rth_open dist_open xs_ret_rank close_location_value".split()
CLOCK = (10, 70)


def sign(v):
    return (v > 0) - (v < 0)


@pytest.fixture(scope="module")
def days():
    """(name, date) -> rows in order, as dicts; a fifth of the features are unknown."""
    rng, out = np.random.default_rng(42), {}
    for name in "abcdefgh":
        for day in range(6):
            daily = {"gap_pct": rng.normal(0, 0.1), "ah_ret": rng.normal(0, 0.05), "yday_ret": rng.normal(0, 0.02), "yday_high": 10.4, "yday_low": 9.6, "med20": 0.06, "prev_close": 10.0, "rth_open": 10 + rng.normal(0, 0.1)}
            daily = {k: None if k not in ("rth_open", "prev_close") and rng.random() < 0.1 else float(v) for k, v in daily.items()}
            close, rows = 10.0, []
            for i in range(0, 80, 1 if day % 2 else 2):
                if rng.random() < 0.05:
                    continue
                close = float(np.round(close + rng.normal(0, 0.15) + 0.1 * (10 - close), 2))
                high, low = close + round(float(rng.random()) * 0.3, 2), close - round(float(rng.random()) * 0.3, 2)
                own = {"open": close - 0.05, "high": high, "low": low, "close": close, "rvol_5m": rng.uniform(0, 8), "ret_5m": round(float(rng.normal(0, 0.02)), 3), "ret_15m": rng.normal(0, 0.03), "volume_5m": rng.uniform(1, 9), "volume_10m": rng.uniform(2, 18)}
                own |= {f"hi_{k}": close + rng.uniform(-0.1, 0.4) for k in (3, 5, 15)} | {f"lo_{k}": close - rng.uniform(-0.1, 0.4) for k in (5, 15)}
                own |= {"range_15m": rng.uniform(0, 0.1), "xs_ret_rank": round(float(rng.random()), 2), "close_location_value": rng.random()}
                own = {k: None if k not in ("open", "high", "low", "close") and rng.random() < 0.1 else float(v) for k, v in own.items()}
                rows.append(daily | own | {"dist_open": close / daily["rth_open"] - 1, "instrument_id": name, "session_date": START.date() + dt.timedelta(days=day), "ts_utc": START + dt.timedelta(days=day, minutes=i), "minutes_from_open": i})
            out[name, START.date() + dt.timedelta(days=day)] = rows
    return out


@pytest.fixture(scope="module")
def frame(spark, days):
    rows = [(r["instrument_id"], r["session_date"], r["ts_utc"], r["minutes_from_open"], *(r[f] for f in FEATURES)) for own in days.values() for r in own]
    schema = "instrument_id string, session_date date, ts_utc timestamp_ntz, minutes_from_open int, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema).repartition(3)


def ok(*conditions):
    """Conditions as functions; one over an unknown value doesn't hold."""
    for c in conditions:
        try:
            if not c():
                return False
        except TypeError:
            return False
    return True


def inside(rows, clock=CLOCK):
    return [r for r in rows if clock[0] <= r["minutes_from_open"] <= clock[1]]


def found(df, *more):
    return sorted((r.instrument_id, r.session_date, r.ts_utc, r.side, *(r[m] for m in more)) for r in df.collect())


def said(rows):
    return sorted((r["instrument_id"], r["session_date"], r["ts_utc"], side, *more) for r, side, *more in rows)


def test_after_hours_open(days, frame):
    first = [rows[0] for rows in days.values() if ok(lambda: abs(rows[0]["ah_ret"]) >= 0.03)]  # noqa: B023
    for fade in (False, True):
        assert found(dr.after_hours_open(frame, 0.03, fade)) == said((r, "LONG" if (r["ah_ret"] > 0) != fade else "SHORT") for r in first)


def test_quiet_shock_sides(days, frame):
    shocks = []
    for rows in days.values():
        hit = [r for r in inside(rows) if ok(lambda: r["rvol_5m"] >= 5, lambda: abs(r["ret_5m"]) <= 0.012)]  # noqa: B023
        shocks += hit[:1]
    z = lambda v: v or 0
    score = lambda r: 2.0 * z(r["gap_pct"]) + 1.5 * z(r["ret_5m"]) + 0.5 * z(r["ret_15m"]) + 0.02 * min(z(r["rvol_5m"]), 10) / 10 - 0.0004 * r["minutes_from_open"]
    rules = {
        "mom5": (lambda r: r["ret_5m"] != 0, lambda r: r["ret_5m"] > 0), "fade5": (lambda r: r["ret_5m"] != 0, lambda r: not r["ret_5m"] > 0),
        "gap": (lambda r: r["gap_pct"] is not None and r["gap_pct"] != 0, lambda r: r["gap_pct"] > 0), "gap_fade": (lambda r: r["gap_pct"] is not None and r["gap_pct"] != 0, lambda r: not r["gap_pct"] > 0),
        "range": (lambda r: True, lambda r: (r["close_location_value"] or -1) >= 0.6), "select": (lambda r: abs(r["ret_5m"]) >= 0.004 and r["rvol_5m"] >= 6, lambda r: r["ret_5m"] > 0),
        "score": (lambda r: abs(score(r)) >= 0.012, lambda r: score(r) > 0),
    }
    for by, (where, up) in rules.items():
        assert found(dr.shock_side(dr.quiet_shock(frame, CLOCK, 5, 0.012), by)) == said((r, "LONG" if up(r) else "SHORT") for r in shocks if where(r)), by


def test_compression(days, frame):
    want, release = [], {True: [], False: []}
    for rows in days.values():
        w = inside(rows)
        for i in range(len(w)):
            r = w[i]
            if i >= 5:
                t = w[i - 5]
                for up in (True, False):
                    level = t["hi_15" if up else "lo_15"]
                    if ok(lambda: t["range_15m"] <= 0.4 * t["med20"], lambda: r["close"] > level if up else r["close"] < level, lambda: r["rvol_5m"] >= 2):  # noqa: B023
                        release[up].append((r, "LONG" if up else "SHORT"))
            if i >= 6:
                t, b = w[i - 5], w[i - 6]
                tight = ok(lambda: (t["hi_15"] - t["lo_15"]) / t["prev_close"] <= 1.0 * t["med20"])  # noqa: B023
                if tight and ok(lambda: t["close"] > b["hi_15"], lambda: r["close"] > b["hi_15"]):  # noqa: B023
                    want.append((r, "LONG"))
                elif tight and ok(lambda: t["close"] < b["lo_15"], lambda: r["close"] < b["lo_15"]):  # noqa: B023
                    want.append((r, "SHORT"))
    assert want and found(dr.compression_break(frame, CLOCK, 1.0, 5)) == said(want)
    for up in (True, False):
        assert release[up] and found(dr.compression_release(frame, CLOCK, 0.4, 5, 2, up)) == said(release[up])


def by_day(days):
    out = {}
    for (_, day), rows in days.items():
        out.setdefault(day, []).append(rows)
    return out


def moved(names, until, least=5):
    last = [[r for r in rows if r["minutes_from_open"] <= until][-1] for rows in names]
    m = [r["close"] / r["rth_open"] - 1 for r in last]
    return last, (sum(m) / len(m) if len(m) >= least else None)


def test_laggards_and_contrarian(days, frame):
    lag, against = [], []
    for names in by_day(days).values():
        last, m = moved(names, 45)
        ranked = sorted(r["dist_open"] for r in last)
        cut = ranked[math.floor((len(ranked) - 1) * 0.2 + 0.5)]
        if m >= -0.002:
            lag += [(r, "LONG") for r in last if r["dist_open"] <= cut and ok(lambda: r["rvol_5m"] >= 2) and 43 <= r["minutes_from_open"] <= 50]  # noqa: B023
        _, m = moved(names, 30)
        if abs(m) > 0.003:
            against += [(r, "SHORT" if m > 0.003 else "LONG") for rows in names for r in inside(rows, (35, 50)) if ok(lambda: r["gap_pct"] >= 0.04)]  # noqa: B023
    assert lag and found(dr.laggards(frame, 45, (43, 50), -0.002, 0.2, 2, 5)) == said(lag)
    assert against and found(dr.contrarian(frame, 30, (35, 50), 0.003, 0.04, 5)) == said(against)
    assert dr.laggards(frame, 45, (43, 50), -0.002, 0.2, 2, 9).count() == 0


def test_impulse_pause(days, frame):
    for fade in (False, True):
        want = []
        for rows in days.values():
            w = inside(rows)
            for i in range(15, len(w)):
                r, far, near = w[i], w[i - 15], w[i - 5]
                if not ok(lambda: abs(far["ret_5m"]) >= 0.01, lambda: abs(near["close"] / far["close"] - 1) <= 0.02, lambda: r["volume_5m"] >= 1.0 * (near["volume_10m"] / 2)):  # noqa: B023
                    continue
                up = far["ret_5m"] > 0
                if fade and not (r["high"] < far["high"] if up else r["low"] > far["low"]):
                    continue
                want.append((r, "LONG" if up != fade else "SHORT"))
        assert want and found(dr.impulse_pause(frame, CLOCK, 0.01, 0.02, 1.0, (15, 5), fade)) == said(want)


def test_failed_opening_break(days, frame):
    want = []
    for rows in days.values():
        opening = [r for r in rows if r["minutes_from_open"] < 15]
        hi, lo = max(r["high"] for r in opening), min(r["low"] for r in opening)
        later = [r for r in rows if r["minutes_from_open"] >= 20]
        out = next((r for r in later if r["close"] > hi or r["close"] < lo), None)
        if out:
            back = next((r for r in later if out["ts_utc"] < r["ts_utc"] <= out["ts_utc"] + dt.timedelta(minutes=20) and lo <= r["close"] <= hi), None)
            if back:
                want.append((back, "SHORT" if out["close"] > hi else "LONG"))
    assert want and found(dr.failed_opening_break(frame, 15, 20, 20)) == said(want)
    assert dr.failed_opening_break(frame.limit(0), 15, 20, 20).count() == 0


def test_scale_agreement(days, frame):
    want = []
    for rows in days.values():
        w = inside(rows)
        for b, r in zip(w, w[1:]):
            if ok(lambda: sign(r["ret_5m"]) == sign(r["ret_15m"]) == sign(r["yday_ret"]), lambda: abs(r["ret_5m"]) >= 0.008, lambda: r["rvol_5m"] >= 2, lambda: r["close"] >= b["hi_3"]):  # noqa: B023
                want.append((r, "LONG" if r["ret_5m"] > 0 else "SHORT"))
    assert want and found(dr.scale_agreement(frame, CLOCK, 0.008, 2)) == said(want)


@pytest.mark.parametrize("up", [True, False])
def test_breakout_window(days, frame, up):
    accept, reject = [], []
    for rows in days.values():
        w, level = inside(rows), rows[0]["yday_high" if up else "yday_low"]
        if level is None:
            continue
        broke = next((i for i, r in enumerate(w) if (r["high"] > level if up else r["low"] < level)), None)
        if broke is None:
            continue
        closes, last, back = 0, None, None
        for r in w[broke : broke + 10]:
            if r["close"] > level if up else r["close"] < level:
                closes, last = closes + 1, r
            if r["close"] <= level * (1 - 0.02) if up else r["close"] >= level * (1 + 0.02):
                back = r
                break
        volumes = [r["rvol_5m"] for r in w[broke : broke + 10] if r["rvol_5m"] is not None]
        if back is not None:
            reject.append((back, "SHORT" if up else "LONG"))
        elif closes >= 2 and volumes and sum(volumes) / len(volumes) >= 1.2:
            accept.append((last, "LONG" if up else "SHORT"))
    got = fam.breakout_window(frame, "yday_high" if up else "yday_low", CLOCK, 10, 0.02, 2, 1.2, up)
    assert accept and reject
    assert found(got.filter("outcome = 'ACCEPT'")) == said(accept) and found(got.filter("outcome = 'REJECT'")) == said(reject)


def test_rank_states(days, frame):
    want = []
    for rows in days.values():
        snaps = [r for r in rows if r["minutes_from_open"] >= 15 and r["minutes_from_open"] % 2 == 0 and r["xs_ret_rank"] is not None and r["ret_15m"] is not None]
        seen = set()
        for i, r in enumerate(snaps):
            x, b = r["xs_ret_rank"], snaps[i - 1]["xs_ret_rank"] if i else None
            states = {
                "persist_lead": (b is not None and x >= 1 - 0.3 and b >= 1 - 0.2 and x >= b - 0.1, "LONG"), "decay_lead": (b is not None and b >= 1 - 0.2 and x < 1 - 0.4 and r["ret_15m"] > 0, "SHORT"),
                "persist_lag": (b is not None and x <= 0.3 and b <= 0.2 and x <= b + 0.1, "SHORT"), "recover_lag": (b is not None and b <= 0.2 and x > 0.4 and r["ret_15m"] < 0, "LONG"),
                "raw_mom_long": (x >= 1 - 0.2, "LONG"), "raw_mom_short": (x <= 0.2, "SHORT"),
            }
            for s, (holds, side) in states.items():
                if holds and s not in seen:
                    seen.add(s)
                    want.append((r, side, s))
    assert {s for _, _, s in want} == {"persist_lead", "decay_lead", "persist_lag", "recover_lag", "raw_mom_long", "raw_mom_short"}
    assert found(fam.rank_states(frame, 15, 2, 0.2, 0.3, 0.1, 0.4), "state") == said(want)


def test_shock_resolution(days, frame):
    want = []
    for rows in days.values():
        w = inside(rows)
        first = next((i for i, r in enumerate(w) if ok(lambda: r["rvol_5m"] >= 5, lambda: abs(r["ret_5m"]) <= 0.012)), None)  # noqa: B023
        if first is None or w[first]["hi_5"] is None and w[first]["lo_5"] is None:
            continue
        hi, lo = w[first]["hi_5"], w[first]["lo_5"]
        jobs = {
            "res_long": (lambda r: r["high"] > hi and r["close"] > hi and r["rvol_5m"] >= 3, "LONG"), "res_short": (lambda r: r["low"] < lo and r["close"] < lo and r["rvol_5m"] >= 3, "SHORT"),  # noqa: B023
            "fail_up": (lambda r: r["high"] > hi and lo < r["close"] < hi, "SHORT"), "fail_dn": (lambda r: r["low"] < lo < r["close"] < hi, "LONG"),  # noqa: B023
        }
        for job, (holds, side) in jobs.items():
            hit = next((r for r in w[first + 1 : first + 11] if ok(lambda: holds(r))), None)  # noqa: B023
            if hit:
                want.append((hit, side, job))
    assert {j for *_, j in want} == {"res_long", "res_short", "fail_up", "fail_dn"}
    assert found(fam.shock_resolution(frame, CLOCK, 5, 0.012, 10, 3), "job") == said(want)


def ranks(values):
    """Average ranks over the number of all values; none for an unknown one."""
    known = sorted(v for v in values if v is not None)
    return [None if v is None else (known.index(v) + 1 + (known.count(v) - 1) / 2) / len(values) for v in values]


def test_opening_dislocation(days, frame):
    want = []
    for names in by_day(days).values():
        opened = [(rows, inside(rows, (0, 4))[-1]) for rows in names if inside(rows, (0, 4))]
        for (rows, _), g, m in zip(opened, ranks([s["gap_pct"] for _, s in opened]), ranks([s["ret_5m"] for _, s in opened])):
            last = inside(rows, (5, 60))[-1]
            if not ((g or 0) >= 1 - 0.3 or (m or 0) >= 1 - 0.3):
                continue
            if ok(lambda: last["xs_ret_rank"] >= 1 - 0.3, lambda: last["close"] >= last["rth_open"]):  # noqa: B023
                want.append((last, "LONG", "cont"))
            elif ok(lambda: last["xs_ret_rank"] < 1 - 0.4, lambda: last["close"] < last["rth_open"]):  # noqa: B023
                want.append((last, "SHORT", "rev"))
    assert {j for *_, j in want} == {"cont", "rev"}
    assert found(fam.opening_dislocation(frame, (0, 4), (5, 60), 0.3, 0.4, 5), "job") == said(want)
    assert fam.opening_dislocation(frame, (0, 4), (5, 60), 0.3, 0.4, 9).count() == 0


@pytest.mark.parametrize("up", [True, False])
def test_two_attempts(days, frame, up):
    want = []
    for rows in days.values():
        w, level = inside(rows), rows[0]["yday_high" if up else "yday_low"]
        if level is None:
            continue
        for job in ("succ", "fail"):
            first = None
            for i, r in enumerate(w):
                c = r["close"]
                if not (r["high"] >= level if up else r["low"] <= level):
                    continue
                if first is None:
                    first = i if (c < level if up else c > level) else None
                elif i >= first + 5:
                    if job == "succ" and (c > level if up else c < level) or job == "fail" and (c < level * (1 - 0.003) if up else c > level * (1 + 0.003)):
                        want.append((r, "LONG" if (job == "succ") == up else "SHORT", job))
                        break
    assert {j for *_, j in want} == {"succ", "fail"}
    assert found(fam.two_attempts(frame, "yday_high" if up else "yday_low", CLOCK, 5, 0.003, up), "job") == said(want)


@pytest.mark.parametrize("up", [True, False])
def test_breakout_trap(days, frame, up):
    want, level = [], "yday_high" if up else "yday_low"
    for rows in days.values():
        w, at = inside(rows), rows[0][level]
        if at is None:
            continue
        first = next((r for r in w if (r["high"] >= at if up else r["low"] <= at)), None)
        if first:
            hit = next((r for r in w if first["ts_utc"] < r["ts_utc"] <= first["ts_utc"] + dt.timedelta(minutes=15) and (r["low"] <= at if up else r["high"] >= at)), None)
            want += [(hit, "SHORT" if up else "LONG")] if hit else []
    assert want and found(dr.breakout_trap(frame, level, CLOCK, 15, up)) == said(want)


def test_compression_expansion(days, frame):
    want = []
    for rows in days.values():
        w = inside(rows)
        first = next((r for r in w if ok(lambda: (r["hi_15"] - r["lo_15"]) / r["prev_close"] <= 0.8 * r["med20"])), None)  # noqa: B023
        if first:
            span = (first["hi_15"] - first["lo_15"]) / first["prev_close"]
            hit = next((r for r in w if first["ts_utc"] < r["ts_utc"] <= first["ts_utc"] + dt.timedelta(minutes=30) and (r["high"] - r["low"]) / r["prev_close"] >= 1.5 * span), None)
            want += [(hit, "LONG" if hit["close"] >= hit["open"] else "SHORT")] if hit else []
    assert want and found(dr.compression_expansion(frame, CLOCK, 0.8, 30, 1.5)) == said(want)
