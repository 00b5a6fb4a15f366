"""Registered queries: bars, day facts, features, events, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import events as ev
from eventide.operators.directional import GAP_SCORE
from eventide.operators.features import carried, daily_facts, late_rows
from eventide.operators.joins import asof_join, range_join
from eventide.operators.outcomes import barriers, forward_returns
from eventide.plans.base import BARS, CAUSAL, DAILY, DESK, FEATURES, causal, features, register, session_bars
from eventide.sources.bars import QUARTERS, instruments, latest, news, table

M = QUARTERS.bar_minutes
HORIZONS = {"1h": 60, "3h": 180, "6h": 360}


@register("s1_bars_from_ticks", f"with {BARS} select instrument_id, ts_utc, open, high, low, close, volume, transactions from bars", "open high low close volume")
def _(spark, d):
    return session_bars(spark, d).select("instrument_id", "ts_utc", "open", "high", "low", "close", "volume", "transactions")


@register("p1_session_columns", f"with {BARS} select instrument_id, ts_utc, session_date, minute_of_day, is_rth, is_premarket, is_after_hours from ses")
def _(spark, d):
    return session_bars(spark, d).select("instrument_id", "ts_utc", "session_date", "minute_of_day", "is_rth", "is_premarket", "is_after_hours")


_FACTS = "rth_open rth_high rth_low rth_close rth_med_vol day_dollar_volume premarket_high premarket_low premarket_volume premarket_close after_hours_close"


@register("a1_daily_facts", f"with {DAILY} select instrument_id, session_date, {_FACTS.replace(' ', ', ')} from daily", _FACTS)
def _(spark, d):
    return daily_facts(session_bars(spark, d))


_CARRIED = "prev_close typ_1m_vol median_20d_dollar_volume yday_ret yday_high yday_low yday_range yday_clv ret_2d ret_3d ret_5d ah_ret pm_ret med20"


@register("c6_carried_state", f"with {DAILY} select instrument_id, session_date, {_CARRIED.replace(' ', ', ')} from carried", _CARRIED)
def _(spark, d):
    return carried(daily_facts(session_bars(spark, d))).select("instrument_id", "session_date", *_CARRIED.split())


_BAR = "ret_1m ret_5m ret_15m roll_vol_5m dollar_volume roll_dvol_5m prev_close typ_1m_vol median_20d_dollar_volume gap_pct rvol_5m acceleration session_vwap cum_intraday_volume session_high session_low dist_from_vwap dist_from_session_high dist_from_session_low dist_from_premarket_high premarket_high premarket_low premarket_volume"


@register("w1_bar_features", f"with {FEATURES} select instrument_id, ts_utc, available_at, decision_ts, {_BAR.replace(' ', ', ')} from feat", _BAR)
def _(spark, d):
    return features(spark, d).select("instrument_id", "ts_utc", "available_at", "decision_ts", *_BAR.split())


_CAUSAL_A = "ret_1m ret_3m ret_5m ret_10m ret_15m ret_30m volume_1m volume_5m volume_10m volume_15m range_1m range_5m range_15m range_30m hi_3 lo_3 hi_5 lo_5 hi_10 lo_10 hi_15 lo_15 path_abs_5 path_abs_15 rth_open rth_high_so_far rth_low_so_far gap_pct rvol_1m rvol_5m rvol_10m rvol_15m"
_CAUSAL_B = "dist_open dist_prev_close dist_yday_high dist_yday_low path_efficiency_5m path_efficiency_15m acceleration_5_vs_15 pullback_from_recent_high rebound_from_recent_low range_position_15m close_location_value volume_acceleration volume_persistence vol_vs_prev5_avg px_disp_per_rvol vol_accel_range range_vs_hist vwap_15m"
_CAUSAL_X = "xs_ret_rank xs_rvol_rank xs_accel_rank xs_vol_rank breadth_pos breadth_neg mkt_ret_5m mkt_ret_15m mkt_rvol_5m resid_5m resid_15m"


@register("c1_causal_windows", f"with {CAUSAL} select instrument_id, ts_utc, minutes_from_open, weekday, {_CAUSAL_A.replace(' ', ', ')} from causal", _CAUSAL_A)
def _(spark, d):
    return causal(spark, d).select("instrument_id", "ts_utc", "minutes_from_open", "weekday", *_CAUSAL_A.split())


@register("c10_causal_ratios", f"with {CAUSAL} select instrument_id, ts_utc, new_high_15, new_low_15, {_CAUSAL_B.replace(' ', ', ')} from causal", _CAUSAL_B)
def _(spark, d):
    return causal(spark, d).select("instrument_id", "ts_utc", "new_high_15", "new_low_15", *_CAUSAL_B.split())


@register("c15_cross_section", f"with {CAUSAL} select instrument_id, ts_utc, n_extreme_15m, n_large_gap, n_vol_shock, {_CAUSAL_X.replace(' ', ', ')} from causal", _CAUSAL_X)
def _(spark, d):
    return causal(spark, d).select("instrument_id", "ts_utc", "n_extreme_15m", "n_large_gap", "n_vol_shock", *_CAUSAL_X.split())


@register("c19_lookahead_check", f"with {FEATURES} select count(*)::bigint as late from feat where available_at > decision_ts")
def _(spark, d):
    return late_rows(features(spark, d)).agg(F.count("*").alias("late"))


_UNIVERSE = """u as (select 'i' || s_suppkey as instrument_id, s_name as ticker, 'X' || (length(c_mktsegment) % 3) as exchange,
    case when s_nationkey % 5 = 0 then 'ETF' else 'CS' end as security_type from supplier left join customer on s_suppkey = c_custkey)"""


@register("p3_universe_filter", f"with {FEATURES}, {_UNIVERSE} select instrument_id, ts_utc, ticker, prev_close from feat join u using (instrument_id) where security_type = 'CS' and exchange in ('X0', 'X1', 'X2') and prev_close between 5 and 300", "prev_close")
def _(spark, d):
    i = instruments(table(spark, d, "supplier"), table(spark, d, "customer"))
    return ev.universe(features(spark, d), i, "CS", ["X0", "X1", "X2"], 5.0, 300.0).select("instrument_id", "ts_utc", "ticker", "prev_close")


def gap_events(spark, d):
    rows = features(spark, d)
    return ev.evaluate(rows, "H001", [("gap_pct", ">=", 0.15), ("rvol_5m", ">=", 0.9)], "LONG", (360, 900), M)


_EVENTS = f"""{FEATURES}, evt as (select 'H001-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, instrument_id, session_date, decision_ts,
    decision_ts as entry_ts, 'LONG' as side from feat where is_rth and minute_of_day between 360 and 900 and gap_pct >= 0.15 and rvol_5m >= 0.9)"""


@register("e1_evaluate_events", f"with {_EVENTS} select event_id, instrument_id, session_date, decision_ts, entry_ts, side from evt")
def _(spark, d):
    return gap_events(spark, d).select("event_id", "instrument_id", "session_date", "decision_ts", "entry_ts", "side")


_FIRST = "fd as (select * from evt qualify row_number() over (partition by instrument_id, session_date order by decision_ts, event_id) = 1)"


@register("e2_first_of_day", f"with {_EVENTS}, {_FIRST} select event_id, side from fd")
def _(spark, d):
    return ev.first_of_day(gap_events(spark, d)).select("event_id", "side")


@register("e3_cooldown", f"""with recursive {_EVENTS}, n as (select *, row_number() over (partition by instrument_id, session_date order by decision_ts, event_id) as rn from evt),
walk as (select instrument_id, session_date, rn, event_id, decision_ts as last, true as kept from n where rn = 1
    union all select n.instrument_id, n.session_date, n.rn, n.event_id, case when n.decision_ts >= w.last + interval 180 minute then n.decision_ts else w.last end,
    n.decision_ts >= w.last + interval 180 minute from walk w join n on n.instrument_id = w.instrument_id and n.session_date = w.session_date and n.rn = w.rn + 1)
select event_id, instrument_id from walk where kept""")
def _(spark, d):
    return ev.cooldown(gap_events(spark, d), 180).select("event_id", "instrument_id")


_CROWD = "crowd as (select session_date from (select * from feat where is_rth qualify row_number() over (partition by instrument_id, session_date order by ts_utc) = 1) where gap_pct >= 0.15 group by 1 having count(*) >= 4)"


@register("e11_crowded_days", f"with {_EVENTS}, {_CROWD} select event_id, session_date from evt where session_date in (select session_date from crowd)")
def _(spark, d):
    return ev.crowded(gap_events(spark, d), features(spark, d), 0.15, 4).select("event_id", "session_date")


def _job(name: str, where: str, side: str, sql_side: str | None = None):
    """A first-of-day job on causal features: the same condition and side in both languages."""

    @register(name, f"""with {CAUSAL} select '{name}-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, {side} as side from causal
        where ({where}) and ({side}) is not null qualify row_number() over (partition by instrument_id, session_date order by ts_utc) = 1""")
    def _(spark, d):
        rows = causal(spark, d).filter(where)
        return ev.stamp(rows, name, F.expr(side), M).select("event_id", "side")


# One row a job: name, condition, side. Thresholds fit the tick table's wide prices.
_MOST = "minutes_from_open between 30 and 780"
JOBS = [
    ("e5_weekday_gap", "weekday = 1 and abs(gap_pct) >= 0.1", "case when gap_pct > 0 then 'SHORT' else 'LONG' end"),
    ("e8_quiet_volume_shock", "rvol_5m >= 1.1 and abs(ret_5m) <= 0.25", "'LONG'"),
    ("e13_first_yday_tag", "minutes_from_open between 15 and 800 and high >= yday_high", "'SHORT'"),
    ("e13_first_yday_low_tag", "minutes_from_open between 15 and 800 and low <= yday_low", "'LONG'"),
    ("e16_gap_absorb", f"{_MOST} and gap_pct >= 0.05 and rvol_5m >= 0.9 and abs(ret_5m) <= 0.6 and close >= vwap_15m", "'LONG'"),
    ("e16_gap_absorb_fade", f"{_MOST} and gap_pct >= 0.05 and rvol_5m >= 0.9 and abs(ret_5m) <= 0.6 and close >= vwap_15m", "'SHORT'"),
    ("e19_gap_down_reclaim", "minutes_from_open between 20 and 400 and yday_ret > 0 and gap_pct <= -0.03 and close >= rth_open", "'LONG'"),
    ("e23_after_hours_agreement", "minutes_from_open between 15 and 400 and abs(ah_ret) >= 0.03 and ret_5m is not null", "case when (ah_ret * ret_5m > 0) = (ah_ret > 0) then 'LONG' else 'SHORT' end"),
    ("e24_linear_score", f"{_MOST} and rvol_5m >= 1.2 and abs(gap_pct) >= 0.02 and abs({GAP_SCORE}) >= 0.5", f"case when {GAP_SCORE} > 0 then 'LONG' else 'SHORT' end"),
    ("e26_impulse_only", "abs(ret_3m) >= 0.3 and rvol_5m >= 0.9", "case when ret_3m > 0 then 'LONG' else 'SHORT' end"),
    ("e29_market_divergence", f"{_MOST} and (mkt_ret_5m <= -0.2 or breadth_pos <= 0.4) and ret_5m >= -0.1 and xs_ret_rank >= 0.9 and rvol_5m >= 1 and (abs(mkt_ret_5m) <= 0.5 or close >= hi_5)", "'LONG'"),
    ("e29_market_divergence_short", f"{_MOST} and (mkt_ret_5m >= 0.2 or breadth_neg <= 0.4) and ret_5m <= 0.1 and xs_ret_rank <= 0.4 and rvol_5m >= 1 and (abs(mkt_ret_5m) <= 0.5 or close <= lo_5)", "'SHORT'"),
    ("e31_multi_day_runner", f"{_MOST} and ret_3d >= 0.15 and close >= rth_open * 0.995 and new_high_15 and rvol_5m >= 1", "'LONG'"),
    ("e31_runner_cont_short", f"{_MOST} and ret_3d <= -0.15 and close <= rth_open * 1.005 and new_low_15 and rvol_5m >= 1", "'SHORT'"),
    ("e31_runner_fail_short", f"{_MOST} and ret_3d >= 0.15 and close < rth_open and ret_5m > 0", "'SHORT'"),
    ("e31_runner_fail_long", f"{_MOST} and ret_3d <= -0.15 and close > rth_open and ret_5m < 0", "'LONG'"),
    ("e35_scale_conflict", f"{_MOST} and sign(ret_5m) <> sign(yday_ret) and abs(ret_5m) >= 0.1 and abs(ret_15m) < 0.8 and abs(yday_ret) >= 0.01", "case when yday_ret > 0 then 'LONG' else 'SHORT' end"),
    ("e36_snapshot_momentum", "minutes_from_open in (300, 420, 540) and abs(ret_5m) >= 0.3", "case when ret_5m > 0 then 'LONG' else 'SHORT' end"),
    ("e42_residual_state", f"{_MOST} and resid_5m >= 0.3 and rvol_5m >= 1 and xs_ret_rank >= 0.8", "'LONG'"),
    ("e42_residual_weak", f"{_MOST} and resid_5m <= -0.3 and rvol_5m >= 1 and xs_ret_rank <= 0.4", "'SHORT'"),
]
for _name, _where, _side in JOBS:
    _job(_name, _where, _side)


@register("e6_hold_near_high", f"""with {DAILY}, w as (select instrument_id, session_date, arg_min(open, ts_utc) as rth_open, max(high) as high_w, min(low) as low_w, min(close) as min_c from ses where is_rth and minute_of_day < 480 group by all),
s as (select w.* from w join carried using (instrument_id, session_date) where w.rth_open / nullif(prev_close, 0) - 1 >= 0.15 and high_w > w.rth_open and (high_w - low_w) / nullif(w.rth_open, 0) >= 0.002 and min_c >= high_w * (1 - 0.8))
select b.instrument_id, b.session_date, b.ts_utc, high_w from ses b join s using (instrument_id, session_date) where minute_of_day >= 480 and minute_of_day <= 900 and high >= high_w qualify row_number() over (partition by b.instrument_id, b.session_date order by ts_utc) = 1""", "high_w")
def _(spark, d):
    state = carried(daily_facts(session_bars(spark, d))).select("instrument_id", "session_date", "prev_close")
    return ev.hold_near_high(session_bars(spark, d), state, (360, 480), (480, 900), 0.15, 0.002, 0.8).select("instrument_id", "session_date", "ts_utc", "high_w")


@register("e7_parabolic", f"""with {CAUSAL}, v as (select instrument_id, ts_utc, lag(volume_5m, 10) over (partition by instrument_id, session_date order by ts_utc) as before from (select instrument_id, session_date, ts_utc, sum(volume) over (partition by instrument_id, session_date order by ts_utc rows between 4 preceding and current row) as volume_5m from ses))
select 'e7_parabolic-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, 'SHORT' as side from causal join v using (instrument_id, ts_utc)
where minutes_from_open between 20 and 840 and ret_15m >= 0.15 and ret_5m >= 0.08 and ret_5m >= 0.5 * ret_15m and rvol_5m >= 0.9 and volume_5m >= 1.0 * before qualify row_number() over (partition by instrument_id, session_date order by ts_utc) = 1""")
def _(spark, d):
    rows = ev.parabolic(causal(spark, d), session_bars(spark, d), (20, 840), 0.15, 0.08, 0.5, 0.9, 1.0)
    return ev.stamp(rows, "e7_parabolic", "SHORT", M).select("event_id", "side")


def _impulse_sql(impulse: float) -> str:
    return f"""with {CAUSAL}, n as (select instrument_id, session_date, ts_utc, close, ret_3m as r, rvol_5m as v, row_number() over w - 1 as b, sum(volume_1m) over (w rows between unbounded preceding and current row) as sum_v, avg(volume_1m) over (w rows between 9 preceding and current row) as mean_v, lag(hi_3) over w as hb, lag(lo_3) over w as lb from causal window w as (partition by instrument_id, session_date order by ts_utc)),
i as (select instrument_id, session_date, b as i, sign(r) as d, close as peak, abs(r) * close as size, sum_v as sum_i, mean_v from n where abs(r) >= {impulse} and v >= 0.9),
j as (select i.*, n.b as j from i join n using (instrument_id, session_date) where n.b > i and n.b <= i + 5 and (n.close - peak) * d < 0 and abs(n.close - peak) / nullif(size, 0) between 0.1 and 0.9 and (n.sum_v - sum_i) / (n.b - i) < i.mean_v qualify row_number() over (partition by i.instrument_id, i.session_date, i order by n.b) = 1),
k as (select j.*, n.b as k, n.ts_utc from j join n using (instrument_id, session_date) where n.b > j and n.b <= j + 4 and ((d > 0 and n.close > hb) or (d < 0 and n.close < lb)) qualify row_number() over (partition by j.instrument_id, j.session_date, i order by n.b) = 1)
select instrument_id, session_date, i, j, k, ts_utc, case when d > 0 then 'LONG' else 'SHORT' end as side from k qualify row_number() over (partition by instrument_id, session_date order by i) = 1"""


@register("e26_impulse_pullback", _impulse_sql(0.3))
def _(spark, d):
    return ev.impulse_pullback(causal(spark, d), 0.3, 0.9, 5, (0.1, 0.9), 4)


@register("e26_impulse_strict", _impulse_sql(1.5))
def _(spark, d):
    return ev.impulse_pullback(causal(spark, d), 1.5, 0.9, 5, (0.1, 0.9), 4)


@register("e25_inverted", f"with {_EVENTS}, {_FIRST} select event_id, 'SHORT' as side from fd")
def _(spark, d):
    return ev.inverted(ev.first_of_day(gap_events(spark, d))).select("event_id", "side")


# --- outcomes
_FWD = f"""{_EVENTS}, en as (select e.*, b.open as entry_price from evt e asof left join bars b on e.instrument_id = b.instrument_id and e.entry_ts <= b.ts_utc),
hz as (select * from (values ('1h', 60), ('3h', 180), ('6h', 360)) t(horizon, minutes)),
fwd as (select en.event_id, en.instrument_id, session_date, horizon, entry_price, b.close as exit_price, b.close / nullif(entry_price, 0) - 1 as forward_return
    from en cross join hz left join bars b on b.instrument_id = en.instrument_id and b.ts_utc = en.entry_ts + to_minutes(minutes - 15))"""


def forwards(spark, d):
    return forward_returns(gap_events(spark, d), session_bars(spark, d), HORIZONS, M)


@register("o2_forward_returns", f"with {_FWD} select event_id, horizon, entry_price, exit_price, forward_return from fwd", "entry_price exit_price forward_return")
def _(spark, d):
    return forwards(spark, d).select("event_id", "horizon", "entry_price", "exit_price", "forward_return")


@register("flagship_forward_returns", f"with {_FWD} select horizon, count(forward_return)::bigint as n, avg(forward_return) as mean_return, count(distinct session_date)::bigint as days from fwd group by horizon", "mean_return")
def _(spark, d):
    return forwards(spark, d).groupBy("horizon").agg(F.count("forward_return").alias("n"), F.avg("forward_return").alias("mean_return"), F.countDistinct("session_date").alias("days"))


def _barriers_sql(side: str, best: str, worst: str) -> str:
    return f"""with {_EVENTS}, en as (select e.*, b.open as entry_price from evt e asof left join bars b on e.instrument_id = b.instrument_id and e.entry_ts <= b.ts_utc),
j as (select en.event_id, b.ts_utc, {best} as best, {worst} as worst from en join bars b on b.instrument_id = en.instrument_id and b.ts_utc >= entry_ts and b.ts_utc < entry_ts + interval 360 minute),
hit as (select event_id, min(ts_utc) filter (best >= 0.5 or worst <= -0.5) as hit from j group by 1),
g as (select event_id, greatest(0.0, max(best)) as mfe, least(0.0, min(worst)) as mae, coalesce(bool_or(ts_utc = hit and best >= 0.5), false) as t, coalesce(bool_or(ts_utc = hit and worst <= -0.5), false) as s
    from j join hit using (event_id) where hit is null or ts_utc <= hit group by 1)
select en.event_id, en.instrument_id, '{side}' as side, entry_price, mfe, mae, t and s as ambiguous, case when t <> s then t end as target_first, case when t <> s then s end as stop_first from en left join g using (event_id)"""


@register("o3_barriers", _barriers_sql("LONG", "high / nullif(entry_price, 0) - 1", "low / nullif(entry_price, 0) - 1"), "entry_price mfe mae")
def _(spark, d):
    return barriers(gap_events(spark, d), session_bars(spark, d), 360, 0.5, 0.5)


@register("o3_barriers_short", _barriers_sql("SHORT", "1 - low / nullif(entry_price, 0)", "1 - high / nullif(entry_price, 0)"), "entry_price mfe mae")
def _(spark, d):
    return barriers(ev.inverted(gap_events(spark, d)), session_bars(spark, d), 360, 0.5, 0.5)


@register("p9_short_returns", f"with {_FWD} select event_id, horizon, 1 - exit_price / nullif(entry_price, 0) as forward_return from fwd", "forward_return")
def _(spark, d):
    return forward_returns(ev.inverted(gap_events(spark, d)), session_bars(spark, d), HORIZONS, M).select("event_id", "horizon", "forward_return")


# --- joins
@register("j4_asof_news", f"""with {_EVENTS}, nw as (select {DESK} as instrument_id, ts + interval 60 minute as available_at, event_id as article_id,
    case event_type when 'signup' then 1 when 'error' then -1 else 0 end as sentiment_score from events where event_type in ('signup', 'error', 'view'))
select e.event_id, n.article_id, n.sentiment_score, n.available_at from evt e asof left join nw n on e.instrument_id = n.instrument_id and e.decision_ts >= n.available_at""")
def _(spark, d):
    n = news(table(spark, d, "events"))
    e = gap_events(spark, d).select("event_id", "instrument_id", "decision_ts")
    return asof_join(e, n, ["instrument_id"], "decision_ts", "available_at", ["article_id", "sentiment_score"]).select("event_id", "article_id", "sentiment_score", "available_at")


@register("j8_news_window", f"""with {_EVENTS}, nw as (select {DESK} as instrument_id, ts + interval 60 minute as available_at, event_id as article_id,
    case event_type when 'signup' then 1 when 'error' then -1 else 0 end as s, props, event_id % 3 + 1 as k from events where event_type in ('signup', 'error', 'view'))
select e.event_id, count(*) filter (s > 0)::bigint as positive, count(*) filter (s < 0)::bigint as negative, count(*) filter (s = 0)::bigint as neutral,
    count(distinct article_id)::bigint as articles, count(distinct props)::bigint as publishers, count(*) filter (k = 1)::bigint as single_ticker, sum(s)::bigint as net
from evt e join nw n on e.instrument_id = n.instrument_id and n.available_at > e.decision_ts - interval 4 hour and n.available_at <= e.decision_ts group by 1""")
def _(spark, d):
    n = news(table(spark, d, "events"))
    j = range_join(gap_events(spark, d).select("event_id", "instrument_id", "decision_ts"), n, ["instrument_id"], "decision_ts", "available_at", -4 * 3600, 0, closed="right")
    s = F.col("sentiment_score")
    return j.groupBy("event_id").agg(
        F.count_if(s > 0).alias("positive"), F.count_if(s < 0).alias("negative"), F.count_if(s == 0).alias("neutral"), F.countDistinct("article_id").alias("articles"),
        F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("article_ticker_count") == 1).alias("single_ticker"), F.sum(s).cast("long").alias("net"),
    )


@register("j11_semi_instruments", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment like 'A%')")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment like 'A%'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@register("j12_anti_customers", "select c_custkey from customer where not exists (select 1 from events where user_id = c_custkey)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "events"), F.col("user_id") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("s13_latest_order", "select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def _(spark, d):
    return latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")
