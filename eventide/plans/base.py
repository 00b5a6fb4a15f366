"""How queries are registered: a function, its SQL, and the columns of doubles that both round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.features import bar_features, causal_features
from eventide.sources.bars import add_session, bar_starts, bars_from_ticks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, without a negative zero."""
    # millionths as a whole number, as the SQL's round takes them: rounding a double's decimal form parts at halves
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6 + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None, doubles: str = ""):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            names = doubles.split()
            replace = " replace (" + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in names) + ")" if names else ""
            ORACLES[name] = f"select *{replace} from ({sql})"
        return f

    return add


#: What counts as extreme among the tick table's wide prices.
EXTREME, LARGE_GAP, SHOCK = 0.5, 0.5, 1.3


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_session(bars_from_ticks(table(spark, sf_dir, "events")))


def session_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_date: the days of session_bars, from the ticks' different quarters of an hour."""
    return add_session(bar_starts(table(spark, sf_dir, "events"))).select("session_date").distinct()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_features(session_bars(spark, sf_dir))


def causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_features(session_bars(spark, sf_dir), extreme=EXTREME, large_gap=LARGE_GAP, shock=SHOCK)


def t_p_sql(t: str, df: str) -> str:
    """SQL of the two-sided p of a t statistic with a whole number of degrees of freedom, by the finite series."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * k) for k in range(0, ({df} // 2)::bigint)])"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k + 1) for k in range(0, ({df} // 2)::bigint)]), 0))"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def bh_sql(rel: str, p: str, keys: str, ties: str) -> str:
    """SQL of a relation with q_value, the least p n / rank from there on."""
    over = f"partition by {keys} order by {p} nulls last, {ties}"
    return f"""(select * exclude (bh_k, bh_n), case when {p} is not null then least(1.0, min({p} * bh_n / bh_k) over ({over} rows between current row and unbounded following)) end as q_value
        from (select *, row_number() over ({over}) as bh_k, count({p}) over (partition by {keys}) as bh_n from {rel}))"""


#: SQL of a tick's instrument.
DESK = "'i' || (user_id // 20)"

BARS = f"""ticks as (select {DESK} as instrument_id, ts, value as price from events),
bars as (select instrument_id, time_bucket(interval 15 minute, ts)::timestamp as ts_utc, arg_min(price, ts) as open, max(price) as high,
    min(price) as low, arg_max(price, ts) as close, count(*)::double as volume, count(*)::bigint as transactions
    from ticks group by all),
et as (select *, (ts_utc at time zone 'UTC') at time zone 'America/New_York' as ts_et from bars),
ses0 as (select *, ts_et::date as session_date, (hour(ts_et) * 60 + minute(ts_et))::int as minute_of_day from et),
ses as (select *, minute_of_day >= 360 and minute_of_day < 1200 as is_rth, minute_of_day < 360 as is_premarket,
    minute_of_day >= 1200 as is_after_hours from ses0)"""

DAILY = BARS + """,
daily0 as (select instrument_id, session_date, arg_min(open, ts_utc) filter (is_rth) as rth_open, max(high) filter (is_rth) as rth_high,
    min(low) filter (is_rth) as rth_low, arg_max(close, ts_utc) filter (is_rth) as rth_close,
    quantile_cont(volume, 0.5) filter (is_rth) as rth_med_vol, sum(close * volume) filter (is_rth) as day_dollar_volume,
    max(high) filter (is_premarket) as premarket_high, min(low) filter (is_premarket) as premarket_low,
    sum(volume) filter (is_premarket) as premarket_volume, arg_max(close, ts_utc) filter (is_premarket) as premarket_close,
    arg_max(close, ts_utc) filter (is_after_hours) as after_hours_close from ses group by all),
daily as (select *, (rth_high - rth_low) / nullif(lag(rth_close) over (partition by instrument_id order by session_date), 0) as day_range from daily0),
carried as (select *, lag(rth_close) over d as prev_close,
    quantile_cont(rth_med_vol, 0.5) over (d rows between 20 preceding and 1 preceding) as typ_1m_vol,
    quantile_cont(day_dollar_volume, 0.5) over (d rows between 20 preceding and 1 preceding) as median_20d_dollar_volume,
    quantile_cont(day_range, 0.5) over (d rows between 20 preceding and 1 preceding) as med20,
    lag(rth_close) over d / nullif(lag(rth_close, 2) over d, 0) - 1 as yday_ret, lag(rth_high) over d as yday_high, lag(rth_low) over d as yday_low,
    (lag(rth_high) over d - lag(rth_low) over d) / nullif(lag(rth_close) over d, 0) as yday_range,
    (lag(rth_close) over d - lag(rth_low) over d) / nullif(lag(rth_high) over d - lag(rth_low) over d, 0) as yday_clv,
    lag(rth_close) over d / nullif(lag(rth_close, 2) over d, 0) - 1 as ret_2d, lag(rth_close) over d / nullif(lag(rth_close, 3) over d, 0) - 1 as ret_3d,
    lag(rth_close) over d / nullif(lag(rth_close, 5) over d, 0) - 1 as ret_5d,
    lag(after_hours_close) over d / nullif(lag(rth_close) over d, 0) - 1 as ah_ret, premarket_close / nullif(lag(rth_close) over d, 0) - 1 as pm_ret
    from daily window d as (partition by instrument_id order by session_date))"""

FEATURES = DAILY + """,
f0 as (select ses.*, close * volume as dollar_volume, close / nullif(lag(close) over i, 0) - 1 as ret_1m,
    close / nullif(lag(close, 5) over i, 0) - 1 as ret_5m, close / nullif(lag(close, 15) over i, 0) - 1 as ret_15m,
    sum(volume) over (i rows between 4 preceding and current row) as roll_vol_5m,
    sum(close * volume) over (i rows between 4 preceding and current row) as roll_dvol_5m,
    case when is_rth then sum(case when is_rth then volume end) over u end as cum_intraday_volume,
    case when is_rth then sum(case when is_rth then close * volume end) over u end as cum_pv,
    case when is_rth then max(case when is_rth then high end) over u end as session_high,
    case when is_rth then min(case when is_rth then low end) over u end as session_low
    from ses window i as (partition by instrument_id order by ts_utc), u as (partition by instrument_id, session_date order by ts_utc rows between unbounded preceding and current row)),
feat as (select f0.* exclude (cum_pv), cum_pv / nullif(cum_intraday_volume, 0) as session_vwap, c.prev_close, c.typ_1m_vol, c.median_20d_dollar_volume,
    case when minute_of_day >= 360 then c.rth_open end as rth_open, case when minute_of_day >= 360 then c.premarket_high end as premarket_high,
    case when minute_of_day >= 360 then c.premarket_low end as premarket_low, case when minute_of_day >= 360 then c.premarket_volume end as premarket_volume,
    case when minute_of_day >= 360 then c.rth_open end / nullif(c.prev_close, 0) - 1 as gap_pct, roll_vol_5m / nullif(c.typ_1m_vol * 5, 0) as rvol_5m,
    ret_5m - ret_15m / 3 as acceleration, close / nullif(cum_pv / nullif(cum_intraday_volume, 0), 0) - 1 as dist_from_vwap,
    close / nullif(session_high, 0) - 1 as dist_from_session_high, close / nullif(session_low, 0) - 1 as dist_from_session_low,
    close / nullif(case when minute_of_day >= 360 then c.premarket_high end, 0) - 1 as dist_from_premarket_high,
    ts_utc + interval 15 minute as available_at, ts_utc + interval 15 minute as decision_ts
    from f0 left join carried c using (instrument_id, session_date))"""


def _causal_sql() -> str:
    w = lambda k: f"(d rows between {k - 1} preceding and current row)"
    full = lambda agg, c, k, n: f"case when count({c}) over {w(k)} >= {n} then {agg}({c}) over {w(k)} end"
    rets = ", ".join(f"close / nullif(lag(close, {k}) over d, 0) - 1 as ret_{k}m" for k in (1, 3, 5, 10, 15, 30, 60))
    vols = ", ".join(f"sum(volume) over {w(k)} as volume_{k}m" for k in (5, 10, 15))
    ranges = ", ".join(f"({full('max', 'high', k, n)} - {full('min', 'low', k, n)}) / nullif(close, 0) as range_{k}m" for k, n in ((5, 5), (15, 15), (30, 15)))
    his = ", ".join(f"{full('max', 'high', k, k)} as hi_{k}, {full('min', 'low', k, k)} as lo_{k}" for k in (3, 5, 10, 15))
    paths = ", ".join(f"{full('sum', 'step', k, 2)} as path_abs_{k}, lag(close, {k}) over d as c{k}" for k in (5, 15))
    dist = ", ".join(f"close / nullif({b}, 0) - 1 as dist_{n}" for n, b in (("open", "rth_open"), ("prev_close", "prev_close"), ("yday_high", "yday_high"), ("yday_low", "yday_low")))
    rvol = ", ".join(f"volume_{k}m / (typ_1m_vol * {k} + 1e-9) as rvol_{k}m" for k in (1, 5, 10, 15))
    path = ", ".join(f"case when c{k} is not null and path_abs_{k} is not null then least(1.0, greatest(0.0, abs(close - c{k}) / (path_abs_{k} + 1e-12))) end as path_efficiency_{k}m" for k in (5, 15))
    rank = lambda v, n: f"case when {v} is not null then (rank() over (partition by session_date, minute_of_day order by {v} asc nulls last) + (count(*) over (partition by session_date, minute_of_day, {v}) - 1) / 2.0) / count(*) over x end as {n}"
    return DAILY + f""",
k0 as (select *, abs(close - lag(close) over (partition by instrument_id, session_date order by ts_utc)) as step from ses),
k1 as (select * exclude (step), volume as volume_1m, (high - low) / nullif(close, 0) as range_1m, ts_utc + interval 15 minute as available_at,
    case when count(close * volume) over {w(15)} >= 5 then sum(close * volume) over {w(15)} / nullif(sum(volume) over {w(15)}, 0) end as vwap_15m, {rets}, {vols}, {ranges}, {his}, {paths}
    from k0 window d as (partition by instrument_id, session_date order by ts_utc)),
k2 as (select k1.*, c.prev_close, c.typ_1m_vol, c.yday_ret, c.yday_high, c.yday_low, c.yday_range, c.yday_clv, c.ret_2d, c.ret_3d, c.ret_5d, c.ah_ret, c.med20, c.pm_ret,
    minute_of_day - 360 as minutes_from_open, isodow(session_date)::int as weekday, available_at as decision_ts, {rvol},
    (row_number() over d)::int as bar_of_day, first_value(open) over u as rth_open, max(high) over u as rth_high_so_far, min(low) over u as rth_low_so_far, high >= lag(hi_15) over d as new_high_15, low <= lag(lo_15) over d as new_low_15,
    volume_5m / (lag(volume_5m, 5) over d + 1e-9) as volume_acceleration from k1 left join carried c using (instrument_id, session_date) where is_rth
    window d as (partition by instrument_id, session_date order by ts_utc), u as (partition by instrument_id, session_date order by ts_utc rows between unbounded preceding and current row)),
k3 as (select * exclude (c5, c15), rth_open / nullif(prev_close, 0) - 1 as gap_pct, {dist}, {path}, ret_5m - ret_15m as acceleration_5_vs_15,
    hi_15 / nullif(close, 0) - 1 as pullback_from_recent_high, close / nullif(lo_15, 0) - 1 as rebound_from_recent_low, (close - lo_15) / (hi_15 - lo_15 + 1e-12) as range_position_15m,
    (close - rth_low_so_far) / (rth_high_so_far - rth_low_so_far + 1e-12) as close_location_value, rvol_5m / (rvol_15m + 1e-9) as volume_persistence,
    volume_1m / (volume_5m / 5 + 1e-9) as vol_vs_prev5_avg, abs(ret_5m) / (rvol_5m + 1e-9) as px_disp_per_rvol, range_5m / (range_15m + 1e-9) as vol_accel_range, range_15m / (med20 + 1e-9) as range_vs_hist
    from k2),
causal as (select *, {rank('ret_15m', 'xs_ret_rank')}, {rank('rvol_5m', 'xs_rvol_rank')}, {rank('acceleration_5_vs_15', 'xs_accel_rank')}, {rank('range_5m', 'xs_vol_rank')},
    avg(case when ret_5m is not null then (ret_5m > 0)::int::double end) over x as breadth_pos, avg(case when ret_5m is not null then (ret_5m < 0)::int::double end) over x as breadth_neg,
    count(case when abs(ret_15m) >= {EXTREME} then 1 end) over x as n_extreme_15m, count(case when abs(gap_pct) >= {LARGE_GAP} then 1 end) over x as n_large_gap,
    count(case when rvol_5m >= {SHOCK} then 1 end) over x as n_vol_shock, avg(ret_5m) over x as mkt_ret_5m, avg(ret_15m) over x as mkt_ret_15m, avg(rvol_5m) over x as mkt_rvol_5m,
    ret_5m - avg(ret_5m) over x as resid_5m, ret_15m - avg(ret_15m) over x as resid_15m
    from k3 window x as (partition by session_date, minute_of_day))"""


CAUSAL = _causal_sql()
