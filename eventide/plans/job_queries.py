"""Registered queries: job tables, stage summary and gates over all jobs at once, news baselines, grid day build, stores."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from eventide.functions.core import bottom_k, shared_dir, stored
from eventide.operators import daybuild, graph, grid, jobs, leakage, quality, rules, tree
from eventide.operators import statistics as st
from eventide.operators.events import stamp
from eventide.operators.features import bar_features, by_day, causal_features, trigger_window
from eventide.operators.joins import asof_join
from eventide.operators.news_state import news_jobs
from eventide.operators.outcomes import forward_returns, full_outcomes
from eventide.plans import directional_queries, family_queries  # noqa: F401  (registers queries whose SQL is used here)
from eventide.plans.directional_queries import _OF_DAY
from eventide.plans.bars_queries import _EVENTS, _FWD, HORIZONS, JOBS, M, forwards, gap_events
from eventide.plans.base import BARS, CAUSAL, DAILY, DESK, FEATURES, ORACLES, causal, register, session_bars, t_p_sql, bh_sql
from eventide.plans.panel_queries import EDGE_Q, GRID, NEWS_STATE, TAIL, _loo, _PAIRS, base_grid, graph_of, news_states, panel
from eventide.sources import stores
from eventide.sources.bars import instrument_of, instruments, news, table

Job = jobs.Job

#: The batch of primaries: the single-condition families, with variants of a few of them and their opposite sides.
PRIMARY = [Job(name, name.split("_")[0], where, side) for name, where, side in JOBS]
_AFTER = Job("e12_after_hours_follow", "e12", "bar_of_day = 1 and abs(ah_ret) >= {move}", "case when ah_ret > 0 then 'LONG' else 'SHORT' end", entry_next=False)
BATCH = [
    *PRIMARY,
    *jobs.variants(Job("e5_weekday_gap", "e5", "weekday = {day} and abs(gap_pct) >= 0.1", "case when gap_pct > 0 then 'SHORT' else 'LONG' end"), "day", {"tue": "2", "wed": "3", "thu": "4"}),
    *jobs.variants(Job("e8_quiet_volume_shock", "e8", "rvol_5m >= {level} and abs(ret_5m) <= 0.25", "'LONG'"), "level", {"low": "1.0", "high": "1.25"}),
    replace(_AFTER, where=_AFTER.where.replace("{move}", "0.2")),
    *jobs.variants(_AFTER, "move", {"wide": "0.05", "narrow": "0.5"}),
    *jobs.variants(Job("e16_gap_absorb", "e16", "gap_pct >= {gap} and rvol_5m >= 0.9 and abs(ret_5m) <= 0.6 and close >= vwap_15m", "'LONG'"), "gap", {"small": "0.02", "large": "0.3"}),
    jobs.opposite(PRIMARY[1], "fade"),
    jobs.opposite(next(j for j in PRIMARY if j.family == "e24"), "fade"),
    jobs.opposite(next(j for j in PRIMARY if j.family == "e19"), "cont"),
]

#: Two-sided families: each state by its own conditions, a job a state and side.
DIRECTIONAL = [
    Job(f"v2_{state}_{side}", "v2", f"{where} and rvol_5m >= 0.9", f"'{'LONG' if side == 'long' else 'SHORT'}'")
    for state, where in {
        "impulse": "abs(ret_5m) >= 0.3", "quiet": "abs(ret_5m) <= 0.1", "agree": "sign(ret_5m) = sign(ret_15m)", "conflict": "sign(ret_5m) = -sign(ret_15m)",
        "new_high": "new_high_15", "new_low": "new_low_15", "strong": "xs_ret_rank >= 0.8", "weak": "xs_ret_rank <= 0.2", "wide": "vol_accel_range >= 0.9", "tight": "vol_accel_range <= 0.4",
        "fast": "acceleration_5_vs_15 >= 0.3", "slow": "acceleration_5_vs_15 <= -0.3", "market_up": "mkt_ret_5m >= 0.05", "market_down": "mkt_ret_5m <= -0.05", "above_open": "dist_open >= 0.2", "below_open": "dist_open <= -0.2",
        "near_high": "close_location_value >= 0.9", "near_low": "close_location_value <= 0.1", "efficient": "path_efficiency_15m >= 0.5", "choppy": "path_efficiency_15m <= 0.1",
        "crowd_up": "breadth_pos >= 0.7", "crowd_down": "breadth_neg >= 0.7", "resid_up": "resid_5m >= 0.3", "resid_down": "resid_5m <= -0.3",
    }.items()
    for side in ("long", "short")
]


def _events_sql(table_of: list[Job]) -> str:
    one = lambda j: f"select '{j.job_id}' as job_id, instrument_id, session_date, ts_utc, decision_ts, {'decision_ts' if j.entry_next else 'ts_utc'} as entry_ts, {j.side} as side from causal where ({j.where}) and ({j.side}) is not null"
    return f"""{CAUSAL}, je0 as ({' union all '.join(map(one, table_of))}),
je as (select job_id, job_id || '-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, instrument_id, session_date, decision_ts, entry_ts, side from je0
    qualify row_number() over (partition by job_id, instrument_id, session_date order by ts_utc) = 1)"""


def _returns_sql(table_of: list[Job]) -> str:
    return f"""{_events_sql(table_of)}, en as (select e.*, b.open as entry_price from je e asof left join bars b on e.instrument_id = b.instrument_id and e.entry_ts <= b.ts_utc),
hz as (select * from (values ('1h', 60), ('3h', 180), ('6h', 360)) t(horizon, minutes)),
jr as (select en.job_id, en.event_id, en.instrument_id, session_date, horizon, (b.close / nullif(entry_price, 0) - 1) * case side when 'SHORT' then -1 else 1 end as forward_return
    from en cross join hz join bars b on b.instrument_id = en.instrument_id and b.ts_utc = en.entry_ts + to_minutes(minutes - 15) where b.close / nullif(entry_price, 0) is not null),
jk as (select *, row_number() over (partition by job_id, horizon order by abs(forward_return) desc, event_id) as k, count(*) over (partition by job_id, horizon) as nn from jr),
jd as (select *, row_number() over (partition by job_id, horizon order by m desc, session_date) as k from (select job_id, horizon, session_date, avg(forward_return) as m, sum(forward_return) as s, count(*) as c from jr group by all)),
ja as (select job_id, horizon, avg((m > 0)::int::double) as positive_days, sum(s) filter (k > 1) / nullif(sum(c) filter (k > 1), 0) as mean_without_best_day from jd group by all),
jn as (select job_id, horizon, max(c) / sum(c) as top_name_share from (select job_id, horizon, instrument_id, count(*) as c from jr group by all) group by all),
js as (select job_id, horizon, count(*)::bigint as n, avg(forward_return) as mean, stddev_samp(forward_return) as std, avg(forward_return) / nullif(stddev_samp(forward_return) / sqrt(count(*)), 0) as t_stat, quantile_cont(forward_return, 0.5) as q50,
    avg((forward_return > 0)::int::double) as positive_rate, coalesce(sum(forward_return) filter (k <= ceil(nn * 0.01)) / nullif(sum(forward_return), 0), 0) as top_share, count(distinct session_date)::bigint as days, count(distinct instrument_id)::bigint as names, count(distinct (instrument_id, session_date))::bigint as name_days from jk group by all),
stg as (select js.*, top_name_share, positive_days, mean_without_best_day, horizon = '3h' as is_primary from js join ja using (job_id, horizon) join jn using (job_id, horizon))"""


def _job_returns(spark, d, table_of):
    e = jobs.job_events(causal(spark, d), table_of, M)
    return forward_returns(e, session_bars(spark, d), HORIZONS, M).select("job_id", "event_id", "instrument_id", "session_date", "horizon", "forward_return")


_STAGE = ["job_id", "horizon", "n", "mean", "std", "t_stat", "q50", "positive_rate", "top_share", "days", "names", "top_name_share", "positive_days", "mean_without_best_day", "is_primary"]
_STAGE_D = "mean std t_stat q50 positive_rate top_share top_name_share positive_days mean_without_best_day"


@register("e14_batch_events", f"with {_events_sql(BATCH)} select job_id, event_id, side from je")
def _(spark, d):
    return jobs.job_events(causal(spark, d), BATCH, M).select("job_id", "event_id", "side")


@register("e37_directional_events", f"with {_events_sql(DIRECTIONAL)} select job_id, event_id, side from je")
def _(spark, d):
    return jobs.job_events(causal(spark, d), DIRECTIONAL, M).select("job_id", "event_id", "side")


@register("a12_stage_summary", f"with {_returns_sql(BATCH)} select {', '.join(_STAGE)} from stg", _STAGE_D)
def _(spark, d):
    return jobs.stage_summary(_job_returns(spark, d, BATCH), "3h").select(*_STAGE)


_JUDGED = """jg as (select *, case when n < 10 then 'sample' when top_name_share > 0.5 then 'one_name' when top_share > 0.6 then 'outliers' when mean <= 0 then 'sign' when mean_without_best_day <= 0 then 'best_day' when positive_days < 0.5 then 'days' when mean < 0.2 then 'size' end as reason from stg where is_primary),
jv as (select *, case when reason is null then 'PASS' when reason = 'size' then 'WATCH' else 'KILL' end as decision from jg)"""


def _judged(spark, d, table_of):
    return jobs.judged(jobs.stage_summary(_job_returns(spark, d, table_of), "3h"), 0.2, 10, 0.5, 0.6)


@register("t20_job_gates", f"with {_returns_sql(DIRECTIONAL)}, {_JUDGED} select job_id, n, reason, decision from jv")
def _(spark, d):
    return _judged(spark, d, DIRECTIONAL).select("job_id", "n", "reason", "decision")


@register("t24_stage_p_values", f"""with {_returns_sql(DIRECTIONAL)}, pp as (select job_id, horizon, t_stat, case when is_primary and t_stat is not null and days > 1 then {t_p_sql('t_stat', '(days - 1)')} end as p, 1 as stage, is_primary from stg)
select job_id, t_stat, p, q_value, coalesce(p <= max(case when p <= 0.10 * bk / bn then p end) over (), false) as rejected from (select *, row_number() over (order by p nulls last, job_id, horizon) as bk, count(p) over () as bn from {bh_sql('pp', 'p', 'stage', 'job_id, horizon')}) where is_primary""", "t_stat p q_value")
def _(spark, d):
    """p and q values of all jobs of a stage on their primary horizon."""
    return jobs.with_p_values(jobs.stage_summary(_job_returns(spark, d, DIRECTIONAL), "3h")).filter("is_primary").select("job_id", "t_stat", "p", "q_value", "rejected")


_FROZEN = [("e12_after_hours_follow", -1), ("e24_linear_score", 1), ("e29_market_divergence", -1), ("e31_runner_fail_short", -1)]


@register("t23_direction_correction", f"""with {_returns_sql(BATCH)}, dr as (select * from (values {', '.join(f"('{j}', {v})" for j, v in _FROZEN)}) t(job_id, direction)),
sg as (select job_id, mean, name_days, days, top_name_share, direction from stg left join dr using (job_id) where is_primary),
rs as (select *, case when name_days < 30 or days < 5 then 'sample' when top_name_share > 0.5 then 'concentration' when mean is null then 'returns' when mean < 0 then 'sign' when abs(mean) < 0.2 then 'size' end as reason,
    case when name_days < 30 or days < 5 then 'sample' when top_name_share > 0.5 then 'concentration' when mean is null then 'returns' when mean * direction < 0 then 'sign' when abs(mean) < 0.2 then 'size' end as again from sg)
select job_id, mean, direction::int as frozen_direction, reason as original_reason, case when reason is null then 'PASS' else 'KILL' end as original, case when direction is null then reason else again end as reason,
    case when (case when direction is null then reason else again end) is null then 'PASS' else 'KILL' end as decision from rs""", "mean")
def _(spark, d):
    stage = jobs.stage_summary(_job_returns(spark, d, BATCH), "3h").filter("is_primary")
    return jobs.redirected(stage, spark.createDataFrame(_FROZEN, "job_id string, direction int"), 30, 5, 0.5, 0.2)


@register("e46_family_table", f"""with {_events_sql(BATCH)}, fm as (select * from (values {', '.join(f"('{j.job_id}', '{j.family}', {repr(j.parent) if j.parent else 'null'})" for j in BATCH)}) t(job_id, family, parent))
select family, count(distinct job_id)::bigint as jobs, count(distinct parent)::bigint as parents, count(event_id)::bigint as events from fm left join je using (job_id) group by 1""")
def _(spark, d):
    e = jobs.job_events(causal(spark, d), BATCH, M).select("job_id", "event_id")
    return jobs.job_table(spark, BATCH).join(e, "job_id", "left").groupBy("family").agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("parent").alias("parents"), F.count("event_id").alias("events"))


@register("e47_opposite_sides", f"""with {_events_sql(BATCH)} select c.job_id, count(*)::bigint as events, count(*) filter (c.side <> p.side)::bigint as flipped from je c join je p on c.instrument_id = p.instrument_id and c.decision_ts = p.decision_ts and p.job_id = regexp_replace(c.job_id, '\\.(fade|cont)$', '') where regexp_matches(c.job_id, '\\.(fade|cont)$') group by 1""")
def _(spark, d):
    e = jobs.job_events(causal(spark, d), BATCH, M).select("job_id", "instrument_id", "decision_ts", "side")
    parents = jobs.job_table(spark, BATCH).filter(F.col("job_id").rlike(r"\.(fade|cont)$")).select("job_id", F.col("parent").alias("_p"))
    p = e.select(F.col("job_id").alias("_p"), "instrument_id", "decision_ts", F.col("side").alias("_side"))
    j = e.join(F.broadcast(parents), "job_id").join(p, ["_p", "instrument_id", "decision_ts"])
    return j.groupBy("job_id").agg(F.count("*").alias("events"), F.count_if(F.col("side") != F.col("_side")).alias("flipped"))


#: What a family is about: mechanism and context.
_TAXONOMY = {
    "e5": ("calendar", "gap"), "e8": ("volume", "quiet"), "e12": ("carry", "after_hours"), "e13": ("level", "yesterday"), "e16": ("absorption", "gap"), "e19": ("absorption", "gap"), "e23": ("carry", "after_hours"), "e24": ("score", "gap"),
    "e26": ("momentum", "intraday"), "e29": ("divergence", "market"), "e31": ("momentum", "multi_day"), "e35": ("momentum", "multi_day"), "e36": ("momentum", "snapshot"), "e42": ("divergence", "market"),
}
_SIDE = lambda j: "long" if j.side == "'LONG'" else "short" if j.side == "'SHORT'" else "signed"
_CORE = lambda j: j.parent or j.job_id
_FAMILIES = [(j.job_id, _CORE(j), "first_of_day", j.engine if j.family != "e24" else "score", _SIDE(j), "" if j.parent is None else j.job_id.removeprefix(j.parent), j.parent, None, *([x] for x in _TAXONOMY[j.family])) for j in BATCH]
_LITERAL = lambda v: "null" if v is None else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'"


@register("t25_family_pairs", f"""with {_events_sql(BATCH)}, fm as (select * from (values {', '.join('(' + ', '.join(map(_LITERAL, f)) + ')' for f in _FAMILIES)}) t(id, hypothesis, policy, engine, direction, neighborhood, parent, derived_from, mechanism, context)),
sh as (select a.job_id as id_a, b.job_id as id_b, count(*)::bigint as shared from je a join je b on a.instrument_id = b.instrument_id and a.decision_ts = b.decision_ts and a.job_id < b.job_id group by all)
select a.id as id_a, b.id as id_b, case when a.hypothesis = b.hypothesis and a.hypothesis is not null and a.policy = b.policy then 'EXACT_DUPLICATE'
    when a.engine = b.engine and a.engine <> 'unimplemented' and a.direction = b.direction and a.neighborhood <> '' and a.neighborhood <> b.neighborhood then 'PARAMETER_VARIANT'
    when (a.direction, b.direction) in (('long', 'short'), ('short', 'long')) and a.engine = b.engine and a.hypothesis = b.hypothesis then 'DERIVED_OPPOSITE_DIRECTION'
    when coalesce(a.parent = b.id, false) or coalesce(b.parent = a.id, false) then 'DERIVED' when coalesce(a.derived_from = b.derived_from, false) then 'DERIVED'
    when len(a.mechanism) > 0 and list_sort(a.mechanism) <> list_sort(b.mechanism) then 'DIFFERENT_MECHANISM' when len(a.context) > 0 and not list_has_any(a.context, b.context) then 'DIFFERENT_CONTEXT_SAME_MECHANISM' else 'RELATED_OR_UNCLEAR' end as relation, coalesce(shared, 0)::bigint as shared
from fm a join fm b on a.id < b.id left join sh on sh.id_a = a.id and sh.id_b = b.id""")
def _(spark, d):
    """How the jobs of the batch are related, and how many events each pair has in common."""
    families = spark.createDataFrame(_FAMILIES, "id string, hypothesis string, policy string, engine string, direction string, neighborhood string, parent string, derived_from string, mechanism array<string>, context array<string>")
    return jobs.shared_events(jobs.family_pairs(families), jobs.job_events(causal(spark, d), BATCH, M))


# --- news jobs: the news families on rows with news state
_NEWS_JOBS = news_jobs(0, 90, 0.3, 1.0, 0.3, 0.5, 0.8, 2, 120, "minutes_from_open between 15 and 780", "minutes_from_open between 30 and 720")


def _news_family(name: str, prefixes: tuple[str, ...]) -> None:
    own = {n: v for n, v in _NEWS_JOBS.items() if n.startswith(prefixes)}

    @register(name, f"""with {NEWS_STATE}, nj as ({' union all '.join(f"select '{n}' as job_id, instrument_id, session_date, ts_utc, {side} as side from ns where {w}" for n, (w, side) in own.items())})
    select job_id, instrument_id, ts_utc, side from nj qualify row_number() over (partition by job_id, instrument_id, session_date order by ts_utc) = 1""")
    def _(spark, d):
        e = jobs.job_events(news_states(spark, d), [Job(n, n.split("_")[0], w, s) for n, (w, s) in own.items()], 0)
        return e.select("job_id", "instrument_id", F.col("decision_ts").alias("ts_utc"), "side")


for _name, _prefixes in (("e39_news_then_price", ("n1", "n2", "n3", "n4")), ("e40_news_against_residual", ("n5",)), ("e41_news_intensity", ("ni",)), ("e43_news_reaction", ("nr", "bl")), ("e44_news_jobs", ("n", "bl"))):
    _news_family(_name, _prefixes)


for _name, _sign in (("e42_state_agree", ">"), ("e42_state_against", "<")):

    @register(_name, f"""with {CAUSAL}, im as (select *, case when ret_3m > 0 then 'LONG' else 'SHORT' end as side from causal where abs(ret_3m) >= 0.3 and rvol_5m >= 0.9 qualify row_number() over ({_OF_DAY} ts_utc) = 1)
    select instrument_id, ts_utc, side from im where resid_5m * case side when 'LONG' then 1 else -1 end {_sign} 0""")
    def _(spark, d, sign=_sign):
        """Impulses whose residual goes the same way, or the other."""
        e = stamp(causal(spark, d).filter("abs(ret_3m) >= 0.3 and rvol_5m >= 0.9"), "im", F.expr("case when ret_3m > 0 then 'LONG' else 'SHORT' end"), M)
        own = F.col("resid_5m") * F.when(F.col("side") == "LONG", 1).otherwise(-1)
        return e.filter(own > 0 if sign == ">" else own < 0).select("instrument_id", "ts_utc", "side")


# --- outcomes in one table
@register("o1_full_outcomes", f"""with {_FWD}, j as (select en.event_id, horizon, b.ts_utc, high / nullif(entry_price, 0) - 1 as best, low / nullif(entry_price, 0) - 1 as worst from en cross join hz join bars b on b.instrument_id = en.instrument_id and b.ts_utc >= entry_ts and b.ts_utc < entry_ts + to_minutes(minutes)),
hit as (select event_id, horizon, min(ts_utc) filter (best >= 0.5 or worst <= -0.5) as hit from j group by all),
g as (select event_id, horizon, max(best) as best, min(worst) as worst, bool_or(ts_utc = hit and best >= 0.5) as t, bool_or(ts_utc = hit and worst <= -0.5) as s from j join hit using (event_id, horizon) where hit is null or ts_utc <= hit group by all),
o as (select fwd.*, greatest(0.0, coalesce(best, 0)) as mfe, least(0.0, coalesce(worst, 0)) as mae, coalesce(t, false) as t, coalesce(s, false) as s from fwd left join g using (event_id, horizon) where entry_price is not null)
select event_id, horizon, entry_price, exit_price, forward_return, mfe, mae, t and s as ambiguous, case when t <> s then t end as target_first, case when t <> s then s end as stop_first from o""", "entry_price exit_price forward_return mfe mae")
def _(spark, d):
    out = full_outcomes(gap_events(spark, d), stored(session_bars(spark, d), "bars"), HORIZONS, M, 0.5, 0.5)
    return out.select("event_id", "horizon", "entry_price", "exit_price", "forward_return", "mfe", "mae", "ambiguous", "target_first", "stop_first")


@register("o5_eventful_bars", f"with {_EVENTS} select instrument_id, ts_utc, close from ses where minute_of_day <= 720 and instrument_id in (select instrument_id from evt)", "close")
def _(spark, d):
    e = gap_events(spark, d).select("instrument_id").distinct()
    return session_bars(spark, d).filter("minute_of_day <= 720").join(e, "instrument_id", "left_semi").select("instrument_id", "ts_utc", "close")


@register("a10_calendar_buckets", f"""with {_FWD}, m as (select 'H001-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, median_20d_dollar_volume as dv from feat where is_rth and minute_of_day between 360 and 900 and gap_pct >= 0.15 and rvol_5m >= 0.9),
q as (select quantile_cont(dv, [0.25, 0.5, 0.75]) as q from m), x as (select year(session_date)::int as year, month(session_date)::int as month, case when dv is null then null when dv <= q[1] then 1 when dv <= q[2] then 2 when dv <= q[3] then 3 else 4 end as quartile, forward_return from fwd join m using (event_id), q where forward_return is not null)
select year, month, quartile, count(*)::bigint as n, avg(forward_return) as mean from x group by grouping sets ((year), (year, month), (quartile))""", "mean")
def _(spark, d):
    r = forward_returns(gap_events(spark, d), session_bars(spark, d), HORIZONS, M).filter("forward_return is not null")
    return st.calendar_buckets(r, gap_events(spark, d), "median_20d_dollar_volume")


# --- the grid's day build
_DAY = f"""{CAUSAL}, gk as (select * from causal where minutes_from_open between 60 and 720 and minutes_from_open % 30 = 0),
ge as (select *, prev_close >= 1 and typ_1m_vol * prev_close * 390 >= 1e3 as eligible from gk),
b0 as (select *, session_date as trading_date, ret_5m as r, sqrt(typ_1m_vol * prev_close * 390) as weight from ge where eligible),
bd0 as (select instrument_id, trading_date, product(1 + coalesce(r, 0)) - 1 as day_ret, arg_min(weight, minute_of_day) as weight from b0 group by all),
bd as (select * exclude (sw, sr, oc) from {_loo('bd0', 'trading_date', 'day_ret', 'day_mkt')}),
bcal as (select trading_date, row_number() over (order by trading_date) as day_no from (select distinct trading_date from bd)),
bbeta as (select instrument_id, trading_date, case when regr_count(day_ret, day_mkt) over b = 5 and var_pop(day_mkt) over b >= 1e-18 then regr_slope(day_ret, day_mkt) over b end as beta
    from bd join bcal using (trading_date) window b as (partition by instrument_id order by day_no range between 5 preceding and 1 preceding)),
b1 as (select * exclude (sw, sr, oc) from {_loo('b0', 'trading_date, minute_of_day', 'r', 'mkt')}),
b2 as (select * exclude (sw, sr, oc) from {_loo('b1', 'trading_date, minute_of_day', 'ret_15m', 'mkt_15')}),
b3 as (select b2.*, beta, r - beta * mkt as resid, ret_15m - beta * mkt_15 as resid_15 from b2 left join bbeta using (instrument_id, trading_date)),
gx as (select *, ret_5m - lag(ret_5m, 5) over d as ret_accel_5m, ret_5m / (path_abs_5 / (close + 1e-12) + 1e-12) as signed_path_eff_5m, close_location_value as close_location_5m,
    (rth_high_so_far - close) / (close * (case when count(ret_5m) over v >= 15 then stddev_samp(abs(ret_5m)) over v end + 1e-6)) as dist_sess_high_volnorm,
    (close - rth_low_so_far) / (close * (case when count(ret_5m) over v >= 15 then stddev_samp(abs(ret_5m)) over v end + 1e-6)) as dist_sess_low_volnorm,
    rvol_5m as rvol_5m_tod, volume_5m / (lag(volume_5m, 5) over d + 1e-9) as activity_acceleration,
    rvol_5m >= 1.1 and abs(ret_5m) <= 0.6 as h004, abs(ret_10m) >= 0.3 and rvol_10m >= 1.1 as impulse, rvol_5m >= 1.0 as high_rvol, abs(ret_5m) <= 0.6 as quiet_px, sign(ret_5m) = sign(mkt_ret_5m) as mkt_agree,
    volume / (transactions + 1e-9) as relative_trade_size_proxy, abs(resid) / (volume_5m * close + 1e-9) as price_impact_proxy, rvol_5m - abs(ret_5m) * 100 as volume_price_disagreement,
    range_15m / (med20 + 1e-9) as range_ratio_15m, abs(ret_15m) / (abs(ret_5m) + 1e-9) as realized_vol_ratio_15m, weight as weight_mkt
    from b3 window d as (partition by instrument_id, session_date order by ts_utc), v as (partition by instrument_id, session_date order by ts_utc rows between 14 preceding and current row))"""

_G5 = "ret_accel_5m signed_path_eff_5m close_location_5m dist_sess_high_volnorm dist_sess_low_volnorm rvol_5m_tod activity_acceleration"
_G9 = "relative_trade_size_proxy price_impact_proxy volume_price_disagreement range_ratio_15m realized_vol_ratio_15m premarket_residual_return gap_market_residual missing_minute_rate_15m rtxn_5m_tod weight_mkt"
_THRESHOLDS = daybuild.Thresholds(1.1, 0.6, 0.3, 1.1, 1.0)


def _day(spark, d):
    g = daybuild.eligible(daybuild.decision_grid(causal(spark, d), (60, 720), 30), 1.0, 1e3)
    return daybuild.enriched(daybuild.with_residuals(stored(daybuild.with_weight(g), "grid"), 5), _THRESHOLDS)


@register("p5_decision_grid", f"with {_DAY} select instrument_id, ts_utc, coalesce(eligible, false) as eligible from ge")
def _(spark, d):
    g = daybuild.decision_grid(causal(spark, d), (60, 720), 30)
    return g.select("instrument_id", "ts_utc", daybuild.is_eligible(1.0, 1e3).alias("eligible"))


@register("g5_activity", f"with {_DAY} select instrument_id, ts_utc, {_G5.replace(' ', ', ')} from gx", _G5)
def _(spark, d):
    return _day(spark, d).select("instrument_id", "ts_utc", *_G5.split())


@register("g6_flags", f"""with {_DAY} select instrument_id, ts_utc, h004, impulse, high_rvol, quiet_px, mkt_agree, h004 and impulse and high_rvol and quiet_px and mkt_agree as full_state, impulse and high_rvol and quiet_px and mkt_agree as drop_h004,
h004 and high_rvol and quiet_px and mkt_agree as drop_impulse, h004 and impulse and quiet_px and mkt_agree as drop_high_rvol, h004 and impulse and high_rvol and mkt_agree as drop_quiet_px, h004 and impulse and high_rvol and quiet_px as drop_mkt_agree from gx""")
def _(spark, d):
    return _day(spark, d).select("instrument_id", "ts_utc", *daybuild.FLAGS, "full_state", *[f"drop_{f}" for f in daybuild.FLAGS])


@register("g9_proxies", f"with {_DAY} select instrument_id, ts_utc, {_G9.replace('premarket_residual_return', 'pm_ret as premarket_residual_return').replace('gap_market_residual', 'gap_pct as gap_market_residual').replace('missing_minute_rate_15m', '0.0::double as missing_minute_rate_15m').replace('rtxn_5m_tod', 'null::double as rtxn_5m_tod').replace(' as ', '~').replace(' ', ', ').replace('~', ' as ')} from gx", _G9)
def _(spark, d):
    return _day(spark, d).select("instrument_id", "ts_utc", *_G9.split())


_G16_XS = "resid_rank xs_dispersion xs_breadth xs_tail_imbalance resid_rank_change"
_G16 = f"beta mkt resid mkt_15 resid_15 {_G5} h004 impulse full_state {_G16_XS} same_clock_mean same_clock_surprise price_impact_proxy future_ret future_residual future_residual_six next_ret next_resid"
_AHEAD = lambda c, n: " * ".join(f"(1 + lead({c}, {k}) over w)" for k in range(1, n + 1)) + " - 1"
_BUILT = f"""{_DAY}, z as (select *, h004 and impulse and high_rvol and quiet_px and mkt_agree as full_state, (resid - avg(resid) over x) / (stddev_samp(resid) over x + 1e-12) as z,
    case when resid is not null then (rank() over (partition by trading_date, minute_of_day order by resid asc nulls last) + (count(*) over (partition by trading_date, minute_of_day, resid) - 1) / 2.0) / count(*) over x end as resid_rank,
    quantile_cont(abs(resid), 0.5) over x as xs_dispersion, avg(case when resid is not null then (resid > 0)::int::double end) over x as xs_breadth from gx window x as (partition by trading_date, minute_of_day)),
cm as (select trading_date, minute_of_day, avg(m) over (partition by minute_of_day order by trading_date rows between unbounded preceding and 1 preceding) as same_clock_mean from (select trading_date, minute_of_day, avg(r) as m from gx group by all)),
bt as (select z.*, same_clock_mean, r - coalesce(same_clock_mean, 0) as same_clock_surprise, avg(case when z is not null then (z > {TAIL})::int::double end) over x - avg(case when z is not null then (z < -{TAIL})::int::double end) over x as xs_tail_imbalance,
    resid_rank - lag(resid_rank) over w as resid_rank_change, {_AHEAD('r', 3)} as future_ret, ({_AHEAD('r', 3)}) - beta * ({_AHEAD('mkt', 3)}) as future_residual, ({_AHEAD('r', 6)}) - beta * ({_AHEAD('mkt', 6)}) as future_residual_six, lead(r) over w as next_ret, lead(resid) over w as next_resid
    from z left join cm using (trading_date, minute_of_day) window x as (partition by trading_date, minute_of_day), w as (partition by instrument_id, trading_date order by minute_of_day))"""


def _built(spark, d):
    return daybuild.built(causal(spark, d), (60, 720), 30, 1.0, 1e3, _THRESHOLDS, beta_days=5, tail=TAIL)


@register("g10_enriched_grid", f"with {_BUILT} select instrument_id, trading_date, minute_of_day, {_G16.replace(' ', ', ')} from bt", " ".join(c for c in _G16.split() if c not in ("h004", "impulse", "full_state")))
def _(spark, d):
    return _built(spark, d).select("instrument_id", "trading_date", "minute_of_day", *_G16.split())


@register("g16_day_build", f"with {_BUILT} select trading_date, count(*)::bigint as rows, count(resid)::bigint as residuals, count(future_residual)::bigint as labels, avg(resid_rank) as mean_rank, sum(same_clock_surprise) as surprise from bt group by 1", "mean_rank surprise")
def _(spark, d):
    """The build stored by day in two runs: the second writes only the days that the first, stopped half-way, has left."""
    path = f"{shared_dir(spark)}/day-build-{uuid.uuid4().hex}"
    rows = stored(_built(spark, d), "built")
    half = rows.agg(F.percentile(F.unix_date("trading_date"), F.lit(0.5)).alias("d")).first().d
    stores.write_missing_days(rows.filter(F.unix_date("trading_date") <= F.lit(half)), path, "trading_date")
    stores.write_missing_days(rows, path, "trading_date")
    b = spark.read.schema(rows.schema).parquet(path)
    return b.groupBy("trading_date").agg(F.count("*").alias("rows"), F.count("resid").alias("residuals"), F.count("future_residual").alias("labels"), F.avg("resid_rank").alias("mean_rank"), F.sum("same_clock_surprise").alias("surprise"))


@register("g11_future_ranks", f"""with {GRID}, gs as (select *, case when resid is not null then (rank() over (partition by trading_date, minute_of_day order by resid asc nulls last) + (count(*) over (partition by trading_date, minute_of_day, resid) - 1) / 2.0) / count(*) over (partition by trading_date, minute_of_day) end as resid_rank from gr)
select instrument_id, decision_ts, lead(resid, 1) over w as future_resid_1, lead(resid, 3) over w as future_resid_3, lead(resid, 6) over w as future_resid_6, lead(resid, 12) over w as future_resid_12, lead(resid_rank, 3) over w as future_rank_3, lead(r, 3) over w as future_ret_3 from gs window w as (partition by instrument_id, trading_date order by minute_of_day)""", "future_resid_1 future_resid_3 future_resid_6 future_resid_12 future_rank_3 future_ret_3")
def _(spark, d):
    return daybuild.future_steps(base_grid(spark, d)).select("instrument_id", "decision_ts", "future_resid_1", "future_resid_3", "future_resid_6", "future_resid_12", "future_rank_3", "future_ret_3")


@register("g17_unit_beta", f"with {GRID} select instrument_id, decision_ts, r - coalesce(beta, 1.0) * mkt as resid from gr", "resid")
def _(spark, d):
    return daybuild.unit_beta(base_grid(spark, d)).select("instrument_id", "decision_ts", "resid")


@register("a21_partition_health", f"""with {_DAY} select session_date, count(*)::bigint as rows, count(distinct instrument_id)::bigint as names, avg((ret_15m is null)::int::double) as null_ret, avg((xs_ret_rank is null)::int::double) as null_rank, min(xs_ret_rank) as rank_min, max(xs_ret_rank) as rank_max from gx group by 1""", "null_ret null_rank rank_min rank_max")
def _(spark, d):
    return quality.partition_health(_day(spark, d), "session_date", {"null_ret": "ret_15m", "null_rank": "xs_ret_rank"}, "xs_ret_rank")


@register("q12_watchdog", f"""with {_DAY}, h as (select session_date, count(*)::bigint as rows, avg((ret_15m is null)::int::double) as nulls from gx group by 1), cal as (select distinct session_date from ses), c as (select session_date, coalesce(rows, 0) as rows, nulls from cal left join h using (session_date)),
s as (select *, sum((rows > 0)::int) over (order by session_date) as run from c) select session_date, rows, count(*) filter (rows = 0) over (partition by run order by session_date)::bigint as empty_streak, coalesce(nulls = 1, false) as all_null from s""")
def _(spark, d):
    days = session_bars(spark, d).select("session_date").distinct()
    return quality.watchdog(quality.partition_health(_day(spark, d), "session_date", {"nulls": "ret_15m"}, "xs_ret_rank"), days)


@register("a27_research_days", f"with {BARS} select session_date from ses group by 1 having count(*) filter (is_rth) >= 50 order by 1")
def _(spark, d):
    return session_bars(spark, d).groupBy("session_date").agg(F.count_if("is_rth").alias("n")).filter("n >= 50").select("session_date").orderBy("session_date")


@register("p13_falsify_panel", f"""with {BARS}, dd as (select distinct session_date from ses), fast as (select session_date from dd qualify row_number() over (order by ('0x' || sha256('v1:fast:' || session_date::varchar)[1:8])::bigint % 10007, session_date) <= 10)
select session_date from dd where session_date not in (select session_date from fast) qualify row_number() over (order by ('0x' || sha256('v1:falsify:' || session_date::varchar)[1:8])::bigint % 10007, session_date) <= 5""")
def _(spark, d):
    days = session_bars(spark, d).select("session_date").distinct()
    return st.falsify_panel(days, "session_date", "v1:falsify", 5, [st.hash_panel(days, "session_date", "v1:fast", 10)])


@register("m11_snapshot_sides", f"""with {CAUSAL} select instrument_id, ts_utc, minutes_from_open as snapshot, coalesce(ret_5m, 0) as ret_5m, coalesce(gap_pct, 0) as gap_pct, case when y > 0 then 'LONG' when y < 0 then 'SHORT' end as label
from (select *, lead(close, 3) over (partition by instrument_id, session_date order by ts_utc) / nullif(close, 0) - 1 as y from causal) where minutes_from_open in (180, 360, 540)""", "ret_5m gap_pct")
def _(spark, d):
    y = F.try_divide(F.lead("close", 3).over(by_day()), F.col("close")) - 1
    rows = causal(spark, d).withColumn("y", y).filter(F.col("minutes_from_open").isin(180, 360, 540))
    known = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("instrument_id", "ts_utc", F.col("minutes_from_open").alias("snapshot"), known("ret_5m"), known("gap_pct"), F.when(F.col("y") > 0, "LONG").when(F.col("y") < 0, "SHORT").alias("label"))


# --- certification
@register("q5_extremes", f"""with {BARS}, s as (select *, abs(close / nullif(lag(close) over (partition by instrument_id, session_date order by ts_utc), 0) - 1) as move from ses), k as (select 'price' as kind, instrument_id, ts_utc, high as value from s where high >= 200 union all select 'volume', instrument_id, ts_utc, volume from s where volume >= 5 union all select 'move', instrument_id, ts_utc, move from s where move >= 20)
select kind, instrument_id, ts_utc, value from k qualify row_number() over (partition by kind order by value desc, instrument_id, ts_utc) <= 20""", "value")
def _(spark, d):
    return quality.extremes(session_bars(spark, d), 200.0, 5.0, 20.0, 20)


@register("q8_reference_coverage", f"""with {BARS}, u as (select 'i' || s_suppkey as instrument_id, 'X' || (length(c_mktsegment) % 3) as exchange from supplier left join customer on s_suppkey = c_custkey), b as (select distinct instrument_id from bars)
select coalesce(exchange, 'none') as exchange, count(u.instrument_id)::bigint as listed, count(b.instrument_id)::bigint as traded, count(*) filter (b.instrument_id is null)::bigint as never_traded, count(*) filter (u.instrument_id is null)::bigint as unlisted from u full join b using (instrument_id) group by 1""")
def _(spark, d):
    return quality.reference_coverage(instruments(table(spark, d, "supplier"), table(spark, d, "customer")), session_bars(spark, d))


@register("q10_news_checks", f"""with n as (select {DESK} as instrument_id, ts as published_ts, ts + interval 60 minute as available_at, event_id as article_id, case event_type when 'signup' then 1 when 'error' then -1 else 0 end as s from events where event_type in ('signup', 'error', 'view'))
select count(*)::bigint as rows, (count(*) - count(distinct (instrument_id, article_id)))::bigint as repeated, count(*) filter (published_ts is null or article_id is null)::bigint as nulls, count(*) filter (s not between -1 and 1)::bigint as out_of_range, count(*) filter (available_at < published_ts)::bigint as early from n""")
def _(spark, d):
    return quality.news_checks(news(table(spark, d, "events")))


@register("k12_overlay_checks", f"""with {_PAIRS}, hist as (select as_of, max(trading_date) as history_end from kp group by 1) select count(*)::bigint as edges, count(*) filter (history_end >= ed.as_of)::bigint as late, (count(*) - count(distinct (ed.as_of, leader_id, follower_id)))::bigint as repeated, count(*) filter (leader_id = follower_id)::bigint as own from ed join hist using (as_of)""")
def _(spark, d):
    g = stored(grid.grid_of(causal(spark, d)), "grid")
    return graph.overlay_checks(graph_of(spark, d, g)[3], graph.history(g))


# --- replay on cut and spoilt bars
_REPLAYED = {
    "bar": (lambda b: bar_features(b).select("instrument_id", "decision_ts", "ret_5m", "roll_vol_5m", "prev_close", "typ_1m_vol", "gap_pct", "rvol_5m", "session_vwap", "session_high", "premarket_high"), "feat"),
    "causal": (lambda b: causal_features(b).select("instrument_id", "decision_ts", "ret_15m", "hi_15", "vwap_15m", "rvol_5m", "med20", "yday_ret", "close_location_value", "xs_ret_rank", "mkt_ret_5m", "resid_5m"), "causal"),
    "grid": (lambda b: _replayed_grid(b).select("instrument_id", "decision_ts", "r", "mkt", "beta", "resid"), "g0"),
    "graph": (lambda b: _replayed_graph(b).select("instrument_id", "decision_ts", "leader_shock", "peer_return", "leader_count"), "g0"),
}


def _replayed_grid(bars):
    g = stored(grid.grid_of(causal_features(bars)), "grid")
    return grid.residual_grid(g, grid.rolling_beta(grid.daily_returns(g)))


def _replayed_graph(bars):
    g = stored(grid.grid_of(causal_features(bars)), "grid")
    pairs, _ = graph.structural_pairs(graph.history(g), "r", 40)
    return graph.peer_features(g, graph.edges(graph.lag_tests(pairs, 40, EDGE_Q), 5, EDGE_Q), "r")


@register("t26_leakage", f"""with {GRID}, {FEATURES[len(DAILY) + 2:]}, cutoff as (select max(ts_utc) - interval 4 day as last_ts from bars),
n as ({' union all '.join(f"select '{n}' as transform, count(*)::bigint as rows from {rel}, cutoff where decision_ts <= last_ts" for n, (_, rel) in _REPLAYED.items())})
select transform, replay, rows, 0::bigint as differences from n, (select unnest(['truncated', 'poisoned']) as replay)""")
def _(spark, d):
    """Values that change when later bars are missing or spoilt: none, over bar, causal, grid and graph features."""
    bars = stored(session_bars(spark, d), "bars")
    last = bars.agg((F.max("ts_utc") - F.make_dt_interval(days=F.lit(4))).alias("at")).first()["at"]
    out = None
    for name, (transform, _) in _REPLAYED.items():
        at = F.lit(last).cast("timestamp_ntz")
        found = leakage.leaks(bars, transform, ["instrument_id", "decision_ts"], at, M).groupBy("replay").agg(F.count("*").alias("differences"))
        rows = transform(bars).filter(F.col("decision_ts") <= at).agg(F.count("*").alias("rows"))
        one = spark.createDataFrame([("truncated",), ("poisoned",)], "replay string").join(found, "replay", "left").crossJoin(rows)
        one = one.select(F.lit(name).alias("transform"), "replay", "rows", F.coalesce("differences", F.lit(0).cast("long")).alias("differences"))
        out = one if out is None else out.unionByName(one)
    return out


@register("w13_trigger_window", f"""with {BARS}, df as (select instrument_id, session_date, arg_max(close, ts_utc) as rth_close, quantile_cont(volume, 0.5) as v from ses where is_rth group by all),
lf as (select *, list_sort(list(v) over d) as l from df window d as (partition by instrument_id order by session_date rows between 19 preceding and current row)),
sn as (select instrument_id, session_date, rth_close, l[len(l) // 2 + 1] as typ from (select distinct instrument_id, session_date from ses) left join lf using (instrument_id, session_date)),
st as (select instrument_id, session_date, last_value(rth_close ignore nulls) over b as prev_close, last_value(typ ignore nulls) over b as typ_1m_vol from sn window b as (partition by instrument_id order by session_date rows between unbounded preceding and 1 preceding)),
op as (select *, first_value(case when is_rth then open end ignore nulls) over (partition by instrument_id, session_date order by ts_utc rows between unbounded preceding and current row) as rth_open from ses),
tw as (select *, sum(volume) over (partition by instrument_id, session_date order by ts_utc rows between 4 preceding and current row) as roll_vol_5m from op where minute_of_day between 330 and 600)
select instrument_id, ts_utc, roll_vol_5m, prev_close, typ_1m_vol, rth_open, rth_open / nullif(prev_close, 0) - 1 as gap_pct, roll_vol_5m / nullif(typ_1m_vol * 5, 0) as rvol_5m from tw left join st using (instrument_id, session_date)""", "roll_vol_5m prev_close typ_1m_vol rth_open gap_pct rvol_5m")
def _(spark, d):
    return trigger_window(session_bars(spark, d), (330, 600), M).select("instrument_id", "ts_utc", "roll_vol_5m", "prev_close", "typ_1m_vol", "rth_open", "gap_pct", "rvol_5m")


@register("x_sample", "select o_orderkey from orders order by md5('7:' || o_orderkey) limit 100")
def _(spark, d):
    return bottom_k(table(spark, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey")


@register("x_sample_per_group", "select l_returnflag, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_returnflag order by md5('7:' || l_orderkey || ':' || l_linenumber)) <= 20")
def _(spark, d):
    return bottom_k(table(spark, d, "lineitem"), 20, ["l_orderkey", "l_linenumber"], keys=["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber")


# --- stores: written to the shared folder, read back
def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("s16_job_returns", f"with {_returns_sql(BATCH)} select job_id, count(*)::bigint as n, avg(forward_return) as mean from jr where job_id in ('e16_gap_absorb', 'e16_gap_absorb.fade') group by 1", "mean")
def _(spark, d):
    path = _place(spark, "job-returns")
    stores.write_job_returns(_job_returns(spark, d, BATCH).filter("forward_return is not null"), path, "batch", "full")
    return stores.read_job_returns(spark, path, "batch", "full", ["e16_gap_absorb", "e16_gap_absorb.fade"]).groupBy("job_id").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean"))


@register("s17_model_matrix", f"with {CAUSAL} select instrument_id, ts_utc, ret_5m, gap_pct from causal where minutes_from_open in (180, 360) and session_date = (select min(session_date) + 10 from causal)", "ret_5m gap_pct")
def _(spark, d):
    path, x = _place(spark, "matrix"), causal(spark, d).filter(F.col("minutes_from_open").isin(180, 360))
    stores.write_partitioned(x.select("instrument_id", "ts_utc", "session_date", "ret_5m", "gap_pct").withColumn("stage", F.lit("full")), path, ["stage", "session_date"])
    day = causal(spark, d).agg(F.date_add(F.min("session_date"), 10).alias("_d"))
    return spark.read.parquet(path).filter("stage = 'full'").join(F.broadcast(day), F.col("session_date") == F.col("_d"), "left_semi").select("instrument_id", "ts_utc", "ret_5m", "gap_pct")


@register("s18_feature_store", f"with {CAUSAL} select session_date, count(*)::bigint as rows, avg(rvol_5m) as rvol from causal group by 1", "rvol")
def _(spark, d):
    path = _place(spark, "features")
    stores.write_features(causal(spark, d), path, "causal_v2")
    return stores.read_features(spark, path, "causal_v2", ["session_date", "rvol_5m"]).groupBy("session_date").agg(F.count("*").alias("rows"), F.avg("rvol_5m").alias("rvol"))


@register("s19_event_store", f"with {_FWD} select 'H001' as experiment_id, (select count(*) from evt)::bigint as events, count(forward_return)::bigint as outcomes from fwd")
def _(spark, d):
    path = _place(spark, "events")
    e = stored(gap_events(spark, d), "events")
    stores.append_experiment(e, f"{path}/events", "H001")
    stores.append_experiment(forward_returns(e, session_bars(spark, d), HORIZONS, M), f"{path}/outcomes", "H001")
    events = spark.read.parquet(f"{path}/events").groupBy("experiment_id").agg(F.count("*").alias("events"))
    outcomes = spark.read.parquet(f"{path}/outcomes").groupBy("experiment_id").agg(F.count("forward_return").alias("outcomes"))
    return events.join(outcomes, "experiment_id")


@register("s20_knowledge_log", f"with {_returns_sql(BATCH)}, {_JUDGED} select job_id, decision from jv where contains(lower(job_id || ' ' || decision || ' ' || coalesce(reason, '')), 'gap')")
def _(spark, d):
    path = _place(spark, "log")
    stores.append_records(_judged(spark, d, BATCH).select("job_id", "decision", "reason"), path)
    return stores.search_records(spark, path, "gap", None).select("job_id", "decision")


@register("s21_graph_store", f"with {_PAIRS} select as_of, count(*)::bigint as edges, sum(lag_corr) as weight from ed group by 1", "weight")
def _(spark, d):
    path, made = _place(spark, "graph"), graph_of(spark, d)
    stores.write_graph(made[3], graph.lineage(*made, EDGE_Q), path)
    got, lineage = stores.read_graph(spark, path)
    return got.join(lineage.select("as_of"), "as_of").groupBy("as_of").agg(F.count("*").alias("edges"), F.sum("lag_corr").alias("weight"))


@register("s15_news_cache", f"with n as (select {DESK} as instrument_id, ts, event_id from events where event_type in ('signup', 'error', 'view')) select date_trunc('month', ts)::date as month, count(*)::bigint as rows, count(distinct event_id)::bigint as articles, max(ts) as last_ts from n group by 1")
def _(spark, d):
    path = _place(spark, "news")
    n = news(table(spark, d, "events"))
    stores.write_news_cache(n, path)
    c = stores.read_news_cache(spark, path)
    return c.groupBy("month").agg(F.count("*").alias("rows"), F.countDistinct("article_id").alias("articles"), F.max("published_ts").alias("last_ts"))


# --- further sides, samples and gates
@register("e25_opposite_of_losers", f"with {_returns_sql(BATCH)} select je.job_id || '.opp' as job_id, event_id, case side when 'LONG' then 'SHORT' else 'LONG' end as side from je where job_id in (select job_id from stg where is_primary and mean <= -0.1)")
def _(spark, d):
    e = stored(jobs.job_events(causal(spark, d), BATCH, M), "events")
    r = forward_returns(e, session_bars(spark, d), HORIZONS, M).select("job_id", "event_id", "instrument_id", "session_date", "horizon", "forward_return")
    return jobs.inverted(e, jobs.stage_summary(r, "3h"), 0.05).select("job_id", "event_id", "side")


@register("a7_outcome_summary", f"""with o as ({ORACLES["o1_full_outcomes"]}) select horizon, count(forward_return)::bigint as n, avg(forward_return) as mean, avg(mfe) as mfe, avg(mae) as mae, avg(ambiguous::int::double) as ambiguous_rate, avg(case when target_first is not null then target_first::int::double end) as target_rate from o group by 1""", "mean mfe mae ambiguous_rate target_rate")
def _(spark, d):
    o = full_outcomes(gap_events(spark, d), stored(session_bars(spark, d), "bars"), HORIZONS, M, 0.5, 0.5)
    share = lambda c: F.avg(F.col(c).cast("double"))
    return o.groupBy("horizon").agg(F.count("forward_return").alias("n"), F.avg("forward_return").alias("mean"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"), share("ambiguous").alias("ambiguous_rate"), share("target_first").alias("target_rate"))


@register("a9_daily_counts", f"with {_EVENTS} select session_date, count(*)::bigint as events, count(distinct instrument_id)::bigint as names from evt group by 1 order by 1")
def _(spark, d):
    return gap_events(spark, d).groupBy("session_date").agg(F.count("*").alias("events"), F.countDistinct("instrument_id").alias("names")).orderBy("session_date")


@register("a24_chart_means", f"with {_FWD}, g as (select horizon, session_date, date_trunc('month', session_date)::date as month, forward_return, (select count(distinct session_date) from fwd where forward_return is not null) > 60 as many from fwd where forward_return is not null) select horizon, case when many then month else session_date end as period, count(*)::bigint as n, avg(forward_return) as mean from g group by all", "mean")
def _(spark, d):
    return st.chart_means(forwards(spark, d), ["horizon"])


@register("j16_event_attributes", f"with {_FWD} select event_id, horizon, forward_return, gap_pct, rvol_5m from fwd join (select 'H001-' || instrument_id || '-' || strftime(decision_ts, '%Y%m%d%H%M') as event_id, gap_pct, rvol_5m from feat where is_rth and minute_of_day between 360 and 900 and gap_pct >= 0.15 and rvol_5m >= 0.9) using (event_id)", "forward_return gap_pct rvol_5m")
def _(spark, d):
    e = stored(gap_events(spark, d), "events")
    r = forward_returns(e, session_bars(spark, d), HORIZONS, M).select("event_id", "horizon", "forward_return")
    return r.join(e.select("event_id", "gap_pct", "rvol_5m"), "event_id", "left")


@register("j5_float_asof", f"with r as (select {DESK} as desk, value, max(event_id) as found from events where event_type = 'signup' group by all) select e.event_id, r.found from (select event_id, {DESK} as desk, value from events where event_type = 'error') e asof left join r on e.desk = r.desk and e.value >= r.value")
def _(spark, d):
    e = table(spark, d, "events").select(instrument_of().alias("desk"), "event_id", "event_type", "value")
    right = e.filter("event_type = 'signup'").select("desk", F.col("value").alias("at"), F.col("event_id").alias("found"))
    return asof_join(e.filter("event_type = 'error'").select("desk", "event_id", "value"), right, ["desk"], "value", "at", ["found"]).select("event_id", "found")


@register("p8_rule_conditions", f"with {CAUSAL} select instrument_id, ts_utc from causal where gap_pct > 0.2 and rvol_5m <= 1.2 and new_high_15")
def _(spark, d):
    return causal(spark, d).filter(tree.holds([("gap_pct", ">", 0.2), ("rvol_5m", "<=", 1.2), ("new_high_15", "==", 1.0)])).select("instrument_id", "ts_utc")


_RULES = {"gap_up": "gap_pct > 0.5", "gap_down": "gap_pct <= -0.5", "busy_high": "rvol_5m > 1.2 and close_location_value > 0.8", "rare": "gap_pct > 20 and new_low_15"}


@register("t14_rule_estimates", f"""with {CAUSAL}, pn as (select *, lead(ret_1m) over ({_OF_DAY} ts_utc) as y from causal), rr as ({' union all '.join(f"select '{n}' as rule, instrument_id, session_date, y from pn where y is not null and {w}" for n, w in _RULES.items())}),
tn as (select rule, max(c) / sum(c) as top_name_share, count(*)::bigint as names from (select rule, instrument_id, count(*) as c from rr group by all) group by 1),
td as (select rule, stddev_samp(m) / sqrt(count(*)) as day_se, count(*)::bigint as days from (select rule, session_date, avg(y) as m from rr group by all) group by 1),
te as (select rule, count(*)::bigint as n, avg(y) as mean, stddev_samp(y) / sqrt(count(*)) as row_se, count(distinct (instrument_id, session_date))::bigint as name_days from rr group by 1)
select rule, n, mean, case when days > 1 then day_se else row_se end as se, name_days, days, names, top_name_share, case when name_days < 30 or days < 5 or names < 2 then 'sample' when top_name_share > 0.2 then 'concentration' end as kill from te join tn using (rule) join td using (rule)""", "mean se top_name_share")
def _(spark, d):
    return rules.estimated(panel(spark, d), {n: F.expr(w) for n, w in _RULES.items()}, "y", 30, 5, 2, 0.2)


@register("t21_robust_gate", f"""with a as ({ORACLES["t21_directional_gate"]}), b as ({ORACLES["t2_bootstrap"]}), c as ({ORACLES["a11_without_top"]}), e as ({ORACLES["a17_day_agreement"]}),
g as (select horizon, n, coalesce(reason, case when not (ci_low > 0 and ci_high > 0) then 'ci' when not (mean_below_q99 >= 2.5 and mean_without_best_day >= 2.5) then 'outliers' end) as reason from a join b using (horizon) join c using (horizon) join e using (horizon))
select *, case when reason is null then 'PASS' else 'KILL' end as decision from g""")
def _(spark, d):
    r = stored(forwards(spark, d), "returns")
    minutes = F.element_at(F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv]), F.col("horizon")).cast("double")
    days = st.day_agreement(r, ["horizon"])
    gated = rules.directional_gate(rules.rule_sample(r, ["horizon"]), days, ["horizon"], rules.floor_of(minutes), 30, 5, 0.5, 0.3, 0.5).select("horizon", "n", "reason")
    return rules.robust_gate(gated, st.bootstrap(r, ["horizon"], 200), st.without_top(r, ["horizon"], 0.05), days, ["horizon"], F.lit(2.5)).select("horizon", "n", "reason", "decision")
