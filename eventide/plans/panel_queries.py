"""Registered queries: grid, graph, statistics, models, quality, generic relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions.core import stored, with_bh, with_bh_wide
from eventide.functions.tdist import t_p
from eventide.operators import graph, grid, models, quality, tree
from eventide.operators import statistics as st
from eventide.operators.features import daily_facts
from eventide.operators.joins import asof_join, effective_join
from eventide.operators.news_state import with_news_state
from eventide.plans.bars_queries import _EVENTS, _FWD, forwards, gap_events
from eventide.plans.base import BARS, CAUSAL, DAILY, DESK, bh_sql, causal, register, session_bars, session_days, t_p_sql
from eventide.sources.bars import instrument_of, news, table, upsert


def _loo(rel: str, keys: str, r: str, out: str) -> str:
    return f"""(select * exclude (q, w), case when oc > 0 then (sr - coalesce(w * {r}, 0)) / nullif(sw - coalesce(w, 0), 0) end as {out} from
        (select *, coalesce(sum(w) over p, 0) as sw, coalesce(sum(w * {r}) over p, 0) as sr, count(w) over p - (w is not null)::int as oc from
        (select *, case when weight is not null and {r} is not null then least(q[2], greatest(q[1], weight)) end as w from
        (select *, quantile_cont(weight, [0.01, 0.99]) over (partition by {keys}) as q from {rel})) window p as (partition by {keys})))"""


GRID = f"""{CAUSAL},
g0 as (select instrument_id, session_date as trading_date, minute_of_day, decision_ts, ret_1m as r, sqrt(typ_1m_vol * prev_close * 390) as weight, rvol_5m, gap_pct from causal),
dr0 as (select instrument_id, trading_date, product(1 + coalesce(r, 0)) - 1 as day_ret, arg_min(weight, minute_of_day) as weight from g0 group by all),
dr as (select * exclude (sw, sr, oc) from {_loo('dr0', 'trading_date', 'day_ret', 'day_mkt')}),
cal as (select trading_date, row_number() over (order by trading_date) as day_no from (select distinct trading_date from dr)),
beta as (select instrument_id, trading_date, case when regr_count(day_ret, day_mkt) over b = 20 and var_pop(day_mkt) over b >= 1e-18 then regr_slope(day_ret, day_mkt) over b end as beta
    from dr join cal using (trading_date) window b as (partition by instrument_id order by day_no range between 20 preceding and 1 preceding)),
g1 as (select * exclude (sw, sr, oc) from {_loo('g0', 'trading_date, minute_of_day', 'r', 'mkt')}),
gr as (select g1.*, beta, r - beta * mkt as resid from g1 left join beta using (instrument_id, trading_date))"""


#: Few names share a clock in the tick table; the operator's own tails begin at 2 deviations.
TAIL = 1.0


def base_grid(spark, d):
    g = grid.grid_of(causal(spark, d))
    return grid.residual_grid(g, grid.rolling_beta(grid.daily_returns(g)))


@register("g2_loo_market", f"with {GRID} select instrument_id, decision_ts, r, mkt from g1", "r mkt")
def _(spark, d):
    return grid.with_loo_market(grid.grid_of(causal(spark, d)), grid.CLOCK, "r", "mkt").select("instrument_id", "decision_ts", "r", "mkt")


@register("a19_daily_returns", f"with {GRID} select instrument_id, trading_date, day_ret, day_mkt from dr", "day_ret day_mkt")
def _(spark, d):
    return grid.daily_returns(grid.grid_of(causal(spark, d))).select("instrument_id", "trading_date", "day_ret", "day_mkt")


@register("g14_rolling_beta", f"with {GRID} select instrument_id, trading_date, beta from beta", "beta")
def _(spark, d):
    return grid.rolling_beta(grid.daily_returns(grid.grid_of(causal(spark, d))))


@register("g3_residual", f"with {GRID} select instrument_id, decision_ts, beta, resid from gr where resid is not null", "beta resid")
def _(spark, d):
    return base_grid(spark, d).select("instrument_id", "decision_ts", "beta", "resid").filter("resid is not null")


@register("g7_cross_section", f"""with {GRID}, z as (select *, (resid - avg(resid) over x) / (stddev_samp(resid) over x + 1e-12) as z,
    case when resid is not null then (rank() over (partition by trading_date, minute_of_day order by resid asc nulls last) + (count(*) over (partition by trading_date, minute_of_day, resid) - 1) / 2.0) / count(*) over x end as resid_rank,
    quantile_cont(abs(resid), 0.5) over x as xs_dispersion, avg(case when resid is not null then (resid > 0)::int::double end) over x as xs_breadth from gr window x as (partition by trading_date, minute_of_day))
select instrument_id, decision_ts, resid_rank, xs_dispersion, xs_breadth, avg(case when z is not null then (z > {TAIL})::int::double end) over x - avg(case when z is not null then (z < -{TAIL})::int::double end) over x as xs_tail_imbalance,
    resid_rank - lag(resid_rank) over (partition by instrument_id, trading_date order by minute_of_day) as resid_rank_change from z window x as (partition by trading_date, minute_of_day)""",
    "resid_rank xs_dispersion xs_breadth xs_tail_imbalance resid_rank_change")
def _(spark, d):
    return grid.cross_section(base_grid(spark, d), "resid", TAIL).select("instrument_id", "decision_ts", "resid_rank", "xs_dispersion", "xs_breadth", "xs_tail_imbalance", "resid_rank_change")


@register("g8_same_clock", f"""with {GRID}, dm as (select trading_date, minute_of_day, avg(r) as m from gr group by all),
sc as (select trading_date, minute_of_day, avg(m) over (partition by minute_of_day order by trading_date rows between unbounded preceding and 1 preceding) as same_clock_mean from dm)
select instrument_id, decision_ts, same_clock_mean, r - coalesce(same_clock_mean, 0) as same_clock_surprise from gr left join sc using (trading_date, minute_of_day)""", "same_clock_mean same_clock_surprise")
def _(spark, d):
    return grid.same_clock(base_grid(spark, d)).select("instrument_id", "decision_ts", "same_clock_mean", "same_clock_surprise")


_LEAD = lambda c: " * ".join(f"(1 + lead({c}, {k}) over w)" for k in (1, 2, 3)) + " - 1"


@register("g12_labels", f"""with {GRID} select instrument_id, decision_ts, {_LEAD('r')} as future_ret, {_LEAD('mkt')} as future_mkt, ({_LEAD('r')}) - beta * ({_LEAD('mkt')}) as future_residual, lead(r) over w as next_ret
    from gr window w as (partition by instrument_id, trading_date order by minute_of_day)""", "future_ret future_mkt future_residual next_ret")
def _(spark, d):
    return grid.labels(base_grid(spark, d)).select("instrument_id", "decision_ts", "future_ret", "future_mkt", "future_residual", "next_ret")


_LEAD6 = lambda c: " * ".join(f"(1 + lead({c}, {k}) over w)" for k in range(1, 7)) + " - 1"


@register("g12_labels_six_legs", f"with {GRID} select instrument_id, decision_ts, {_LEAD6('r')} as future_ret, ({_LEAD6('r')}) - beta * ({_LEAD6('mkt')}) as future_residual, lead(resid) over w as next_resid from gr window w as (partition by instrument_id, trading_date order by minute_of_day)", "future_ret future_residual next_resid")
def _(spark, d):
    return grid.labels(base_grid(spark, d), 6).select("instrument_id", "decision_ts", "future_ret", "future_residual", "next_resid")


@register("g18_repeated_keys", f"select {DESK} as instrument_id, ts::date as trading_date, (hour(ts) * 60 + minute(ts))::int as minute_of_day, count(*)::bigint as count from events group by all having count(*) > 1")
def _(spark, d):
    ticks = table(spark, d, "events").select(instrument_of().alias("instrument_id"), F.to_date("ts").alias("trading_date"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"))
    return grid.repeated_keys(ticks, ["instrument_id", "trading_date", "minute_of_day"])


# --- graph, over raw grid returns: the tick table has too few days for residual histories
_PAIRS = f"""{GRID}, wk as (select distinct date_trunc('week', trading_date)::date as as_of from g0), dts as (select distinct trading_date from g0),
kp as (select as_of, trading_date from wk join dts on trading_date < as_of qualify row_number() over (partition by as_of order by trading_date desc) <= 20),
h0 as (select as_of, instrument_id, trading_date, minute_of_day, r as x from g0 join kp using (trading_date) where r is not null),
h as (select *, case when lead(minute_of_day) over s - minute_of_day <= 60 then lead(x) over s end as x_next from h0 window s as (partition by as_of, instrument_id, trading_date order by minute_of_day) qualify count(*) over (partition by as_of, instrument_id) >= 40),
ps as (select a.as_of, a.instrument_id as leader_id, b.instrument_id as follower_id, corr(a.x, b.x) as corr, count(*)::bigint as n, corr(a.x, b.x_next) as lag_corr, count(b.x_next)::bigint as lag_n
    from h a join h b on a.as_of = b.as_of and a.trading_date = b.trading_date and a.minute_of_day = b.minute_of_day and a.instrument_id <> b.instrument_id group by all),
wk0 as (select as_of, count(distinct instrument_id)::bigint as names, count(distinct (trading_date, minute_of_day))::bigint as clocks from h0 group by 1),
us as (select as_of, count(distinct instrument_id)::bigint as usable from h group by 1),
sp as (select ps.* from ps join wk0 using (as_of) where names >= 3 and clocks >= 30 and corr is not null and not isnan(corr) qualify row_number() over (partition by as_of, follower_id order by abs(corr) desc, leader_id) <= 20),
lt0 as (select *, {t_p_sql('t', '(lag_n - 2)')} as p from (select *, lag_corr * sqrt((lag_n - 2) / (1 - lag_corr * lag_corr)) as t from sp where lag_n >= 40 and lag_corr is not null and abs(lag_corr) < 1)),
lt as (select * from {bh_sql('lt0', 'p', 'as_of', 'leader_id, follower_id')}),
sv as (select * from lt where q_value <= 0.5 and lag_corr > 0),
ed as (select *, row_number() over (partition by as_of, follower_id order by lag_corr desc, leader_id) as rank from sv qualify row_number() over (partition by as_of, follower_id order by lag_corr desc, leader_id) <= 5)"""
#: On noise false discoveries are let through at this rate, so that there are edges; the operator's own is 0.10.
EDGE_Q = 0.5


def graph_of(spark, d, g=None):
    """Weeks, structural pairs, tests and edges."""
    g = grid.grid_of(causal(spark, d)) if g is None else g
    pairs, weeks = graph.structural_pairs(graph.history(g), "r", 40)
    pairs = stored(pairs, "pairs")
    tests = stored(graph.lag_tests(pairs, 40, EDGE_Q), "tests")
    return weeks, pairs, tests, stored(graph.edges(tests, 5, EDGE_Q), "edges")


def pair_stats(spark, d, g=None):
    return graph.pair_statistics(graph.history(grid.grid_of(causal(spark, d)) if g is None else g), "r", 40)


@register("k3_pair_correlation", f"with {_PAIRS} select as_of, leader_id, follower_id, corr, n, lag_corr, lag_n from ps", "corr lag_corr")
def _(spark, d):
    return pair_stats(spark, d).select("as_of", "leader_id", "follower_id", "corr", "n", "lag_corr", "lag_n")


@register("k4_structural_peers", f"with {_PAIRS} select as_of, follower_id, leader_id, corr from sp", "corr")
def _(spark, d):
    return graph_of(spark, d)[1].select("as_of", "follower_id", "leader_id", "corr")


@register("k5_lag_tests", f"with {_PAIRS} select as_of, leader_id, follower_id, lag_corr, lag_n, t, p from lt", "lag_corr t p")
def _(spark, d):
    return graph_of(spark, d)[2].select("as_of", "leader_id", "follower_id", "lag_corr", "lag_n", "t", "p")


@register("k6_tested_edges", f"with {_PAIRS} select as_of, leader_id, follower_id, lag_corr, lag_n, p, q_value from ed", "lag_corr p q_value")
def _(spark, d):
    return graph_of(spark, d)[3].select("as_of", "leader_id", "follower_id", "lag_corr", "lag_n", "p", "q_value")


@register("k7_top_leaders", f"with {_PAIRS} select as_of, leader_id, follower_id, lag_corr, rank from ed", "lag_corr")
def _(spark, d):
    return graph_of(spark, d)[3].select("as_of", "leader_id", "follower_id", "lag_corr", "rank")


_PEERS = f"""{_PAIRS}, wt as (select as_of, leader_id, follower_id as instrument_id, abs(lag_corr) / nullif(sum(abs(lag_corr)) over (partition by as_of, follower_id), 0) as w from ed),
pf as (select g.trading_date, g.minute_of_day, wt.instrument_id, sum(w * g.r) as leader_shock, sum(w * (g.r > 0)::int) as leader_agreement, avg(g.r) as peer_return, avg((g.r > 0)::int::double) as peer_breadth,
    quantile_cont(abs(g.r), 0.5) as peer_dispersion from g0 g join wt on wt.leader_id = g.instrument_id and wt.as_of = date_trunc('week', g.trading_date)::date where g.r is not null group by all),
lc as (select as_of, follower_id as instrument_id, count(distinct leader_id)::bigint as leader_count from ed group by all),
pr as (select g.*, as_of, leader_shock, leader_agreement, peer_return, peer_breadth, peer_dispersion, coalesce(leader_count, 0)::bigint as leader_count, case when r is not null then (rank() over (partition by trading_date, minute_of_day order by r asc nulls last) + (count(*) over (partition by trading_date, minute_of_day, r) - 1) / 2.0) / count(*) over x end as own_rank,
    case when peer_return is not null then (rank() over (partition by trading_date, minute_of_day order by peer_return asc nulls last) + (count(*) over (partition by trading_date, minute_of_day, peer_return) - 1) / 2.0) / count(*) over x end as peer_rank
    from g0 g left join pf using (trading_date, minute_of_day, instrument_id) left join lc on lc.instrument_id = g.instrument_id and lc.as_of = date_trunc('week', g.trading_date)::date window x as (partition by trading_date, minute_of_day))"""


@register("k9_peer_features", f"""with {_PEERS} select instrument_id, decision_ts, leader_shock, leader_agreement, peer_return, peer_breadth, peer_dispersion, leader_count, leader_count as peer_count, leader_shock - r as response_gap, peer_return - r as peer_response_gap,
    peer_rank - own_rank as peer_rank_gap, leader_count > 0 as graph_available from pr""", "leader_shock leader_agreement peer_return peer_breadth peer_dispersion response_gap peer_response_gap peer_rank_gap")
def _(spark, d):
    g = stored(grid.grid_of(causal(spark, d)), "grid")
    return graph.peer_features(g, graph_of(spark, d, g)[3], "r").select("instrument_id", "decision_ts", "leader_shock", "leader_agreement", "peer_return", "peer_breadth", "peer_dispersion", "leader_count", "peer_count", "response_gap", "peer_response_gap", "peer_rank_gap", "graph_available")


@register("k8_lineage", f"""with {_PAIRS} select as_of, names, coalesce(usable, 0)::bigint as usable, clocks, coalesce(structural, 0)::bigint as structural, coalesce(tests, 0)::bigint as tests, coalesce(survivors, 0)::bigint as survivors, coalesce(edges, 0)::bigint as edges, median_abs_r
from wk0 left join us using (as_of) left join (select as_of, count(*) as structural from sp group by 1) using (as_of) left join (select as_of, count(*) as tests from lt group by 1) using (as_of)
left join (select as_of, count(*) as survivors, quantile_cont(abs(lag_corr), 0.5) as median_abs_r from sv group by 1) using (as_of) left join (select as_of, count(*) as edges from ed group by 1) using (as_of)""", "median_abs_r")
def _(spark, d):
    return graph.lineage(*graph_of(spark, d), EDGE_Q)


# --- statistics
@register("a7_horizon_summary", f"""with {_FWD}, r as (select *, row_number() over (partition by horizon order by abs(forward_return) desc, event_id) as k, count(*) over (partition by horizon) as nn from fwd where forward_return is not null)
select horizon, count(*)::bigint as n, avg(forward_return) as mean, stddev_samp(forward_return) as std, stddev_samp(forward_return) / sqrt(count(*)) as se, avg(forward_return) / nullif(stddev_samp(forward_return) / sqrt(count(*)), 0) as t_stat, avg(forward_return) / nullif(stddev_samp(forward_return), 0) as effect,
quantile_cont(forward_return, 0.1) as q10, quantile_cont(forward_return, 0.25) as q25, quantile_cont(forward_return, 0.5) as q50, quantile_cont(forward_return, 0.75) as q75, quantile_cont(forward_return, 0.9) as q90,
avg((forward_return > 0)::int::double) as positive_rate, coalesce(sum(case when k <= ceil(nn * 0.01) then forward_return end) / nullif(sum(forward_return), 0), 0) as top_share,
count(distinct session_date)::bigint as days, count(distinct instrument_id)::bigint as names, count(distinct (instrument_id, session_date))::bigint as name_days from r group by horizon""",
    "mean std se t_stat effect q10 q25 q50 q75 q90 positive_rate top_share")
def _(spark, d):
    return st.summary(forwards(spark, d), ["horizon"])


@register("a9_symbol_counts", f"with {_EVENTS} select instrument_id, count(*)::bigint as events, count(distinct session_date)::bigint as days from evt group by 1")
def _(spark, d):
    return gap_events(spark, d).groupBy("instrument_id").agg(F.count("*").alias("events"), F.countDistinct("session_date").alias("days"))


@register("a10_bucket_tables", f"""with {_FWD}, b as (select isodow(session_date)::int as weekday, case when entry_price < 20 then 'low' when entry_price < 60 then 'mid' else 'high' end as bucket, forward_return from fwd where forward_return is not null)
select weekday, bucket, count(*)::bigint as n, avg(forward_return) as mean from b group by grouping sets ((weekday), (bucket), (weekday, bucket), ())""", "mean")
def _(spark, d):
    p = F.col("entry_price")
    b = forwards(spark, d).filter("forward_return is not null").select((F.weekday("session_date") + 1).alias("weekday"), F.when(p < 20, "low").when(p < 60, "mid").otherwise("high").alias("bucket"), "forward_return")
    return b.cube("weekday", "bucket").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean"))


@register("a11_without_top", f"""with {_FWD}, r as (select *, row_number() over (partition by horizon order by forward_return desc, event_id) as k, count(*) over (partition by horizon) as nn, quantile_cont(forward_return, 0.99) over (partition by horizon) as q from fwd where forward_return is not null)
select horizon, avg(case when k > ceil(nn * 0.05) then forward_return end) as mean_without_top, avg(case when forward_return <= q then forward_return end) as mean_below_q99 from r group by 1""", "mean_without_top mean_below_q99")
def _(spark, d):
    return st.without_top(forwards(spark, d), ["horizon"], 0.05)


_DAYM = f"{_FWD}, dm as (select horizon, session_date, avg(forward_return) as m, sum(forward_return) as s, count(*) as c from fwd where forward_return is not null group by all)"


@register("a17_day_agreement", f"""with {_DAYM}, k as (select *, row_number() over (partition by horizon order by m desc, session_date) as k from dm)
select horizon, avg((m > 0)::int::double) as positive_days, sum(case when k > 1 then s end) / nullif(sum(case when k > 1 then c end), 0) as mean_without_best_day, count(*)::bigint as days from k group by 1""", "positive_days mean_without_best_day")
def _(spark, d):
    return st.day_agreement(forwards(spark, d), ["horizon"])


@register("a23_concentration", f"with {_FWD}, c as (select horizon, instrument_id, count(*) as c from fwd group by all) select horizon, max(c) / sum(c) as top_share, count(*)::bigint as values from c group by 1", "top_share")
def _(spark, d):
    return st.concentration(forwards(spark, d), ["horizon"], "instrument_id")


_DRAW = "(('0x' || md5('7:' || rep || ':' || slot)[1:12])::bigint % n)"


@register("t2_bootstrap", f"""with {_DAYM}, i as (select *, row_number() over (partition by horizon order by session_date) - 1 as i, count(*) over (partition by horizon) as n from dm),
dr as (select horizon, rep, {_DRAW} as i from (select horizon, i as slot, n, unnest(generate_series(0, 199)) as rep from i)),
m as (select horizon, rep, sum(s) / sum(c) as m from dr join i using (horizon, i) group by all)
select horizon, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high, least(1.0, 2 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))) as p_boot from m group by 1""", "ci_low ci_high p_boot")
def _(spark, d):
    return st.bootstrap(forwards(spark, d), ["horizon"], 200)


@register("t4_reality_check", f"""with {_DAYM}, dy as (select session_date, row_number() over (order by session_date) - 1 as i, count(*) over () as n from (select distinct session_date from dm)),
seen as (select max(mu / greatest(se, 1e-12)) as best, count(*) as rules, max(n) as n from (select horizon, avg(m) as mu, stddev_samp(m) / sqrt((select max(n) from dy)) as se, (select max(n) from dy) as n from dm group by 1)),
cen as (select horizon, greatest(avg(m), 0.0) as c from dm group by 1), dr as (select rep, {_DRAW} as i from (select i as slot, n, unnest(generate_series(0, 199)) as rep from dy)),
per as (select rep, horizon, (avg(m) - any_value(cen.c)) / greatest(stddev_samp(m) / sqrt(any_value(dy.n)), 1e-12) as t from dr join dy using (i) join dm using (session_date) join cen using (horizon) group by all), top as (select rep, max(t) as t from per group by 1)
select any_value(best) as best_t, any_value(rules)::bigint as rules, any_value(n)::bigint as days, case when any_value(n) >= 10 then (count(*) filter (t >= best - 1e-9) + 1) / (count(*) + 1) end as p_value from top, seen""", "best_t p_value")
def _(spark, d):
    m = forwards(spark, d).filter("forward_return is not null").groupBy(F.col("horizon").alias("rule"), "session_date").agg(F.avg("forward_return").alias("m"))
    return st.reality_check(m, 200)


_BH = "select o_orderpriority as g, o_orderkey as id, (floor(o_totalprice) % 997) / 997.0 * ((o_orderkey % 10) / 10.0) as p from orders"


@register("t3_benjamini_hochberg", f"""with t as ({_BH}), k as (select *, row_number() over (partition by g order by p, id) as k, count(*) over (partition by g) as n from t),
b as (select *, least(1.0, min(p * n / k) over (partition by g order by p, id rows between current row and unbounded following)) as q_value, max(case when p <= 0.1 * k / n then p end) over (partition by g) as bound from k)
select g, id, p, q_value, coalesce(p <= bound, false) as rejected from b""", "p q_value")
def _(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderpriority as g", "o_orderkey as id", "(floor(o_totalprice) % 997) / 997.0D * ((o_orderkey % 10) / 10.0D) as p")
    return with_bh_wide(stored(t, "tests"), "p", ["g"], 0.1, ["id"]).select("g", "id", "p", "q_value", "rejected")


_PANEL_F = ["rvol_5m", "gap_pct", "xs_ret_rank", "close_location_value"]
_LONG = f"""{CAUSAL}, pn as (select *, lead(ret_1m) over (partition by instrument_id, session_date order by ts_utc) as y from causal),
lg as (select session_date, y, f.feature as feature, f.x as x from (select session_date, y, unnest([{', '.join("{'feature': '" + f + "', 'x': " + f + "::double}" for f in _PANEL_F)}]) as f from pn where y is not null) where f.x is not null)"""


def panel(spark, d):
    return causal(spark, d).withColumn("y", F.lead("ret_1m").over(Window.partitionBy("instrument_id", "session_date").orderBy("ts_utc")))


@register("t8_day_association", f"""with {_LONG}, rk as (select session_date, feature, rank() over (partition by session_date, feature order by x) + (count(*) over (partition by session_date, feature, x) - 1) / 2.0 as rx,
    rank() over (partition by session_date, feature order by y) + (count(*) over (partition by session_date, feature, y) - 1) / 2.0 as ry from lg),
pd as (select session_date, feature, count(*) as n, corr(rx, ry) as rho from rk group by all having count(*) >= 10 and corr(rx, ry) is not null and not isnan(corr(rx, ry)))
select feature, count(*)::bigint as days, avg(rho) as mean_rho, avg(rho) * sqrt(count(*)) / nullif(stddev_samp(rho), 0) as t_stat from pd group by 1""", "mean_rho t_stat")
def _(spark, d):
    return st.day_association(panel(spark, d), _PANEL_F, "y")


_ASSOC = f"""{_LONG}, rk as (select session_date, feature, rank() over (partition by session_date, feature order by x) + (count(*) over (partition by session_date, feature, x) - 1) / 2.0 as rx,
    rank() over (partition by session_date, feature order by y) + (count(*) over (partition by session_date, feature, y) - 1) / 2.0 as ry from lg),
pd as (select session_date, feature, corr(rx, ry) as rho from rk group by all having count(*) >= 10 and corr(rx, ry) is not null and not isnan(corr(rx, ry))),
ta as (select feature, count(*)::bigint as days, avg(rho) as mean_rho, avg(rho) * sqrt(count(*)) / nullif(stddev_samp(rho), 0) as t_stat from pd group by 1),
tb as (select *, {t_p_sql('t_stat', '(days - 1)')} as p, 'root' as node from ta)"""


@register("t5_association_p", f"with {_ASSOC} select *, q_value <= 0.1 as rejected from {bh_sql('tb', 'p', 'node', 'feature')}", "mean_rho t_stat p q_value")
def _(spark, d):
    a = st.day_association(panel(spark, d), _PANEL_F, "y").withColumn("p", t_p("t_stat", (F.col("days") - 1).cast("double")))
    return with_bh(a.withColumn("node", F.lit("root")), "p", ["node"], 0.1, ["feature"])


_BANK = f"{_LONG}, bk0 as (" + " union all ".join(f"select '{f}' as feature, quantile_cont({f}, [{', '.join(str(i / 10) for i in range(1, 10))}]) as cuts from pn" for f in _PANEL_F) + "), bk as (select feature, unnest(cuts) as cut, generate_subscripts(cuts, 1)::int - 1 as no from bk0)"


@register("t10_quantile_bank", f"with {_BANK} select feature, no, cut from bk", "cut")
def _(spark, d):
    return st.quantile_bank(panel(spark, d), _PANEL_F)


@register("t11_split_scores", f"""with {_BANK} select feature, cut, avg(case when x <= cut then y end) as left_mean, avg(case when x > cut then y end) as right_mean, count(*) filter (x <= cut)::bigint as n_left, count(*) filter (x > cut)::bigint as n_right,
abs(avg(case when x <= cut then y end) - avg(case when x > cut then y end)) as score from lg join (select distinct feature, cut from bk) using (feature) group by 1, 2 having count(*) filter (x <= cut) >= 5 and count(*) filter (x > cut) >= 5""", "cut left_mean right_mean score")
def _(spark, d):
    p = panel(spark, d)
    bank = st.quantile_bank(p, _PANEL_F).select("feature", "cut").distinct()
    return st.split_scores(p, bank, _PANEL_F, "y")


@register("t12_tree_rules")
def _(spark, d):
    """Rules of the conditional-inference tree on the first 40 % of days, with their parsimonious forms on the next 20 %."""
    days = st.chronological_split(session_days(spark, d), "session_date", 5)
    p = panel(spark, d).filter("y is not null").select("instrument_id", "session_date", "y", *_PANEL_F, "new_high_15")
    p = stored(p.join(F.broadcast(days), "session_date"), "panel")
    first, second = p.filter("split = 'D1'"), p.filter("split = 'D2'")
    rules = tree.grow(first, [*_PANEL_F, "new_high_15"], "y", depth=3, alpha=0.5, least=40)
    short = tree.simplified(second, rules, "y", 10, 2, 2, 0.9)
    rows = [(str(r), r.n, r.mean, r.direction, str(s)) for r, s in zip(rules, short)]
    return spark.createDataFrame(rows, "rule string, n long, mean double, direction string, simplified string")


_DAILY_STATS = f"""{CAUSAL}, pn as (select *, lead(ret_1m) over (partition by instrument_id, session_date order by ts_utc) as y from causal),
lg as (select node, session_date, y, f.feature as feature, f.x as x from (select case when gap_pct > 0 then 'up' else 'down' end as node, session_date, y, unnest([{', '.join("{'feature': '" + f + "', 'x': " + f + "::double}" for f in (*_PANEL_F, 'new_high_15'))}]) as f from pn where y is not null) where f.x is not null),
rk as (select *, rank() over (partition by node, session_date, feature order by x) + (count(*) over (partition by node, session_date, feature, x) - 1) / 2.0 as rx, rank() over (partition by node, session_date, feature order by y) + (count(*) over (partition by node, session_date, feature, y) - 1) / 2.0 as ry from lg where feature <> 'new_high_15'),
ds as (select node, session_date, feature, corr(rx, ry) as s from rk group by all having count(*) >= 10 and corr(rx, ry) is not null and not isnan(corr(rx, ry))
    union all select node, session_date, feature, avg(y) filter (x = 1) - avg(y) filter (x = 0) as s from lg where feature = 'new_high_15' group by all having count(*) >= 20 and count(*) filter (x = 1) >= 5 and count(*) filter (x = 0) >= 5)"""


@register("t8_daily_differences", f"""with {_DAILY_STATS}, al as (select * from (select distinct node from lg), (select distinct feature from lg))
select node, feature, count(s)::bigint as days, avg(s) * sqrt(count(s)) / nullif(stddev_samp(s), 0) as t from al left join ds using (node, feature) group by all""", "t")
def _(spark, d):
    """Days and t of the daily statistics at two nodes: rank correlations, and for the flag differences of means by day."""
    p = panel(spark, d).filter("y is not null").withColumn("_node", F.when(F.col("gap_pct") > 0, "up").otherwise("down"))
    return tree.associations(p, [*_PANEL_F, "new_high_15"], ["new_high_15"], "y").select(F.col("_node").alias("node"), "feature", "days", "t")


@register("t7_welch", f"""with {CAUSAL}, pn as (select *, lead(ret_1m) over (partition by instrument_id, session_date order by ts_utc) as y from causal),
g as (select feature, count(*) filter (x) as n1, avg(y) filter (x) as m1, var_samp(y) filter (x) as v1, count(*) filter (not x) as n0, avg(y) filter (not x) as m0, var_samp(y) filter (not x) as v0
    from (select y, unnest([{{'feature': 'new_high_15', 'x': new_high_15}}, {{'feature': 'new_low_15', 'x': new_low_15}}], recursive := true) from pn where y is not null) where x is not null group by 1)
select feature, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) as t, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) as df from g""", "t df")
def _(spark, d):
    return tree.welch(panel(spark, d), ["new_high_15", "new_low_15"], "y").select("feature", "t", "df")


@register("t9_node_association", f"""with {_DAILY_STATS}, al as (select * from (select distinct node from lg), (select distinct feature from lg)),
tt as (select node, feature, count(s)::bigint as days, avg(s) * sqrt(count(s)) / nullif(stddev_samp(s), 0) as t from al left join ds using (node, feature) group by all),
tp as (select *, case when days >= 8 and t is not null then {t_p_sql('t', '(days - 1)')} else 1.0 end as p from tt)
select node, feature, days, t, p, q_value from {bh_sql('tp', 'p', 'node', 'feature')}""", "t p q_value")
def _(spark, d):
    """Association of every feature with the target at two nodes by gap, with q values a node."""
    p = panel(spark, d).filter("y is not null").withColumn("_node", F.when(F.col("gap_pct") > 0, "up").otherwise("down"))
    return tree.associations(p, [*_PANEL_F, "new_high_15"], ["new_high_15"], "y").withColumnRenamed("_node", "node")


def _stability(spark, d):
    p = stored(panel(spark, d).filter("y is not null").select("instrument_id", "session_date", "y", *_PANEL_F), "panel")
    rules = tree.grow(p, _PANEL_F, "y", depth=2, alpha=0.5, least=40)
    return tree.path_stability(p, rules, _PANEL_F, "y", 20, depth=2, alpha=0.5, least=20)


@register("t18_path_stability")
def _(spark, d):
    """How often trees on half of the days find the same rules."""
    rows = [(x["rule"], x["found"], x["agreed"], x["settled"], x["stable"]) for x in _stability(spark, d)]
    return spark.createDataFrame(rows, "rule string, found double, agreed double, settled int, stable boolean")


@register("t17_forest_features")
def _(spark, d):
    """In how many of the trees on half of the days each feature is used."""
    p = stored(panel(spark, d).filter("y is not null").select("instrument_id", "session_date", "y", *_PANEL_F), "panel")
    grown = tree.forest(p, tree.half_samples(p.select("session_date"), "session_date", 20), _PANEL_F, "y", depth=2, alpha=0.5, least=20)
    return spark.createDataFrame([(f, sum(any(f == g for r in own for g, _, _ in r.path) for own in grown.values())) for f in _PANEL_F], "feature string, trees int")


@register("t17_half_samples", f"""with {BARS}, dd as (select distinct session_date from ses), k as (select fold, session_date, row_number() over (partition by fold order by md5('7:' || fold || ':' || session_date)) as k, count(*) over (partition by fold) as n from dd, generate_series(0, 99) as t(fold))
select fold::int as fold, session_date as day from k where k <= greatest(1, floor(n * 0.5))""")
def _(spark, d):
    return tree.half_samples(session_bars(spark, d).select("session_date"), "session_date", 100)


@register("t17_fold_cuts", f"""with {_LONG}, dd as (select distinct session_date from lg), k as (select fold::int as fold, session_date, row_number() over (partition by fold order by md5('7:' || fold || ':' || session_date)) as k, count(*) over (partition by fold) as n from dd, generate_series(0, 9) as t(fold)),
fd as (select fold, session_date from k where k <= greatest(1, floor(n * 0.5))), q as (select fold, feature, unnest(quantile_cont(x, [0.25, 0.5, 0.75])) as cut from lg join fd using (session_date) where feature in (select feature from lg group by 1 having count(distinct x) > 4) group by 1, 2 having count(*) >= 50)
select distinct fold, feature, round(cut, 9) as cut from q""", "cut")
def _(spark, d):
    """Quartiles of each feature over the days of ten half samples."""
    p = panel(spark, d).filter("y is not null")
    rows = stored(tree.panel_rows(p, _PANEL_F, "y", name="instrument_id", day="session_date"), "panel")
    folds = stored(tree.half_samples(rows.select("day"), "day", 10), "folds")
    cuts = tree.fold_cuts(rows, folds, list(range(len(_PANEL_F))), 4)
    return cuts.select("fold", F.get(F.array(*map(F.lit, _PANEL_F)), F.col("f")).alias("feature"), F.round("cut", 9).alias("cut")).distinct()


@register("t20_stage_gate", f"""with {_FWD}, r as (select *, row_number() over (partition by horizon order by abs(forward_return) desc, event_id) as k, count(*) over (partition by horizon) as nn from fwd where forward_return is not null),
s as (select horizon, count(*)::bigint as n, avg(forward_return) as mean, coalesce(sum(case when k <= ceil(nn * 0.01) then forward_return end) / nullif(sum(forward_return), 0), 0) as top_share from r group by 1),
g as (select *, case when n < 100 then 'sample' when top_share > 0.9 then 'concentration' when mean <= 0 then 'sign' when mean < 0.1 then 'size' end as reason from s)
select horizon, n, reason, case when reason is null then 'PASS' when reason = 'size' then 'WATCH' else 'KILL' end as decision from g""")
def _(spark, d):
    return st.gate(st.summary(forwards(spark, d), ["horizon"]), F.lit(0.1), 100, 0.9).select("horizon", "n", "reason", "decision")


@register("p11_chronological_split", f"with {BARS}, dd as (select distinct session_date from ses), i as (select *, row_number() over (order by session_date) - 5 as i, count(*) over () - 5 as n from dd) select session_date, case when i / n <= 0.4 then 'D1' when i / n <= 0.4 + 0.2 then 'D2' else 'D3' end as split from i where i > 0")
def _(spark, d):
    return st.chronological_split(session_bars(spark, d).select("session_date").distinct(), "session_date", 5)


@register("p12_hash_panel", f"with {BARS}, dd as (select distinct session_date from ses) select session_date from dd qualify row_number() over (order by ('0x' || sha256('v1:fast:' || session_date::varchar)[1:8])::bigint % 10007, session_date) <= 10")
def _(spark, d):
    return st.hash_panel(session_bars(spark, d).select("session_date").distinct(), "session_date", "v1:fast", 10)


@register("t27_frame_hash", "select count(*)::bigint as rows, coalesce(sum(('0x' || md5(concat_ws('|', coalesce(l_linenumber::varchar, '\\N'), coalesce(l_orderkey::varchar, '\\N'), coalesce(l_partkey::varchar, '\\N'), coalesce(l_returnflag, '\\N'), coalesce(l_suppkey::varchar, '\\N')))[1:12])::bigint), 0)::varchar as fingerprint from lineitem")
def _(spark, d):
    return st.frame_hash(table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"))


# --- models: the scaler and the weights know the first 60 % of days only
_M_F = ["rvol_5m", "close_location_value"]
_FIT = f"""{CAUSAL}, md as (select session_date, row_number() over (order by session_date) / count(*) over ()::double <= 0.6 as train from (select distinct session_date from causal)),
mp as (select instrument_id, ts_utc, train, {', '.join(_M_F)}, lead(ret_1m) over (partition by instrument_id, session_date order by ts_utc) as y from causal join md using (session_date)),
ms as (select {', '.join(f'avg({f}) filter (train) as m{i}, stddev_pop({f}) filter (train) as s{i}' for i, f in enumerate(_M_F))} from mp),
mz as (select instrument_id, ts_utc, train, y, {', '.join(f'coalesce(({f} - m{i}) / nullif(s{i}, 0), 0) as z{i}' for i, f in enumerate(_M_F))} from mp, ms),
mg as (select sum(z0 * z0) as a, sum(z0 * z1) as b, sum(z1 * z1) as c, sum(z0 * y) as u, sum(z1 * y) as v from mz where train and y is not null)"""
_RIDGE = lambda al: f"(((c + {al}) * u - b * v) / ((a + {al}) * (c + {al}) - b * b) * z0 + ((a + {al}) * v - b * u) / ((a + {al}) * (c + {al}) - b * b) * z1)"


def train_test(spark, d, features):
    """Rows of the first 60 % of days and of the rest, both standardised by the first."""
    p = stored(panel(spark, d).select("instrument_id", "session_date", "ts_utc", "y", *features), "panel")
    days = st.chronological_split(p.select("session_date").distinct(), "session_date", 0, (0.6, 0.0, 0.4))
    p = p.join(days, "session_date")
    return [models.standardised(p.filter(part), features, p.filter("split = 'D1'")) for part in ("split = 'D1'", "split <> 'D1'")]


@register("m2_ridge_scores", f"with {_FIT} select instrument_id, ts_utc, {_RIDGE(10)} as score from mz, mg where not train", "score")
def _(spark, d):
    train, test = train_test(spark, d, _M_F)
    xs = [f"z_{f}" for f in _M_F]
    return test.select("instrument_id", "ts_utc", models.score(xs, models.ridge(train, xs, "y", 10.0)).alias("score"))


@register("m10_train_scaler", f"with {_FIT} select instrument_id, ts_utc, train, z0, z1 from mz", "z0 z1")
def _(spark, d):
    train, test = train_test(spark, d, _M_F)
    return train.unionByName(test).select("instrument_id", "ts_utc", (F.col("split") == "D1").alias("train"), F.col(f"z_{_M_F[0]}").alias("z0"), F.col(f"z_{_M_F[1]}").alias("z1"))


# --- normal equations by day: the first 70 % of days, split at three places, and the rest
_PENALTIES, _SHARES = (0.1, 10.0, 1000.0), (0.5, 0.7, 0.8)
_MOMENTS = f"""{CAUSAL}, pr as (select instrument_id, ts_utc, session_date, coalesce({_M_F[0]}, 0) as x0, coalesce({_M_F[1]}, 0) as x1, lead(ret_1m) over (partition by instrument_id, session_date order by ts_utc) as y from causal),
dn as (select session_date, row_number() over (order by session_date) / count(*) over ()::double <= 0.7 as early from (select distinct session_date from pr)),
pn as (select * from pr join dn using (session_date) where y is not null),
cu as (select session_date, sum(count(*)) over (order by session_date) as seen, sum(count(*)) over () as total from pn where early group by 1),
rw as (select pn.*, share, seen <= share * total + 1e-9 as first from pn join cu using (session_date), (select unnest([0.5, 0.7, 0.8]::double[]) as share)),
sc as (select share, avg(x0) filter (first) as m0, stddev_pop(x0) filter (first) as s0, avg(x1) filter (first) as m1, stddev_pop(x1) filter (first) as s1, avg(y) filter (first) as my from rw group by 1),
zr as (select rw.*, (x0 - m0) / s0 as z0, (x1 - m1) / s1 as z1, my from rw join sc using (share)),
gr as (select share, sum(z0 * z0) as a, sum(z0 * z1) as b, sum(z1 * z1) as c, sum(z0 * y) as u, sum(z1 * y) as v, any_value(my) as my from zr where first group by 1),
wt as (select share, penalty, my, ((c + penalty) * u - b * v) / ((a + penalty) * (c + penalty) - b * b) as w0, ((a + penalty) * v - b * u) / ((a + penalty) * (c + penalty) - b * b) as w1 from gr, (select unnest([0.1, 10.0, 1000.0]::double[]) as penalty)),
er as (select share, penalty, avg((wt.my + w0 * z0 + w1 * z1 - y) ** 2) as error from zr join wt using (share) where not first group by all),
pk as (select *, row_number() over (partition by share order by error, penalty) = 1 as picked from er)"""


def _early(spark, d):
    p = stored(panel(spark, d).select("session_date", "instrument_id", "ts_utc", "y", *_M_F).filter("y is not null"), "panel")
    days = st.chronological_split(session_bars(spark, d).filter("is_rth").select("session_date").distinct(), "session_date", 0, (0.7, 0.0, 0.3))
    return [p.join(days.filter(part), "session_date") for part in ("split = 'D1'", "split <> 'D1'")]


@register("m9_day_moments", f"with {_MOMENTS} select session_date as day, count(*)::double as m0_0, sum(x0) as m0_1, sum(x1) as m0_2, sum(y) as m0_3, sum(x0 * x0) as m1_1, sum(x0 * x1) as m1_2, sum(x0 * y) as m1_3, sum(x1 * x1) as m2_2, sum(x1 * y) as m2_3, sum(y * y) as m3_3 from pn where early group by 1", "m0_0 m0_1 m0_2 m0_3 m1_1 m1_2 m1_3 m2_2 m2_3 m3_3")
def _(spark, d):
    return models.day_moments(_early(spark, d)[0], _M_F, "y")


@register("m8_picked_penalty", f"with {_MOMENTS} select share, penalty, error, picked from pk", "error")
def _(spark, d):
    """Errors of each penalty for three splits of the days, all from one table of day sums."""
    early = _early(spark, d)[0]
    rows = []
    for share, (first, rest) in models.split_moments(stored(models.day_moments(early, _M_F, "y"), "moments"), _SHARES).items():
        _, best, errors = models.picked_ridge(first, rest, _PENALTIES)
        rows += [(share, p, e, p == best) for p, e in errors.items()]
    return spark.createDataFrame(rows, "share double, penalty double, error double, picked boolean")


@register("m10_picked_spread", f"""with {_MOMENTS}, la as (select share, w.my + w0 * (x0 - m0) / s0 + w1 * (x1 - m1) / s1 as s, y from pn, sc join (select wt.* from wt join pk using (share, penalty) where picked) w using (share) where not early),
qs as (select share, quantile_cont(s, 0.1) as lo, quantile_cont(s, 0.9) as hi from la group by 1)
select share, count(*)::bigint as n, avg(y) filter (s >= hi) - avg(y) filter (s <= lo) as spread from la join qs using (share) group by 1""", "spread")
def _(spark, d):
    """Spread of later returns between top and bottom tenth of scores of the picked ridge, scaled by its training days."""
    early, late = _early(spark, d)
    out = None
    for share, (first, rest) in models.split_moments(stored(models.day_moments(early, _M_F, "y"), "moments"), _SHARES).items():
        fit, _, _ = models.picked_ridge(first, rest, _PENALTIES)
        one = models.decile_spread(late.select(fit.score(_M_F).alias("s"), "y"), "s", "y").select(F.lit(share).alias("share"), "n", "spread")
        out = one if out is None else out.unionByName(one)
    return out


@register("m1_standardise", f"with {CAUSAL} select instrument_id, ts_utc, coalesce((gap_pct - avg(gap_pct) over ()) / nullif(stddev_pop(gap_pct) over (), 0), 0) as z_gap_pct from causal", "z_gap_pct")
def _(spark, d):
    return models.standardised(causal(spark, d), ["gap_pct"]).select("instrument_id", "ts_utc", "z_gap_pct")


@register("m5_coverage", f"with {CAUSAL} select instrument_id, ts_utc, resid_5m from causal where resid_5m is not null qualify row_number() over (order by abs(resid_5m) desc, instrument_id, ts_utc) <= round(count(*) over () * 0.05)", "resid_5m")
def _(spark, d):
    return models.most_certain(causal(spark, d).filter("resid_5m is not null").select("instrument_id", "ts_utc", "resid_5m"), "resid_5m", 0.05, ["instrument_id", "ts_utc"])


@register("m6_rank_tails", f"""with {CAUSAL}, k as (select instrument_id, ts_utc, session_date, minute_of_day, row_number() over (partition by session_date, minute_of_day order by resid_5m desc, instrument_id) as t,
    row_number() over (partition by session_date, minute_of_day order by resid_5m asc, instrument_id) as l, greatest(1, round(count(*) over (partition by session_date, minute_of_day) * 0.2)::int) as n from causal where resid_5m is not null)
select instrument_id, ts_utc, case when t <= n then 'LONG' else 'SHORT' end as side from k where t <= n or l <= n""")
def _(spark, d):
    return models.rank_tails(causal(spark, d), ["session_date", "minute_of_day"], "resid_5m", 0.2, ["instrument_id"]).select("instrument_id", "ts_utc", "side")


# --- quality
_DAYS = f"""{BARS}, days as (select session_date, count(*)::bigint as rows, count(distinct instrument_id)::bigint as names, min(ts_utc) as first_ts, max(ts_utc) as last_ts,
count(*) filter (high < greatest(open, close) or low > least(open, close) or high < low)::bigint as bad_ohlc, count(*) filter (least(open, high, low, close) <= 0)::bigint as non_positive, count(*) filter (volume < 0)::bigint as negative_volume,
count(*) filter (transactions < 0)::bigint as negative_transactions, count(*) filter (epoch_us(ts_utc) % 60000000 <> 0)::bigint as off_minute, count(*) filter (not (is_premarket or is_rth or is_after_hours))::bigint as out_of_hours, (count(*) - count(distinct (instrument_id, ts_utc)))::bigint as extra_rows, count(*) filter (is_premarket)::bigint as premarket_rows, count(*) filter (is_rth)::bigint as rth_rows, count(*) filter (is_after_hours)::bigint as after_hours_rows, max(high) as max_high, min(low) as min_low from ses group by 1)"""


@register("q1_by_date", f"with {_DAYS} select * from days", "max_high min_low")
def _(spark, d):
    return quality.by_date(session_bars(spark, d))


@register("q2_repeated_keys", "select user_id, event_type, ts::date as day, count(*)::bigint as times from events group by all having count(*) > 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("times")).filter("times > 1")


@register("q3_worst_rows", f"with {BARS} select session_date, instrument_id, ts_utc, row_number() over w as rank, high from ses window w as (partition by session_date order by high desc, instrument_id, ts_utc) qualify row_number() over w <= 5", "high")
def _(spark, d):
    return quality.worst_rows(session_bars(spark, d), "high").select("session_date", "instrument_id", "ts_utc", "rank", "high")


@register("q4_overnight_jumps", f"""with {DAILY}, j as (select instrument_id, session_date, lag(rth_close) over w as prev_close, rth_open, rth_open / nullif(lag(rth_close) over w, 0) - 1 as jump from daily window w as (partition by instrument_id order by session_date)),
sp as (select distinct {DESK} as instrument_id, ts::date as session_date from events where event_type = 'error') select j.*, sp.instrument_id is not null as explained from j left join sp using (instrument_id, session_date) where abs(jump) >= 0.4""", "prev_close rth_open jump")
def _(spark, d):
    actions = table(spark, d, "events").filter("event_type = 'error'").select(instrument_of().alias("instrument_id"), F.to_date("ts").alias("effective_date"))
    return quality.overnight_jumps(daily_facts(session_bars(spark, d)), actions)


_JUMPS = """cj as (select session_date, rows, names, lag(names) over (order by session_date) as before, quantile_cont(names, 0.5) over () as mn, quantile_cont(rows, 0.5) over () as mr from days),
jp as (select session_date, rows, names, before, coalesce(abs(names - before) / nullif(before, 0) > 0.25, false) as jump, not (names between 0.5 * mn and 1.5 * mn) or not (rows between 0.5 * mr and 1.5 * mr) as outside from cj)"""


@register("q6_coverage_jumps", f"with {_DAYS}, {_JUMPS} select * from jp where jump or outside")
def _(spark, d):
    return quality.coverage_jumps(quality.by_date(session_bars(spark, d)))


@register("q7_missing_weekdays", """with d as (select distinct o_orderpriority as feed, o_orderdate::date as session_date from orders), r as (select feed, unnest(generate_series(min(session_date), max(session_date), interval 1 day))::date as session_date from d group by feed)
select r.feed, r.session_date from r anti join d on r.feed = d.feed and r.session_date = d.session_date where isodow(r.session_date) < 6""")
def _(spark, d):
    return quality.missing_weekdays(table(spark, d, "orders").select(F.col("o_orderpriority").alias("feed"), F.to_date("o_orderdate").alias("session_date")), ["feed"])


@register("q9_verdict", f"""with {DAILY}, {_DAYS[len(BARS) + 2:]}, {_JUMPS},
oj as (select o.*, s_suppkey is not null as explained from (select instrument_id, session_date, rth_open / nullif(lag(rth_close) over (partition by instrument_id order by session_date), 0) - 1 as jump from daily) o left join supplier on instrument_id = 'i' || s_suppkey and s_suppkey % 2 = 0 where abs(jump) >= 0.4),
ex as (select (count(*) filter (high >= 400) + count(*) filter (volume >= 4) + count(*) filter (abs(m) >= 5))::bigint as n from (select *, close / nullif(lag(close) over (partition by instrument_id, session_date order by ts_utc), 0) - 1 as m from ses)),
wk as (select count(*)::bigint as n from (select unnest(generate_series(min(session_date), max(session_date), interval 1 day))::date as session_date from days) g where isodow(session_date) < 6 and session_date not in (select session_date from days)),
t as (select sum(rows) as r, sum(bad_ohlc)::bigint as a, sum(bad_ohlc + non_positive + negative_volume + negative_transactions)::bigint as odd, sum(off_minute)::bigint as om, sum(out_of_hours)::bigint as oh, sum(extra_rows)::bigint as xr from days),
q as (select t.*, (select count(*) from jp where jump or outside)::bigint as jn, (select count(*) from oj)::bigint as onn, (select count(*) from oj where not explained)::bigint as un, ex.n as en, wk.n as wn, (select count(*) from supplier)::bigint as sn from t, ex, wk),
c as (select unnest([{{'category': 'coverage', 'found': wn + jn, 'grade': case when wn > 0 then 'FAIL' when jn > 0 then 'WARNING' else 'PASS' end}}, {{'category': 'uniqueness', 'found': xr, 'grade': case when xr >= 100 then 'FAIL' when xr > 0 then 'WARNING' else 'PASS' end}},
    {{'category': 'ohlc', 'found': odd, 'grade': case when a > 0.001 * r then 'FAIL' when odd > 0 then 'WARNING' else 'PASS' end}}, {{'category': 'timestamps', 'found': oh + om, 'grade': case when oh > 0.01 * r then 'FAIL' when oh + om > 0 then 'WARNING' else 'PASS' end}},
    {{'category': 'splits', 'found': onn, 'grade': case when un > 500 then 'FAIL' when onn > 0 then 'WARNING' else 'PASS' end}}, {{'category': 'extremes', 'found': en, 'grade': case when en > 0 then 'WARNING' else 'PASS' end}},
    {{'category': 'reference_pit', 'found': sn, 'grade': case when sn = 0 then 'FAIL' else 'WARNING' end}}, {{'category': 'instrument_identity', 'found': 0::bigint, 'grade': 'WARNING'}}], recursive := true) from q)
select category, found, grade from c union all select 'verdict', count(*) filter (grade = 'FAIL')::bigint, case when count(*) filter (grade = 'FAIL') > 0 then 'NOT_READY' else 'READY_FOR_EXPLORATORY_RESEARCH' end from c""")
def _(spark, d):
    """Certification of the bars: splits stand in for every second supplier, on every day."""
    bars = stored(session_bars(spark, d), "bars")
    days = stored(quality.by_date(bars), "days")
    even = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("i"), "s_suppkey").alias("instrument_id"))
    actions = even.crossJoin(F.broadcast(days.select(F.col("session_date").alias("effective_date"))))
    gaps = quality.missing_weekdays(days.withColumn("feed", F.lit(0)), ["feed"])
    return quality.certified(days, quality.coverage_jumps(days), quality.overnight_jumps(daily_facts(bars), actions), quality.extremes(bars, 400.0, 4.0, 5.0, None), table(spark, d, "supplier"), gaps)


@register("a22_news_coverage", """select date_trunc('week', ts)::date as week, count(*)::bigint as rows, count(*) filter (event_type = 'signup')::bigint as positive, count(*) filter (event_type = 'view')::bigint as neutral, count(*) filter (event_type = 'error')::bigint as negative,
count(distinct user_id // 20)::bigint as names, count(distinct props)::bigint as publishers from events where event_type in ('signup', 'error', 'view') group by 1""")
def _(spark, d):
    s = F.col("sentiment_score")
    return news(table(spark, d, "events")).groupBy(F.to_date(F.date_trunc("week", "published_ts")).alias("week")).agg(
        F.count("*").alias("rows"), F.count_if(s > 0).alias("positive"), F.count_if(s == 0).alias("neutral"), F.count_if(s < 0).alias("negative"), F.countDistinct("instrument_id").alias("names"), F.countDistinct("publisher").alias("publishers")
    )


# --- generic relational operators on the star tables
@register("x_topk_parts", "select l_partkey, sum(l_quantity) as qty from lineitem group by 1 order by qty desc, l_partkey limit 20", "qty")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).orderBy(F.desc("qty"), "l_partkey").limit(20)


@register("x_topk_per_group", "select s_nationkey, s_suppkey, s_acctbal from supplier qualify row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) <= 3", "s_acctbal")
def _(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").withColumn("_k", F.row_number().over(w)).filter("_k <= 3").select("s_nationkey", "s_suppkey", "s_acctbal")


@register("x_union_except", "select k from (select c_custkey as k from customer intersect select o_custkey from orders) union all (select s_suppkey from supplier except select o_custkey from orders)")
def _(spark, d):
    c, o, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return c.intersect(o).union(s.subtract(o))


@register("x_grouping_sets", "select l_returnflag, l_linestatus, count(*)::bigint as n, sum(l_quantity) as qty from lineitem group by rollup (l_returnflag, l_linestatus)", "qty")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@register("s11_upsert", "with n as (select user_id as k, max(value) as v from events group by 1), o as (select c_custkey as k, c_acctbal as v from customer) select k, v from n union all select k, v from o where k not in (select k from n)", "v")
def _(spark, d):
    new = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("v"))
    return upsert(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), new, ["k"])


# --- news state and what follows from it
_NEWS = f"""nw as (select {DESK} as instrument_id, ts + interval 60 minute as available_at, event_id as article_id,
    case event_type when 'signup' then 1 when 'error' then -1 else 0 end as s from events where event_type in ('signup', 'error', 'view'))"""


def _state_rows(spark, d):
    rows = causal(spark, d).filter("rvol_5m >= 0.9 and ret_5m is not null").select("instrument_id", "session_date", "ts_utc", "decision_ts", "ret_5m", "resid_5m")
    n = news(table(spark, d, "events")).select("instrument_id", "available_at", "article_id", "sentiment_score")
    return asof_join(rows, n, ["instrument_id"], "decision_ts", "available_at", ["article_id", "sentiment_score"])


_STATE_COUNTS = [f"{c}_{k}" for k in ("2h", "4h", "today") for c in ("positive_count", "neutral_count", "negative_count", "single_ticker_news_count", "multi_ticker_news_count", "article_count", "publisher_count", "net_sentiment")]
_STATE = ["latest_article_id", "latest_news_sentiment", "latest_article_ticker_count", "minutes_since_latest_available_news", *_STATE_COUNTS, "same_direction_news_count", "sentiment_last_2h", "sentiment_last_4h", "sentiment_today"]


def _window_sql(name: str, hours: int, left: str) -> str:
    return f"""{name} as (select r.instrument_id, r.ts_utc, count(*) filter (s = 1) as positive_count_{name}, count(*) filter (s = 0) as neutral_count_{name}, count(*) filter (s = -1) as negative_count_{name}, count(*) filter (k = 1) as single_ticker_news_count_{name},
    count(*) filter (k > 1) as multi_ticker_news_count_{name}, count(distinct article_id) as article_count_{name}, count(distinct publisher) as publisher_count_{name}, sum(s) as net_sentiment_{name}
    from r join nx n on r.instrument_id = n.instrument_id and n.available_at {left} r.decision_ts - interval {hours} hour and n.available_at <= r.decision_ts group by all)"""


NEWS_STATE = f"""{CAUSAL}, nx as (select {DESK} as instrument_id, ts + interval 60 minute as available_at, event_id as article_id, props as publisher, (event_id % 3 + 1)::int as k, case event_type when 'signup' then 1 when 'error' then -1 else 0 end as s from events where event_type in ('signup', 'error', 'view')),
r as (select * from causal where rvol_5m >= 0.9 and ret_5m is not null), {_window_sql('w2h', 2, '>').replace('_w2h', '_2h')}, {_window_sql('w4h', 4, '>').replace('_w4h', '_4h')}, {_window_sql('wtd', 12, '>=').replace('_wtd', '_today')},
la as (select r.*, n.article_id as latest_article_id, n.s as latest_news_sentiment, n.k as latest_article_ticker_count, floor(epoch(r.decision_ts - n.available_at) / 60)::bigint as minutes_since_latest_available_news
    from r asof left join (select * from nx qualify row_number() over (partition by instrument_id, available_at order by article_id desc) = 1) n on r.instrument_id = n.instrument_id and r.decision_ts >= n.available_at),
ns0 as (select la.*, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in _STATE_COUNTS)} from la left join w2h using (instrument_id, ts_utc) left join w4h using (instrument_id, ts_utc) left join wtd using (instrument_id, ts_utc)),
ns as (select *, case latest_news_sentiment when 1 then positive_count_2h when -1 then negative_count_2h else neutral_count_2h end as same_direction_news_count, net_sentiment_2h as sentiment_last_2h, net_sentiment_4h as sentiment_last_4h, net_sentiment_today as sentiment_today from ns0)"""


def news_states(spark, d):
    rows = stored(causal(spark, d).filter("rvol_5m >= 0.9 and ret_5m is not null"), "rows")
    return with_news_state(rows, news(table(spark, d, "events")), ["instrument_id", "ts_utc"])


@register("e45_news_state", f"with {NEWS_STATE} select instrument_id, ts_utc, {', '.join(_STATE)} from ns")
def _(spark, d):
    return news_states(spark, d).select("instrument_id", "ts_utc", *_STATE)


_BUCKETED = f"""with {CAUSAL}, {_NEWS}, r as (select instrument_id, session_date, ts_utc, decision_ts, ret_5m, resid_5m from causal where rvol_5m >= 0.9 and ret_5m is not null),
j as (select r.*, n.s, n.available_at from r asof left join nw n on r.instrument_id = n.instrument_id and r.decision_ts >= n.available_at),
b as (select *, case when s is null or available_at < decision_ts - interval 240 minute then 'none' when s > 0 then 'pos' when s < 0 then 'neg' else 'neu' end as bucket from j)"""


def _bucketed(spark, d):
    fresh = F.col("available_at") >= F.col("decision_ts") - F.make_dt_interval(mins=F.lit(240))
    s = F.col("sentiment_score")
    return _state_rows(spark, d).withColumn("bucket", F.when(s.isNull() | ~fresh, "none").when(s > 0, "pos").when(s < 0, "neg").otherwise("neu"))


@register("e38_state_by_news", _BUCKETED + " select bucket, count(*)::bigint as n, avg(ret_5m) as mean_ret, count(*) filter (sign(ret_5m) = s)::bigint as agreeing from b group by bucket", "mean_ret")
def _(spark, d):
    return _bucketed(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ret_5m").alias("mean_ret"), F.count_if(F.signum("ret_5m") == F.col("sentiment_score")).alias("agreeing"))


@register("q11_news_onset", """with m as (select date_trunc('week', ts)::date as week, avg((event_type in ('signup', 'error', 'view'))::int::double) as rate, count(*) as n from events group by 1)
select week, rate from m where rate >= 0.4 and n >= 50 order by week limit 1""", "rate")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"))
    m = e.agg(F.avg(F.col("event_type").isin("signup", "error", "view").cast("double")).alias("rate"), F.count("*").alias("n"))
    return m.filter("rate >= 0.4 and n >= 50").orderBy("week").limit(1).select("week", "rate")


@register("a26_rate_by_calendar", """with m as (select date_trunc('month', o_orderdate)::date as month, avg((o_orderstatus = 'F')::int::double) as rate, count(*)::bigint as n from orders group by 1),
c as (select unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month))::date as month) select c.month, rate, coalesce(n, 0)::bigint as n from c left join m using (month)""", "rate")
def _(spark, d):
    m = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.count("*").alias("n"))
    c = m.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return c.join(m, "month", "left").select("month", "rate", F.coalesce("n", F.lit(0)).alias("n"))


@register("p15_binary_columns", "select 'l_linenumber' as column_name, min(l_linenumber) >= 0 and max(l_linenumber) <= 1 and count(distinct l_linenumber) <= 2 as is_binary from lineitem union all select 'l_discount_flag', min(f) >= 0 and max(f) <= 1 and count(distinct f) <= 2 from (select (l_discount > 0.05)::int as f from lineitem)")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("l_discount_flag"))
    ok = lambda c: (F.min(c) >= 0) & (F.max(c) <= 1) & (F.countDistinct(c) <= 2)
    row = t.agg(*[ok(c).alias(c) for c in t.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("is_binary")) for c in t.columns])).alias("x")).select("x.*")


@register("j17_effective_dated", """with v as (select o_custkey, o_orderkey as version, o_orderdate as effective_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as effective_to from orders),
q as (select l_orderkey, l_linenumber, o_custkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)
select q.l_orderkey, q.l_linenumber, v.version from q left join v on q.o_custkey = v.o_custkey and q.l_shipdate >= v.effective_from and (v.effective_to is null or q.l_shipdate < v.effective_to)""")
def _(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = o.select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("effective_from"), F.lead("o_orderdate").over(w).alias("effective_to"))
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return effective_join(q.drop("o_orderkey"), v, ["o_custkey"], "l_shipdate").select("l_orderkey", "l_linenumber", "version")
