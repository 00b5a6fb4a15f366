"""Registered queries: further event families, tables on rules and jobs, model jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions.core import stored
from eventide.operators import graph, grid, models, rules
from eventide.operators import statistics as st
from eventide.plans.bars_queries import _FWD, forwards
from eventide.plans.base import causal, register, session_bars
from eventide.plans.panel_queries import _BANK, _DAYM, _FIT, _M_F, _PANEL_F, _PEERS, _RIDGE, graph_of, panel, train_test

# --- tables on jobs and rules
@register("a15_signed_baseline", f"""with {_FWD}, r as (select *, strftime(session_date, '%Y-%m') as month from fwd where forward_return is not null)
select horizon, month, count(*)::bigint as n, avg(forward_return) as mean, stddev_samp(forward_return) as std, avg(abs(forward_return)) as abs_mean, quantile_cont(forward_return, 0.05) as q05, quantile_cont(forward_return, 0.5) as q50, quantile_cont(forward_return, 0.95) as q95,
avg((forward_return > 0)::int::double) as positive, avg((forward_return < 0)::int::double) as negative from r group by grouping sets ((horizon, month), (horizon))""", "mean std abs_mean q05 q50 q95 positive negative")
def _(spark, d):
    return rules.signed_baseline(forwards(spark, d), ["horizon"])


_SAMPLE = f"""{_DAYM}, sd as (select horizon, stddev_samp(m) / sqrt(count(*)) as day_se, count(*)::bigint as days from dm group by 1),
rs as (select horizon, count(*)::bigint as n, avg(forward_return) as mean, quantile_cont(forward_return, 0.5) as median, avg((forward_return > 0)::int::double) as win_rate, count(distinct instrument_id)::bigint as names,
    count(distinct (instrument_id, session_date))::bigint as name_days from fwd where forward_return is not null group by 1),
tn as (select horizon, max(c) / sum(c) as top_name_share from (select horizon, instrument_id, count(*) as c from fwd where forward_return is not null group by all) group by 1)"""


@register("a18_rule_sample", f"with {_SAMPLE} select rs.*, day_se, days, top_name_share from rs join sd using (horizon) join tn using (horizon)", "mean median win_rate day_se top_name_share")
def _(spark, d):
    return rules.rule_sample(forwards(spark, d), ["horizon"])


@register("a24_histogram", f"with {_FWD} select horizon, least(39, greatest(0, floor((forward_return + 1) / 0.1)))::int as bin, count(*)::bigint as n from fwd where forward_return is not null group by all")
def _(spark, d):
    return rules.histogram(forwards(spark, d), ["horizon"], 0.1, -1.0, 3.0)


@register("t16_neighbour_cuts", f"""with {_BANK}, sc as (select feature, cut, avg(case when x > cut then y end) as m from lg join (select distinct feature, cut from bk) using (feature) group by 1, 2 having count(*) filter (x <= cut) >= 5 and count(*) filter (x > cut) >= 5),
nb as (select *, lag(m) over w as a, lead(m) over w as b from sc window w as (partition by feature order by cut))
select feature, cut, m as right_mean, (a is null or (sign(a) = sign(m) and abs(a) >= 0.5 * abs(m))) and (b is null or (sign(b) = sign(m) and abs(b) >= 0.5 * abs(m))) as robust from nb""", "cut right_mean")
def _(spark, d):
    p = panel(spark, d)
    bank = st.quantile_bank(p, _PANEL_F).select("feature", "cut").distinct()
    return rules.neighbour_cuts(st.split_scores(p, bank, _PANEL_F, "y"))


@register("t17_feature_stability", f"""with {_BANK}, ds as (select session_date, feature, cut, sum(y) filter (x <= cut) as ls, count(*) filter (x <= cut) as ln, sum(y) filter (x > cut) as rs, count(*) filter (x > cut) as rn from lg join (select distinct feature, cut from bk) using (feature) group by all),
fd as (select *, md5(fold::varchar || ':' || session_date::varchar)[1] as h from ds, generate_series(0, 39) as t(fold)),
g as (select fold, feature, cut, sum(rs) / sum(rn) - sum(ls) / sum(ln) as gap from fd where h < '8' group by all having sum(ln) >= 5 and sum(rn) >= 5),
top as (select * from g qualify row_number() over (partition by fold order by round(abs(gap), 9) desc, feature, cut) = 1)
select feature, count(*)::bigint as chosen, count(*) / 40.0::double as share, avg((gap > 0)::int::double) as upward from top group by 1""", "share upward")
def _(spark, d):
    p = panel(spark, d)
    bank = st.quantile_bank(p, _PANEL_F).select("feature", "cut").distinct()
    return rules.stability(rules.day_sums(p, bank, _PANEL_F, "y"), 40)


def _minutes():
    return F.element_at(F.create_map(*[F.lit(x) for x in ("1h", 60.0, "3h", 180.0, "6h", 360.0)]), F.col("horizon"))


_FLOOR_SQL = "0.0012 * sqrt(case horizon when '1h' then 60 when '3h' then 180 else 360 end / 15.0)"


@register("t19_split_verdict", f"""with {_FWD}, dd as (select distinct session_date from ses), i as (select *, row_number() over (order by session_date) - 5 as i, count(*) over () - 5 as n from dd),
sp as (select session_date, case when i / n <= 0.4 then 'D1' when i / n <= 0.4 + 0.2 then 'D2' else 'D3' end as split from i where i > 0),
s as (select horizon, split, count(*)::bigint as n, avg(forward_return) as mean from fwd join sp using (session_date) where forward_return is not null group by all),
w as (select horizon, max(n) filter (split = 'D1') as n_d1, max(mean) filter (split = 'D1') as mean_d1, max(n) filter (split = 'D2') as n_d2, max(mean) filter (split = 'D2') as mean_d2, max(n) filter (split = 'D3') as n_d3, max(mean) filter (split = 'D3') as mean_d3 from s group by 1)
select *, case when not coalesce(n_d2 >= 10 and sign(mean_d2) = sign(mean_d1) and abs(mean_d2) >= {_FLOOR_SQL} / 4, false) then 'D2_FAILED'
    when not coalesce(sign(mean_d3) = sign(mean_d1) and abs(mean_d3) >= {_FLOOR_SQL}, false) then 'D3_FAILED' else 'HELD' end as verdict from w""", "mean_d1 mean_d2 mean_d3")
def _(spark, d):
    days = st.chronological_split(session_bars(spark, d).select("session_date").distinct(), "session_date", 5)
    r = forwards(spark, d).filter("forward_return is not null").join(days, "session_date")
    return rules.split_verdict(r.groupBy("horizon", "split").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean")), ["horizon"], rules.floor_of(_minutes()), 10)


@register("t21_directional_gate", f"""with {_SAMPLE}, k as (select *, row_number() over (partition by horizon order by m desc, session_date) as k from dm),
ag as (select horizon, avg((m > 0)::int::double) as positive_days, sum(case when k > 1 then s end) / nullif(sum(case when k > 1 then c end), 0) as rest from k group by 1),
g as (select horizon, n, case when name_days < 30 or days < 5 then 'sample' when top_name_share > 0.5 then 'concentration' when mean < 0 then 'sign' when abs(mean) < {_FLOOR_SQL} then 'size' when win_rate < 0.3 then 'win_rate' when median < 0 then 'median' when positive_days < 0.5 then 'days' end as reason from rs join sd using (horizon) join tn using (horizon) join ag using (horizon))
select *, case when reason is null then 'PASS' else 'KILL' end as decision from g""")
def _(spark, d):
    r = forwards(spark, d)
    out = rules.directional_gate(rules.rule_sample(r, ["horizon"]), st.day_agreement(r, ["horizon"]), ["horizon"], rules.floor_of(_minutes()), 30, 5, 0.5, 0.3, 0.5)
    return out.select("horizon", "n", "reason", "decision")


@register("k13_mechanism", f"""with {_PEERS}, m0 as (select trading_date, r, round(leader_shock, 9) as leader_shock, round(leader_shock - r, 9) as response_gap, round(peer_rank - own_rank, 9) as peer_rank_gap, lead(r) over (partition by instrument_id, trading_date order by minute_of_day) as y from pr),
lg as (select trading_date, y, f.feature as feature, f.x as x from (select trading_date, y, unnest([{{'feature': 'leader_shock', 'x': leader_shock}}, {{'feature': 'response_gap', 'x': response_gap}}, {{'feature': 'peer_rank_gap', 'x': peer_rank_gap}}]) as f from m0 where y is not null) where f.x is not null),
rk as (select trading_date, feature, rank() over (partition by trading_date, feature order by x) + (count(*) over (partition by trading_date, feature, x) - 1) / 2.0 as rx, rank() over (partition by trading_date, feature order by y) + (count(*) over (partition by trading_date, feature, y) - 1) / 2.0 as ry from lg),
pd as (select trading_date, feature, corr(rx, ry) as rho from rk group by all having count(*) >= 10 and corr(rx, ry) is not null and not isnan(corr(rx, ry)))
select feature, count(*)::bigint as days, avg(rho) as mean_rho, avg(rho) * sqrt(count(*)) / nullif(stddev_samp(rho), 0) as t_stat from pd group by 1""", "mean_rho t_stat")
def _(spark, d):
    g = stored(grid.grid_of(causal(spark, d)), "grid")
    p = graph.peer_features(g, graph_of(spark, d, g)[3], "r")
    # names with one leader have equal shocks but for the last bits, which would break ties by chance
    p = p.select("instrument_id", "trading_date", "minute_of_day", "r", *[F.round(c, 9).alias(c) for c in ("leader_shock", "response_gap", "peer_rank_gap")])
    p = p.withColumn("y", F.lead("r").over(Window.partitionBy("instrument_id", "trading_date").orderBy("minute_of_day")))
    return st.day_association(p, ["leader_shock", "response_gap", "peer_rank_gap"], "y", "trading_date")


# --- model jobs: fitted on the first 60 % of days, scored on the rest
_Z = [f"z_{f}" for f in _PANEL_F]
_MZ = [f"z_{f}" for f in _M_F]
_KEYS = ["instrument_id", "ts_utc"]


@register("m3_logistic")
def _(spark, d):
    """Probability of a rise in the next bar."""
    train, test = train_test(spark, d, _PANEL_F)
    return models.logistic(train, test, _Z, F.col("y") > 0).select(*_KEYS, "score")


@register("m4_stump_boosting")
def _(spark, d):
    """Boosted trees of one split on the next bar's return."""
    train, test = train_test(spark, d, _PANEL_F)
    return models.stumps(train, test, _Z, "y").select(*_KEYS, "score")


@register("m7_coverage_check", f"""with {_FIT}, sc as (select instrument_id, ts_utc, y, {_RIDGE(10)} as s from mz, mg where not train and y is not null),
rk as (select *, row_number() over (order by abs(s) desc, instrument_id, ts_utc) as k, count(*) over () as n from sc), cv as (select * from (values (0.05), (0.25), (1.0)) t(coverage))
select coverage::double as coverage, count(*)::bigint as n, avg(sign(s) * y) as mean, avg((sign(s) * y > 0)::int::double) as win_rate from rk, cv where k <= floor((n - 1) * coverage::double) + 1 group by 1""", "mean win_rate")
def _(spark, d):
    """Signed mean return of ridge scores at growing coverage; certain rows should do no worse."""
    train, test = train_test(spark, d, _M_F)
    scored = test.select(*_KEYS, "y", models.score(_MZ, models.ridge(train, _MZ, "y", 10.0)).alias("score")).filter("y is not null")
    return models.by_coverage(scored, "score", "y", (0.05, 0.25, 1.0), _KEYS)


@register("m8_ridge_path", f"""with {_FIT}, sc as (select y, p.penalty, case p.penalty when 0.1 then {_RIDGE(0.1)} when 10 then {_RIDGE(10)} else {_RIDGE(1000)} end as s from mz, mg, (select unnest([0.1, 10.0, 1000.0]::double[]) as penalty) p where not train and y is not null),
ct as (select *, quantile_cont(s, 0.1) over (partition by penalty) as lo, quantile_cont(s, 0.9) over (partition by penalty) as hi from sc)
select penalty, avg((s - y) * (s - y)) as error, avg(case when s >= hi then y end) - avg(case when s <= lo then y end) as spread, count(*)::bigint as n from ct group by 1""", "error spread")
def _(spark, d):
    """Each penalty's squared error on later days and the spread of returns between its top and bottom tenth of scores."""
    train, test = train_test(spark, d, _M_F)
    return models.ridge_path(train, test, _MZ, "y", (0.1, 10.0, 1000.0), _KEYS)
