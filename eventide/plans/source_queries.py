"""Queries over sources, stores and streams: the given tables are landed in the form a source reads, and read by it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions.core import shared_dir, stored
from eventide.operators import daybuild, graph, grid, jobs, models, quality
from eventide.operators import statistics as st
from eventide.operators.features import carried, daily_facts
from eventide.plans.base import BARS, DAILY, DESK, ORACLES, QUERIES, causal, register, session_bars, t_p_sql
from eventide.plans.job_queries import BATCH, _job_returns, _returns_sql
from eventide.plans.panel_queries import _DRAW, _LONG, _PANEL_F, _PEERS, graph_of, panel
from eventide.sources import bars as src
from eventide.sources import stores
from eventide.sources.bars import bars_from_ticks, table
from eventide.streaming import bars as stream


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bars(spark, d):
    return bars_from_ticks(table(spark, d, "events"))


# --- landed files
def _landed_csv(spark, d, path):
    """Bars as gzip CSV files by day, headers in mixed case, epochs in ns, us, ms or s by the hour."""
    b = _bars(spark, d)
    seconds = F.unix_seconds(F.col("ts_utc").cast("timestamp"))
    scale = F.element_at(F.array(*[F.lit(k).cast("long") for k in (10**9, 10**6, 10**3, 1)]), F.hour("ts_utc") % 4 + 1)
    rows = b.select(F.to_date("ts_utc").alias("day"), F.col("instrument_id").alias("Ticker"), F.col("volume").alias("Volume"), F.col("open").alias("Open"), F.col("close").alias("Close"), F.col("high").alias("High"), F.col("low").alias("Low"), (seconds * scale).alias("Window_Start"), F.col("transactions").alias("Transactions"))
    rows.repartition("day").write.option("header", True).option("compression", "gzip").partitionBy("day").csv(path)


@register("s6_landed_csv", f"with {BARS} select 'ticker:' || instrument_id as instrument_id, ts_utc, open, high, low, close, volume, transactions, 'flatfile' as source from bars", "open high low close volume")
def _(spark, d):
    """Gzip CSV files with epochs of four units, read as bars."""
    path = _folder(spark, "landed")
    _landed_csv(spark, d, path)
    return src.read_bar_csv(spark, f"{path}/day=*").select("instrument_id", "ts_utc", "open", "high", "low", "close", "volume", "transactions", "source")


@register("s7_resumed_conversion", f"with {BARS} select ts_utc::date as date, count(*)::bigint as rows, sum(volume)::double as volume, 0 as read_again from bars group by 1", "volume")
def _(spark, d):
    """Landed files converted to a store by day, twice: the second run reads no file."""
    path, store, manifest = _folder(spark, "landed"), _folder(spark, "store"), _folder(spark, "manifest")
    _landed_csv(spark, d, path)
    stores.convert_landed(spark, f"{path}/day=*/*.gz", store, manifest)
    again = stores.convert_landed(spark, f"{path}/day=*/*.gz", store, manifest)
    return spark.read.parquet(store).groupBy("date").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"), F.lit(again).alias("read_again"))


@register("s8_api_aggregates", """with b as (select time_bucket(interval 1 hour, ts)::timestamp as ts_utc, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close, count(*)::double as volume, avg(value) as vwap, count(*)::bigint as transactions from events group by 1)
select 'ticker:ALL' as instrument_id, ts_utc, open, high, low, close, volume, vwap, transactions from b""", "open high low close volume vwap")
def _(spark, d):
    """Hourly aggregates of all ticks as JSON lines in milliseconds, each with a shorter earlier version of itself, read as bars."""
    hour, path = F.date_trunc("hour", "ts"), _folder(spark, "aggregates")
    at = F.unix_millis(hour.cast("timestamp"))
    ordered = lambda f: f("value", "event_id")
    a = table(spark, d, "events").groupBy(at.alias("t")).agg(ordered(F.min_by).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), ordered(F.max_by).alias("c"), F.count("*").cast("double").alias("v"), F.avg("value").alias("vw"), F.count("*").alias("n"))
    a = stored(a, "hours")
    a.union(a.withColumn("v", F.col("v") - 1).withColumn("n", F.col("n") - 1)).write.json(path)
    return src.read_aggregates_json(spark, path, "ALL")


_TICKERS = """tk as (select s_name as ticker, case s_suppkey % 5 when 0 then 'ETF' when 1 then 'CS' when 2 then 'ADRC' when 3 then null else '' end as type, case s_suppkey % 4 when 0 then 'xnas' when 1 then 'XNYS' when 2 then 'AMEX' else 'OTC' end as ex,
    case when s_suppkey % 3 = 0 then 'F' || s_suppkey end as figi, case when s_suppkey % 2 = 0 then s_nationkey::varchar else '' end as cik, case s_suppkey % 7 when 0 then null when 1 then false else true end as active from supplier),
li as (select coalesce('figi:' || figi, 'cik:' || nullif(cik, ''), 'ticker:' || ticker) as instrument_id, ticker, case ex when 'xnas' then 'NASDAQ' when 'XNYS' then 'NYSE' else 'NYSE_AMERICAN' end as exchange,
    case when coalesce(type, '') in ('', 'CS') then 'COMMON_STOCK' else type end as security_type, nullif(cik, '') as cik, coalesce(active, true) as active from tk where coalesce(type, '') <> 'ETF' and ex <> 'OTC')"""


def _listed(spark, d):
    """Suppliers as API tickers, landed as JSON lines."""
    k, path = F.col("s_suppkey"), _folder(spark, "tickers")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    raw = table(spark, d, "supplier").select(
        F.col("s_name").alias("ticker"), pick(5, "ETF", "CS", "ADRC", None, "").alias("type"), pick(4, "xnas", "XNYS", "AMEX", "OTC").alias("primary_exchange"),
        F.when(k % 3 == 0, F.concat(F.lit("F"), k)).alias("composite_figi"), F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("").alias("cik"), F.when(k % 7 == 1, False).when(k % 7 != 0, True).alias("active"),
    )
    raw.write.json(path)
    kinds = "ticker string, type string, primary_exchange string, composite_figi string, cik string, active boolean, list_date string, delisted_utc string"
    return src.instruments_from_json(spark.read.schema(kinds).json(path))


@register("s9_listed_tickers", f"with {_TICKERS} select * from li")
def _(spark, d):
    return _listed(spark, d).select("instrument_id", "ticker", "exchange", "security_type", "cik", "active")


@register("q8_identity_counts", f"""with {_TICKERS} select 'active' as aspect, active::varchar as value, count(*)::bigint as n, count(*) filter (instrument_id like 'figi:%')::bigint as with_figi from li group by 2
union all select 'exchange', exchange, count(*)::bigint, count(*) filter (instrument_id like 'figi:%')::bigint from li group by 2""")
def _(spark, d):
    return quality.identity_counts(_listed(spark, d))


@register("s10_splits", """with s as (select o_custkey, o_orderdate::date as day, o_orderkey % 4 as b, o_orderkey % 3 as f, o_orderkey % 5 as k from orders)
select 'ticker:' || o_custkey as instrument_id, 'split' as type, day as effective_date, b / nullif(f, 0)::double as ratio from s where k < 4 and f <> 0""", "ratio")
def _(spark, d):
    """Orders as API splits in JSON: one in five has no date, others have it under one of two names."""
    k, path, day = F.col("o_orderkey"), _folder(spark, "splits"), F.to_date("o_orderdate").cast("string")
    raw = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.when(k % 5 < 2, day).alias("execution_date"), F.when((k % 5 == 2) | (k % 5 == 3), day).alias("ex_date"), (k % 4).alias("split_to"), (k % 3).alias("split_from"))
    raw.write.json(path)
    return src.splits_from_json(spark.read.schema("ticker string, execution_date string, ex_date string, split_to long, split_from long").json(path))


@register("s14_flattened_news", f"""with a as (select event_id // 3 as k, {DESK} as ticker, event_id, ts, event_type from events), n as (select k, count(*)::int as article_ticker_count, min(ts) as published_ts from a group by 1)
select k::varchar as article_id, ticker, published_ts, article_ticker_count, case event_type when 'signup' then 1 when 'error' then -1 else 0 end as sentiment_score from a join n using (k) where event_type in ('signup', 'error', 'view')""")
def _(spark, d):
    """Three ticks an article, landed as JSON with nested insights; publication times are naive, in UTC or two hours ahead."""
    path, k = _folder(spark, "articles"), F.floor(F.col("event_id") / 3)
    label = F.create_map(*[F.lit(x) for x in ("signup", "Positive", "error", "negative", "view", "neutral")])[F.col("event_type")]
    one = F.struct(F.col("event_id"), src.instrument_of().alias("ticker"), F.coalesce(label, F.lit("other")).alias("sentiment"))
    a = table(spark, d, "events").groupBy(k.alias("k")).agg(F.min("ts").alias("ts"), F.sort_array(F.collect_list(one)).alias("i"))
    said = lambda shift, zone: F.concat(F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(shift)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))
    published = F.when(F.col("k") % 3 == 0, said(0, "")).when(F.col("k") % 3 == 1, said(0, "Z")).otherwise(said(2, "+02:00"))
    insights = F.transform("i", lambda s: F.struct(s["ticker"].alias("ticker"), s["sentiment"].alias("sentiment")))
    a.select(F.col("k").cast("string").alias("article_id"), published.alias("published_utc"), F.lit("wire").alias("publisher"), F.transform("i", lambda s: s["ticker"]).alias("tickers"), F.array(F.lit("a")).alias("keywords"), insights.alias("insights")).write.json(path)
    kinds = "article_id string, published_utc string, publisher string, tickers array<string>, keywords array<string>, insights array<struct<ticker:string,sentiment:string>>"
    return src.flatten_news(spark.read.schema(kinds).json(path)).select("article_id", "ticker", "published_ts", "article_ticker_count", "sentiment_score")


_FILES = """r as (select o_custkey as file, o_orderstatus as s, floor(o_totalprice)::bigint as bytes, o_orderkey % 1000 as rows, o_orderdate + to_microseconds(o_orderkey) as seen from orders),
l as (select * from r qualify row_number() over (partition by file order by seen desc) = 1)"""


@register("a25_ingest_progress", f"""with {_FILES}, s as (select (select count(*) from customer)::bigint as expected, count(*) filter (s <> 'O')::bigint as downloaded, count(*) filter (s = 'F')::bigint as converted, count(*) filter (s = 'O')::bigint as failed, coalesce(sum(bytes) filter (s <> 'O'), 0)::bigint as bytes, coalesce(sum(rows) filter (s = 'F'), 0)::bigint as rows,
    (epoch_us(max(seen) filter (s <> 'O')) - epoch_us(min(seen) filter (s <> 'O'))) / 1e6 as elapsed from l)
select * exclude (elapsed), downloaded / nullif(elapsed, 0) as files_per_second, greatest(0, expected - downloaded) / nullif(downloaded / nullif(elapsed, 0), 0) as seconds_left from s""", "files_per_second seconds_left")
def _(spark, d):
    """Orders as lines of a manifest, customers as files; the last line of a file counts."""
    path = _folder(spark, "manifest")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    s = F.col("o_orderstatus")
    lines = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("file"), F.when(s == "F", "downloaded").when(s == "O", "failed").otherwise("skipped_verified").alias("status"), F.when(s == "F", "ok").alias("conversion"),
        F.floor("o_totalprice").cast("long").alias("bytes"), (F.col("o_orderkey") % 1000).alias("rows"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
    )
    lines.write.json(path)
    return stores.ingest_progress(spark, path, table(spark, d, "customer").count())


# --- stores of mixed schemas, overlays, literals
def _mixed(spark, d):
    """Bars below one folder at two depths: those of even days as they are, those of odd days without transactions and with a vwap."""
    path, b = _folder(spark, "mixed"), _bars(spark, d)
    even = F.dayofmonth("ts_utc") % 2 == 0
    b.filter(even).write.parquet(f"{path}/a")
    b.filter(~even).drop("transactions").withColumn("vwap", (F.col("high") + F.col("low")) / 2).write.parquet(f"{path}/b/deeper")
    return path


@register("s1_mixed_schemas", f"with {BARS} select instrument_id, ts_utc, close, case when day(ts_utc) % 2 = 0 then transactions end as transactions, case when day(ts_utc) % 2 = 1 then (high + low) / 2 end as vwap from bars", "close vwap")
def _(spark, d):
    return stores.scan_bars(spark, _mixed(spark, d)).select("instrument_id", "ts_utc", "close", "transactions", "vwap")


@register("q12_column_drift", f"with {BARS} select ts_utc::date as day, count(*)::bigint as rows, case when day(ts_utc::date) % 2 = day((select min(ts_utc) from bars)::date) % 2 then '' when day(ts_utc::date) % 2 = 0 then 'transactions' else 'vwap' end as added, case when day(ts_utc::date) % 2 = day((select min(ts_utc) from bars)::date) % 2 then '' when day(ts_utc::date) % 2 = 0 then 'vwap' else 'transactions' end as missing from bars group by all")
def _(spark, d):
    """Columns that come and go between the days of a store, against its first day."""
    return quality.column_drift(stores.scan_bars(spark, _mixed(spark, d)).withColumn("day", F.to_date("ts_utc")), "day")


@register("s3_resolved_dataset", f"with {BARS} select 'pilot' as found, count(*)::bigint as rows, count(distinct instrument_id)::bigint as names from bars")
def _(spark, d):
    """The best of an alias's candidates that is there: a pilot, as no full panel is."""
    root = _folder(spark, "root")
    for name in ("pilot", "smoke"):
        _bars(spark, d).write.parquet(f"{root}/{name}")
    found, df = stores.resolved(spark, root, "panel")
    return df.agg(F.lit(found).alias("found"), F.count("*").alias("rows"), F.countDistinct("instrument_id").alias("names"))


@register("s4_pruned_days", f"with {BARS} select instrument_id, ts_utc, close from bars where ts_utc::date in (select distinct ts_utc::date as d from bars order by d desc limit 5)", "close")
def _(spark, d):
    """The last five days and three columns of a store by day."""
    path = _folder(spark, "store")
    src.write_bars(_bars(spark, d), path)
    days = spark.read.parquet(path).select("date").distinct().orderBy(F.desc("date")).limit(5).collect()
    return src.read_days(spark, path, [str(r.date) for r in days], ["instrument_id", "ts_utc", "close"])


@register("s5_panel_overlay", f"with {DAILY} select s.instrument_id, s.session_date as trading_date, s.minute_of_day, close, c.prev_close, case when s.is_rth then volume * 2 end as twice from ses s left join carried c using (instrument_id, session_date)", "close prev_close twice")
def _(spark, d):
    """A panel by day with an overlay of its own files, joined on instrument, day and clock."""
    path, over = _folder(spark, "panel"), _folder(spark, "overlay")
    f = session_bars(spark, d)
    stores.write_partitioned(f.select("instrument_id", F.col("session_date").alias("trading_date"), "minute_of_day", "close"), path, ["trading_date"])
    known = carried(daily_facts(f)).select("instrument_id", "session_date", "prev_close")
    more = f.join(known, ["instrument_id", "session_date"], "left").select("instrument_id", F.col("session_date").alias("trading_date"), "minute_of_day", "prev_close", F.when(F.col("is_rth"), F.col("volume") * 2).alias("twice"))
    stores.write_partitioned(more, over, ["trading_date"])
    days = [str(r.trading_date) for r in spark.read.parquet(path).select("trading_date").distinct().collect()]
    return stores.load_panel(spark, path, over, days, ["instrument_id", "trading_date", "minute_of_day", "close", "prev_close", "twice"])


@register("p14_frozen_columns", f"with {BARS} select instrument_id, ts_utc, close, null::double as peer_rank, 0::double as missing_rate from bars", "close missing_rate")
def _(spark, d):
    """Columns that a consumer expects, in its order, what isn't there as literals."""
    b = daybuild.filled(_bars(spark, d), {"close": None, "peer_rank": None, "missing_rate": 0.0})
    return daybuild.projected(b, ["instrument_id", "ts_utc", "close", "peer_rank", "missing_rate"])


# --- streams
@register("stream_finished_bars", f"with {BARS} select instrument_id, ts_utc, open, high, low, close, transactions from bars where ts_utc + interval 15 minute <= (select max(ts) from events) - interval 2 hour", "open high low close")
def _(spark, d):
    """Bars of a stream that the watermark has closed; every tick lands twice and counts once."""
    landed, out = _folder(spark, "ticks"), _folder(spark, "bars")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for _again in range(2):
        e.write.mode("append").parquet(landed)
    bars = stream.streaming_bars(stream.tick_stream(spark, landed, 1_000_000))
    stream.run_available(bars.withColumn("ts_utc", F.col("ts_utc").cast("timestamp_ntz")), out, _folder(spark, "offsets"))
    return spark.read.parquet(out)


@register("stream_carried_days", f"""with {BARS}, dy as (select instrument_id, session_date, arg_max(close, ts_utc) as rth_close, sum(volume) as volume from ses where is_rth group by all)
select instrument_id, session_date, rth_close, lag(rth_close) over i as prev_close, quantile_cont(volume, 0.5) over (i rows between 20 preceding and 1 preceding) as typ_volume from dy window i as (partition by instrument_id order by session_date)""", "rth_close prev_close typ_volume")
def _(spark, d):
    """Finished days as a stream with state an instrument; the second half of the days lands after a first run has ended."""
    landed, out, offsets = _folder(spark, "days"), _folder(spark, "carried"), _folder(spark, "offsets")
    days = session_bars(spark, d).filter("is_rth").groupBy("instrument_id", "session_date").agg(F.max_by("close", "ts_utc").alias("rth_close"), F.sum("volume").alias("volume"))
    days = stored(days, "finished")
    middle = days.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).select(F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")).alias("m"))
    for late in (False, True):
        days.crossJoin(F.broadcast(middle)).filter((F.col("session_date") > F.col("m")) == late).drop("m").write.mode("append").parquet(landed)
        stream.run_available(stream.carried_days(spark.readStream.schema(days.schema).parquet(landed)), out, offsets)
    return spark.read.parquet(out)


# --- associations over rows, news onset, extremes, bootstrap of the primary horizon
def _spearman_sql(rel: str) -> str:
    """Relations rr (ranks) and aa (a row a feature) over rel(day, feature, x, y)."""
    rank = lambda c: f"rank() over (partition by feature order by {c}) + (count(*) over (partition by feature, {c}) - 1) / 2.0"
    return f"""rr as (select *, {rank('x')} as rx, {rank('y')} as ry from {rel}),
a0 as (select feature, count(*)::bigint as n, count(distinct day)::bigint as days, count(distinct x)::bigint as "distinct", case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as rho from rr group by 1),
a1 as (select *, rho * sqrt(n - 2) / nullif(sqrt(1 - rho * rho), 0) as t_stat from a0),
aa as (select *, case when n < 30 or days < 8 or rho is null then 1.0 when abs(rho) >= 1 then 0.0 else {t_p_sql('t_stat', '(n - 2)')} end as p from a1)"""


@register("t6_row_association", f"with {_LONG}, {_spearman_sql('(select session_date as day, feature, x, y from lg)')} select * from aa", "rho t_stat p")
def _(spark, d):
    """Rank correlation over all rows, with its p."""
    return st.row_association(panel(spark, d), _PANEL_F, "y")


_GAPS = ("leader_shock", "response_gap", "peer_rank_gap", "state_gap")


@register("k13_row_tests", f"""with {_PEERS}, m0 as (select trading_date, round(leader_shock, 9) as leader_shock, round(leader_shock - r, 9) as response_gap, round(peer_rank - own_rank, 9) as peer_rank_gap, round(leader_shock - r, 9) * (rvol_5m >= 1.1 and abs(r) <= 0.25)::int as state_gap, lead(r) over (partition by instrument_id, trading_date order by minute_of_day) as y from pr),
lg as (select trading_date as day, y, f.feature as feature, f.x as x from (select trading_date, y, unnest([{', '.join(f"{{'feature': '{c}', 'x': {c}}}" for c in _GAPS)}]) as f from m0 where y is not null) where f.x is not null), {_spearman_sql('lg')},
ev as (select unnest([{', '.join(f"'{c}'" for c in _GAPS)}]) as feature, (select count(*) from m0) as size), ok as (select ev.feature, coalesce(n, 0)::bigint as n, coalesce("distinct", 0)::bigint as "distinct", rho, p, size >= 200 and coalesce(n, 0) >= 30 and coalesce("distinct", 0) > 1 as ok from ev left join aa using (feature))
select feature, n, "distinct", case when ok then rho end as rho, case when ok then p end as p, case when ok then 'SIGNAL_ONLY' else 'NOT_EVALUATED' end as status from ok""", "rho p")
def _(spark, d):
    """The four mechanisms of the peer graph against the next step: shock, gap, gap of ranks, and the gap in quiet shocks."""
    g = stored(grid.grid_of(causal(spark, d)), "grid")
    p = graph.peer_features(g, graph_of(spark, d, g)[3], "r")
    p = p.select("instrument_id", "trading_date", "minute_of_day", "r", "rvol_5m", *[F.round(c, 9).alias(c) for c in ("leader_shock", "response_gap", "peer_rank_gap")])
    quiet = ((F.col("rvol_5m") >= 1.1) & (F.abs("r") <= 0.25)).cast("double")
    p = p.withColumn("state_gap", F.col("response_gap") * quiet).withColumn("y", F.lead("r").over(Window.partitionBy("instrument_id", "trading_date").orderBy("minute_of_day")))
    return st.mechanism_tests(stored(p, "panel"), list(_GAPS), "y", "trading_date")


@register("q11_onset_level", """with m as (select date_trunc('week', ts)::date as week, avg((event_type in ('signup', 'error', 'view'))::int::double) as rate, count(*)::bigint as n from events group by 1),
u as (select *, case when rate >= 0.8 then 'reliable' else 'usable' end as level from m where n >= 50 and rate >= 0.5) select week, rate, n, level from u order by level, week limit 1""", "rate")
def _(spark, d):
    """The first week with reliable news, else with usable ones."""
    e = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"))
    return quality.news_onset(e.agg(F.avg(F.col("event_type").isin("signup", "error", "view").cast("double")).alias("rate"), F.count("*").alias("n")), "week")


@register("q5_low_prices", f"""with {BARS}, s as (select *, abs(close / nullif(lag(close) over (partition by instrument_id, session_date order by ts_utc), 0) - 1) as move from ses),
k as (select 'price' as kind, instrument_id, ts_utc, high as value, high as size from s where high >= 200 union all select 'volume', instrument_id, ts_utc, volume, volume from s where volume >= 5 union all select 'move', instrument_id, ts_utc, move, move from s where move >= 20 union all select 'low', instrument_id, ts_utc, close, -close from s where close > 0 and close <= 0.5)
select kind, instrument_id, ts_utc, value from k qualify row_number() over (partition by kind order by size desc, instrument_id, ts_utc) <= 20""", "value")
def _(spark, d):
    return quality.extremes(session_bars(spark, d), 200.0, 5.0, 20.0, 20, 0.5)


def _boot_sql(x: str) -> str:
    return f"""with {_returns_sql(BATCH)}, pr0 as (select job_id, session_date, {x} as x from jr where horizon = '3h'), dm as (select job_id, session_date, sum(x) as s, count(*) as c from pr0 group by all),
i as (select *, row_number() over (partition by job_id order by session_date) - 1 as i, count(*) over (partition by job_id) as n from dm),
dr as (select job_id, rep, {_DRAW} as i from (select job_id, i as slot, n, unnest(generate_series(0, 99)) as rep from i)),
m as (select job_id, rep, sum(s) / sum(c) as m from dr join i using (job_id, i) group by all),
b as (select job_id, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high, least(1.0, 2 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))) as p_boot from m group by 1)
select job_id, n, mean, positive_days, ci_low, ci_high, p_boot from (select job_id, count(*)::bigint as n, avg(x) as mean from pr0 group by 1) join (select job_id, avg((s / c > 0)::int::double) as positive_days from dm group by 1) using (job_id) join b using (job_id)"""


@register("a12_primary_bootstrap", _boot_sql("forward_return"), "mean positive_days ci_low ci_high p_boot")
def _(spark, d):
    return jobs.primary_bootstrap(_job_returns(spark, d, BATCH), "3h", 100)


@register("a12_primary_sizes", _boot_sql("abs(forward_return)"), "mean positive_days ci_low ci_high p_boot")
def _(spark, d):
    """As a12_primary_bootstrap, of the sizes of returns."""
    return jobs.primary_bootstrap(_job_returns(spark, d, BATCH), "3h", 100, absolute=True)


# --- checks of what was joined and of what was modelled
@register("k12_overlay_days", f"""with {_PEERS}, o as (select trading_date, count(*)::bigint as rows, count(*) filter (leader_count > 0)::bigint as available, (count(*) - count(distinct (instrument_id, minute_of_day)))::bigint as repeated,
    count(leader_shock - r + r) filter (leader_count > 0) as gaps, count(*) filter (leader_count > 0 and abs(leader_shock - r + r) < 1e-12) as same, count(distinct leader_shock) filter (leader_count > 0) as shocks from pr group by 1)
select trading_date, rows, available, repeated, available > 50 and 2 * same > gaps as aliased, available > 50 and shocks <= 1 as constant from o""")
def _(spark, d):
    """Whether the graph's features of a day say more than the day's own returns."""
    g = stored(grid.grid_of(causal(spark, d)), "grid")
    return graph.overlay_days(graph.peer_features(g, graph_of(spark, d, g)[3], "r"), "r")


@register("m7_verdict", f"""with cc as ({ORACLES["m7_coverage_check"]}), rs as (select *, case when n < 100 then 'sample' when mean < 0 then 'sign' when mean < 0.001 then 'size' end as reason from cc),
ed as (select min(coverage) as sure, arg_min(coalesce(reason, ''), coverage) as a, arg_max(coalesce(reason, ''), coverage) as b, arg_max(mean, coverage) as whole from rs),
v as (select coverage, n, mean, win_rate, case when a = '' and b = '' and coverage = sure and mean < whole - 0.0002 then 'monotonicity' else reason end as reason from rs, ed)
select *, case when reason is null then 'PASS' else 'KILL' end as decision from v""", "mean win_rate")
def _(spark, d):
    return models.coverage_verdict(QUERIES["m7_coverage_check"](spark, d), 100, 0.001, 0.0002)
