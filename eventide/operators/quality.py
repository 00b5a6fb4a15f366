"""Certification of a bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_date(bars: DataFrame) -> DataFrame:
    """Counts of what is wrong or odd, a row a day."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    return bars.groupBy("session_date").agg(
        F.count("*").alias("rows"), F.countDistinct("instrument_id").alias("names"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count_if(bad).alias("bad_ohlc"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("non_positive"), F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("transactions") < 0).alias("negative_transactions"),
        F.count_if(F.unix_micros(F.col("ts_utc").cast("timestamp")) % 60_000_000 != 0).alias("off_minute"), F.count_if(~(F.col("is_premarket") | F.col("is_rth") | F.col("is_after_hours"))).alias("out_of_hours"),
        (F.count("*") - F.countDistinct("instrument_id", "ts_utc")).alias("extra_rows"),
        F.count_if("is_premarket").alias("premarket_rows"), F.count_if("is_rth").alias("rth_rows"), F.count_if("is_after_hours").alias("after_hours_rows"), F.max("high").alias("max_high"), F.min("low").alias("min_low"),
    )


def repeated(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument_id", "ts_utc").agg(F.count("*").alias("times")).filter("times > 1")


def overnight_jumps(daily: DataFrame, actions: DataFrame, limit: float = 0.4) -> DataFrame:
    """Opens far from the previous close, and whether a split of the day explains them."""
    w = Window.partitionBy("instrument_id").orderBy("session_date")
    d = daily.withColumn("prev_close", F.lag("rth_close").over(w)).withColumn("jump", F.try_divide("rth_open", F.col("prev_close")) - 1).filter(F.abs("jump") >= limit)
    a = actions.select("instrument_id", F.col("effective_date").alias("session_date"), F.lit(True).alias("_split")).distinct()
    return d.join(a, ["instrument_id", "session_date"], "left").select("instrument_id", "session_date", "prev_close", "rth_open", "jump", F.coalesce("_split", F.lit(False)).alias("explained"))


def coverage_jumps(days: DataFrame, share: float = 0.25) -> DataFrame:
    """Days whose number of names jumps by a share against the day before (jump), or whose names or rows leave 0.5 to 1.5
    times the median day's (outside)."""
    every = Window.partitionBy(F.lit(1))  # a row a day
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(every)
    d = days.withColumn("before", F.lag("names").over(Window.orderBy("session_date"))).withColumns({"_names": middle("names"), "_rows": middle("rows")})
    d = d.withColumn("jump", F.coalesce(F.abs(F.col("names") - F.col("before")) / F.when(F.col("before") > 0, F.col("before")) > share, F.lit(False)))
    out = lambda c, m: (F.col(m) != 0) & ~F.col(c).between(0.5 * F.col(m), 1.5 * F.col(m))
    d = d.withColumn("outside", out("names", "_names") | out("rows", "_rows"))
    return d.filter(F.col("jump") | F.col("outside")).select("session_date", "rows", "names", "before", "jump", "outside")


def missing_weekdays(days: DataFrame, keys: list[str]) -> DataFrame:
    """Weekdays between the first and the last day of each key that have no rows."""
    days = days.select(*keys, "session_date").distinct()
    span = days.groupBy(*keys).agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).filter("a is not null")
    every = span.select(*keys, F.explode(F.sequence("a", "b")).alias("session_date")).filter(F.weekday("session_date") < 5)
    return every.join(days, [*keys, "session_date"], "left_anti")


def worst_rows(bars: DataFrame, value: str, k: int = 5) -> DataFrame:
    """The k largest values of a column of each day."""
    w = Window.partitionBy("session_date").orderBy(F.desc(value), "instrument_id", "ts_utc")
    return bars.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def certified(days: DataFrame, jumps: DataFrame, overnight: DataFrame, extreme: DataFrame, instruments: DataFrame, missing: DataFrame) -> DataFrame:
    """category, found, grade of the eight categories and of the verdict over all of them.

    days: by_date; jumps: coverage_jumps; overnight: overnight_jumps; extreme: extremes; missing: days that should be there
    and aren't. A table of the reference without rows fails, one with rows warns, as it tells no listing dates; identity
    by ticker always warns. The verdict is NOT_READY if a category fails."""
    sums = ("rows", "bad_ohlc", "non_positive", "negative_volume", "negative_transactions", "off_minute", "out_of_hours", "extra_rows")
    t = days.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums], F.count("*").alias("n_days"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one_row = [count(jumps, "jumps"), count(overnight, "overnight"), count(overnight.filter(~F.col("explained")), "unexplained"), count(extreme, "extremes"), count(instruments, "listed"), count(missing, "missing")]
    for other in one_row:
        t = t.crossJoin(F.broadcast(other))
    odd = F.col("bad_ohlc") + F.col("non_positive") + F.col("negative_volume") + F.col("negative_transactions")
    warn = lambda c: F.when(c > 0, "WARNING").otherwise("PASS")
    grades = {
        "coverage": (F.col("missing") + F.col("jumps"), F.when((F.col("missing") > 0) | (F.col("n_days") == 0), "FAIL").otherwise(warn(F.col("jumps")))),
        "uniqueness": (F.col("extra_rows"), F.when(F.col("extra_rows") >= 100, "FAIL").otherwise(warn(F.col("extra_rows")))),
        "ohlc": (odd, F.when(F.col("bad_ohlc") > 0.001 * F.col("rows"), "FAIL").otherwise(warn(odd))),
        "timestamps": (F.col("out_of_hours") + F.col("off_minute"), F.when(F.col("out_of_hours") > 0.01 * F.col("rows"), "FAIL").otherwise(warn(F.col("out_of_hours") + F.col("off_minute")))),
        "splits": (F.col("overnight"), F.when(F.col("unexplained") > 500, "FAIL").otherwise(warn(F.col("overnight")))),
        "extremes": (F.col("extremes"), warn(F.col("extremes"))),
        "reference_pit": (F.col("listed"), F.when(F.col("listed") == 0, "FAIL").otherwise("WARNING")),
        "instrument_identity": (F.lit(0).cast("long"), F.lit("WARNING")),
    }
    each = [F.struct(F.lit(c).alias("category"), found.cast("long").alias("found"), grade.alias("grade")) for c, (found, grade) in grades.items()]
    t = t.select(F.array(*each).alias("c"))
    failed = F.size(F.filter("c", lambda c: c["grade"] == "FAIL")).cast("long")
    overall = F.struct(F.lit("verdict").alias("category"), failed.alias("found"), F.when(failed > 0, "NOT_READY").otherwise("READY_FOR_EXPLORATORY_RESEARCH").alias("grade"))
    return t.select(F.inline(F.concat("c", F.array(overall))))


def extremes(bars: DataFrame, price: float, volume: float, move: float, k: int | None, low: float | None = None) -> DataFrame:
    """The k largest (all, without k) prices, volumes and one-bar moves (within a day) of at least so much, and with `low` the
    k smallest closes above 0 and up to it: (kind, instrument, time, value). Each of 64 salts first keeps its own k."""
    step = Window.partitionBy("instrument_id", "session_date").orderBy("ts_utc")
    moved = F.abs(F.try_divide("close", F.lag("close").over(step)) - 1)
    one = lambda kind, value, hit: F.struct(F.lit(kind).alias("kind"), value.alias("value"), hit.alias("hit"))
    kinds = [one(kind, F.col(c), F.col(c) >= least) for kind, c, least in (("price", "high", price), ("volume", "volume", volume), ("move", "_move", move))]
    if low is not None:
        kinds.append(one("low", F.col("close"), (F.col("close") > 0) & (F.col("close") <= low)))
    hits = bars.withColumn("_move", moved).select("instrument_id", "ts_utc", F.explode(F.filter(F.array(*kinds), lambda x: x["hit"])).alias("x")).select("instrument_id", "ts_utc", "x.kind", "x.value")
    if k is None:
        return hits
    size = F.when(F.col("kind") == "low", -F.col("value")).otherwise(F.col("value"))
    hits = hits.withColumn("_salt", F.pmod(F.xxhash64("instrument_id", "ts_utc"), F.lit(64)))
    for group in (["kind", "_salt"], ["kind"]):
        w = Window.partitionBy(*group).orderBy(size.desc(), "instrument_id", "ts_utc")
        hits = hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    return hits.drop("_k", "_salt")


def reference_coverage(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """By exchange: listed instruments, those that trade, those that never do; and traded ones that aren't listed."""
    traded = bars.select(F.col("instrument_id").alias("_traded")).distinct()
    both = instruments.select(F.col("instrument_id").alias("_listed"), "exchange").join(traded, F.col("_listed") == F.col("_traded"), "full")
    return both.groupBy(F.coalesce("exchange", F.lit("none")).alias("exchange")).agg(
        F.count("_listed").alias("listed"), F.count("_traded").alias("traded"), F.count_if(F.col("_traded").isNull()).alias("never_traded"), F.count_if(F.col("_listed").isNull()).alias("unlisted")
    )


def identity_counts(instruments: DataFrame) -> DataFrame:
    """What a reference table tells of identity, in one grouping: (aspect, value, n, with_figi) by activity and by exchange.
    Instruments known by FIGI have ids that begin with figi:."""
    aspects = F.array(F.struct(F.lit("active").alias("aspect"), F.col("active").cast("string").alias("value")), F.struct(F.lit("exchange").alias("aspect"), F.col("exchange").alias("value")))
    each = instruments.select("instrument_id", F.explode(aspects).alias("a"))
    return each.groupBy("a.aspect", "a.value").agg(F.count("*").alias("n"), F.count_if(F.startswith("instrument_id", F.lit("figi:"))).alias("with_figi"))


def news_onset(periods: DataFrame, period: str, rate: str = "rate", articles: str = "n", reliable: float = 0.8, usable: float = 0.5, least: int = 50) -> DataFrame:
    """The first period with enough articles and a reliable rate; where there is none, the first with a usable one; else no row.
    Adds which level it was. One row a period takes part."""
    p = periods.filter((F.col(articles) >= least) & (F.col(rate) >= usable))
    level = F.when(F.col(rate) >= reliable, "reliable").otherwise("usable")
    return p.withColumn("level", level).orderBy("level", period).limit(1)


def column_drift(df: DataFrame, day: str) -> DataFrame:
    """A row a day: its rows, and which columns it has that the first day lacks (added) or lacks that the first day has
    (missing), as comma-joined names in order. A column is there if it has a value; one pass over all columns."""
    names = sorted(c for c in df.columns if c != day)
    present = F.array_compact(F.array(*[F.when(F.count(f"`{c}`") > 0, F.lit(c)) for c in names]))
    d = df.groupBy(day).agg(F.count("*").alias("rows"), present.alias("_has"))
    first = d.agg(F.min_by("_has", day).alias("_first"))
    said = lambda a, b: F.array_join(F.array_except(a, b), ",")
    return d.crossJoin(F.broadcast(first)).select(day, "rows", said("_has", "_first").alias("added"), said("_first", "_has").alias("missing"))


def news_checks(news: DataFrame) -> DataFrame:
    """Rows, repeated (instrument, article) pairs, nulls, scores outside -1 to 1, and insights available before they are
    published."""
    c = news.select("*", F.struct("instrument_id", "article_id").alias("_k"))
    return c.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.countDistinct("_k")).alias("repeated"),
        F.count_if(F.col("published_ts").isNull() | F.col("article_id").isNull()).alias("nulls"),
        F.count_if(~F.col("sentiment_score").between(-1, 1)).alias("out_of_range"),
        F.count_if(F.col("available_at") < F.col("published_ts")).alias("early"),
    )


def partition_health(df: DataFrame, day: str, null_rates: dict[str, str], ranks: str) -> DataFrame:
    """Of each day: rows, names, share of nulls of some columns, and the range of a rank."""
    rates = [F.avg(F.col(c).isNull().cast("double")).alias(n) for n, c in null_rates.items()]
    return df.groupBy(day).agg(F.count("*").alias("rows"), F.countDistinct("instrument_id").alias("names"), *rates, F.min(ranks).alias("rank_min"), F.max(ranks).alias("rank_max"))


def watchdog(health: DataFrame, days: DataFrame, nulls: str = "nulls") -> DataFrame:
    """Every calendar day with its rows (0 if it has none), how many empty days it ends in a row, and whether the watched
    column is null throughout. One row a day takes part."""
    c = days.join(health, "session_date", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    run = F.sum((F.col("rows") > 0).cast("int")).over(Window.orderBy("session_date"))
    c = c.withColumn("_run", run)
    streak = F.count_if(F.col("rows") == 0).over(Window.partitionBy("_run").orderBy("session_date"))
    return c.select("session_date", "rows", streak.alias("empty_streak"), F.coalesce(F.col(nulls) == 1, F.lit(False)).alias("all_null"))
