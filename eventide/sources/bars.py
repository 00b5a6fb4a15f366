"""Sources: ticks to bars, sessions, landed files, news, upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SessionSpec:
    """Clock of a trading day, in minutes after midnight of the zone."""

    zone: str = "America/New_York"
    premarket: tuple[int, int] = (240, 570)
    rth: tuple[int, int] = (570, 960)
    after_hours: tuple[int, int] = (960, 1200)
    bar_minutes: int = 1


#: The tick table's clock: bars of a quarter of an hour, 06:00 to 20:00 regular.
QUARTERS = SessionSpec(premarket=(0, 360), rth=(360, 1200), after_hours=(1200, 1440), bar_minutes=15)

#: An instrument is traded by so many neighbouring users, so that instruments grow with the users.
DESK = 20


def instrument_of(user: str = "user_id") -> Column:
    return F.concat(F.lit("i"), F.floor(F.col(user) / DESK).cast("long"))


def utc_of_micros(micros: Column) -> Column:
    """A naive UTC time from microseconds since 1970, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def utc_of_text(said: Column) -> Column:
    """A naive UTC time from text: times with an offset or Z are brought to UTC, naive ones are taken as UTC, what is no time
    is null."""
    aware = said.rlike(r"[T ]\d\d:.*(Z|[+-]\d\d:?\d\d)$")
    return F.when(aware, utc_of_micros(F.unix_micros(F.try_to_timestamp(F.when(aware, said))))).otherwise(F.when(~aware, said).try_cast("timestamp_ntz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start(minutes: int) -> Column:
    return (F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.floor(F.minute("ts") / minutes) * minutes).cast("int"))).cast("timestamp_ntz")


def bar_starts(events: DataFrame, minutes: int = QUARTERS.bar_minutes) -> DataFrame:
    """ts_utc: when bars begin, each time once."""
    return events.select(_start(minutes).alias("ts_utc")).distinct()


def bars_from_ticks(events: DataFrame, minutes: int = QUARTERS.bar_minutes) -> DataFrame:
    """Ticks to bars of an instrument, of so many minutes (a divisor of 60): open and close by time (event_id breaks ties),
    high, low, counts."""
    ticks = events.select(
        instrument_of().alias("instrument_id"),
        _start(minutes).alias("ts_utc"),
        F.struct("ts", "event_id").alias("at"),
        F.col("value").alias("price"),
    )
    return ticks.groupBy("instrument_id", "ts_utc").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.count("*").alias("transactions"),
    )


def add_session(bars: DataFrame, spec: SessionSpec = QUARTERS) -> DataFrame:
    """Adds ts_et, session_date, minute_of_day, is_rth, is_premarket, is_after_hours. ts_utc is a naive UTC bar start."""
    et = F.convert_timezone(F.lit("UTC"), F.lit(spec.zone), F.col("ts_utc"))
    m = F.col("minute_of_day")
    inside = lambda ab: (m >= ab[0]) & (m < ab[1])
    return (
        bars.withColumn("ts_et", et)
        .withColumn("session_date", F.to_date("ts_et"))
        .withColumn("minute_of_day", F.hour("ts_et") * 60 + F.minute("ts_et"))
        .withColumn("is_rth", inside(spec.rth))
        .withColumn("is_premarket", inside(spec.premarket))
        .withColumn("is_after_hours", inside(spec.after_hours))
    )


def instruments(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """One instrument a supplier key, with an exchange taken from the customer of the same key."""
    exchange = F.concat(F.lit("X"), F.pmod(F.length("c_mktsegment"), F.lit(3)))
    c = customer.select(F.col("c_custkey").alias("_k"), exchange.alias("exchange"))
    return supplier.join(c, supplier.s_suppkey == c["_k"], "left").select(
        F.concat(F.lit("i"), F.col("s_suppkey")).alias("instrument_id"),
        F.col("s_name").alias("ticker"),
        "exchange",
        F.when(F.col("s_nationkey") % 5 == 0, "ETF").otherwise("CS").alias("security_type"),
    )


def news(events: DataFrame, lag_minutes: int = 60) -> DataFrame:
    """Scored insights: sign-ups are good news, errors bad, views neutral; available a while after publication."""
    score = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0)
    return events.select(
        instrument_of().alias("instrument_id"),
        F.col("ts").alias("published_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(lag_minutes))).alias("available_at"),
        score.alias("sentiment_score"),
        F.col("event_id").alias("article_id"),
        F.col("props").alias("publisher"),
        (F.col("event_id") % 3 + 1).cast("int").alias("article_ticker_count"),
    ).filter("sentiment_score is not null")


def read_bar_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed gzip CSV minute files to bars. Header case is free; window_start is an epoch in ns, us, ms or s, told by its
    number of digits."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    digits = F.length(F.col("window_start"))
    epoch = F.col("window_start").cast("long")
    micros = F.when(digits >= 18, F.floor(epoch / 1000)).when(digits >= 15, epoch).when(digits >= 12, epoch * 1000).otherwise(epoch * 1_000_000)
    number = lambda c: F.col(c).cast("double").alias(c)
    return raw.select(
        F.concat(F.lit("ticker:"), F.col("ticker")).alias("instrument_id"),
        "ticker",
        utc_of_micros(F.floor(micros / 1_000_000) * 1_000_000).alias("ts_utc"),
        *map(number, ("open", "high", "low", "close", "volume")),
        F.col("transactions").cast("long").alias("transactions"),
        F.lit("flatfile").alias("source"),
    )


def write_bars(bars: DataFrame, path: str) -> None:
    """Day partitions, compressed; only the days that are written are replaced."""
    bars.withColumn("date", F.to_date("ts_utc")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def read_days(spark: SparkSession, path: str, days: list[str], columns: list[str]) -> DataFrame:
    """Some days and columns of a day-partitioned store: both prune the scan."""
    return spark.read.parquet(path).filter(F.col("date").isin(*days)).select(*columns)


def read_aggregates_json(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Landed API aggregates (o, h, l, c, v, vw, n, t in ms) to bars, one a time; the last in the order of values stays."""
    kinds = "o double, h double, l double, c double, v double, vw double, n long, t long"
    raw = spark.read.schema(kinds).json(path).filter("t is not null")
    bars = raw.select(
        F.lit(f"ticker:{ticker}").alias("instrument_id"),
        utc_of_micros(F.floor(F.col("t") / 1000) * 1_000_000).alias("ts_utc"),
        *[F.col(a).alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "vwap"), ("n", "transactions"))],
    )
    return latest(bars, ["instrument_id", "ts_utc"], ["volume", "close", "open", "high", "low"])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of `new` winning on equal keys."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_seq"]).drop("_seq")


def collapse_snapshots(snapshots: DataFrame, key: str = "ticker", asof: str = "asof_date") -> DataFrame:
    """The last snapshot of each ticker."""
    rest = [c for c in snapshots.columns if c not in (key,)]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), asof).alias("_s")).select(key, "_s.*")


# Instrument types that are left out, and exchange codes with the names they stand for.
EXCLUDED_TYPES = ("ETF", "ETN", "ETV", "ETS", "WT", "Warrant", "RIGHT", "RIGHTS", "UNIT", "PFD", "PREFERRED", "FUND", "OPEN", "CLOSED", "CSVM")
EXCHANGES = {
    "XNAS": "NASDAQ",
    "NASDAQ": "NASDAQ",
    "XNYS": "NYSE",
    "NYSE": "NYSE",
    "XASE": "NYSE_AMERICAN",
    "AMEX": "NYSE_AMERICAN",
    "NYE": "NYSE_AMERICAN",
    "ASE": "NYSE_AMERICAN",
}


def instruments_from_json(raw: DataFrame) -> DataFrame:
    """API tickers to instruments on known exchanges; identity by FIGI, then CIK, then ticker. No type or CS is common stock,
    other types keep their name, excluded ones (by their upper-case form) go. Unknown activity counts as active."""
    exchange = F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])[F.upper("primary_exchange")]
    given = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    identity = F.coalesce(F.concat(F.lit("figi:"), given("composite_figi")), F.concat(F.lit("cik:"), given("cik")), F.concat(F.lit("ticker:"), F.col("ticker")))
    kind = F.coalesce(F.col("type"), F.lit(""))
    return raw.filter(~F.upper(kind).isin(*EXCLUDED_TYPES)).select(
        identity.alias("instrument_id"), "ticker", exchange.alias("exchange"), F.when(kind.isin("", "CS"), "COMMON_STOCK").otherwise(kind).alias("security_type"),
        given("cik").alias("cik"), F.coalesce("active", F.lit(True)).alias("active"), "list_date", "delisted_utc",
    ).filter("exchange is not null")


def splits_from_json(raw: DataFrame) -> DataFrame:
    """API splits to corporate actions: ratio = to / from."""
    return raw.select(
        F.concat(F.lit("ticker:"), F.col("ticker")).alias("instrument_id"),
        F.lit("split").alias("type"),
        F.to_date(F.coalesce("execution_date", "ex_date")).alias("effective_date"),
        F.try_divide(F.col("split_to").cast("double"), F.col("split_from").cast("double")).alias("ratio"),
    ).filter("effective_date is not null and ratio is not null")


def flatten_news(articles: DataFrame) -> DataFrame:
    """Articles with arrays tickers and insights(ticker, sentiment) to one row a scored insight."""
    # Scores of the sentiment labels.
    score = F.create_map(F.lit("positive"), F.lit(1), F.lit("neutral"), F.lit(0), F.lit("negative"), F.lit(-1))
    one = articles.select("article_id", "published_utc", "publisher", F.size("tickers").alias("article_ticker_count"), F.to_json("keywords").alias("keywords"), F.explode("insights").alias("i"))
    return one.select(
        "article_id", F.col("i.ticker").alias("ticker"), utc_of_text(F.col("published_utc").cast("string")).alias("published_ts"), "publisher", "article_ticker_count", "keywords",
        F.col("i.sentiment").alias("sentiment"), score[F.lower("i.sentiment")].alias("sentiment_score"),
    ).filter("sentiment_score is not null and ticker is not null")
