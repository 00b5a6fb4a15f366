"""What the news said when a decision was made, from running counts at both ends of every window.

News and probes of an instrument are laid out together by time; sums so far at the decision less sums so far at a window's
left end are the window's counts. Distinct values need no sets: of two neighbouring news of one publisher less than a window
apart, the second one's time is an end and the first one's a start, and a window holds as many repeats as it has ends before
its right end less starts before its left end. No row meets another, so that nothing multiplies by news.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Windows of the state in hours, and whether their left end belongs to them.
WINDOWS = {"2h": (2, False), "4h": (4, False), "today": (12, True)}


def _marks(news: DataFrame) -> DataFrame:
    """news with, for each window and for publishers and articles, whether the same value comes before or after within it."""
    t = F.unix_micros(F.col("available_at").cast("timestamp"))
    for value in ("publisher", "article_id"):
        w = Window.partitionBy("instrument_id", value).orderBy("available_at", "article_id")
        for side, near in (("end", t - F.lag(t).over(w)), ("start", F.lead(t).over(w) - t)):
            for name, (hours, closed) in WINDOWS.items():
                limit = F.lit(hours * 3_600_000_000)
                ok = F.col(value).isNotNull() & (near <= limit if closed else near < limit)
                news = news.withColumn(f"{value}_{side}_{name}", F.coalesce(ok, F.lit(False)).cast("int"))
    return news


def with_news_state(rows: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, instrument_id, decision_ts) with the latest news available by then and the counts of the last two, four and
    twelve hours; keys tell rows apart, which must be stored or else the same at every reading.

    news(instrument_id, available_at, sentiment_score, article_id, publisher, article_ticker_count); news that is never
    available doesn't count. Without news the latest is null and counts are 0. Of news of one time the latest is the one with
    the greatest article."""
    s, n = F.col("sentiment_score"), F.col("article_ticker_count")
    counted = {"positive": s == 1, "neutral": s == 0, "negative": s == -1, "single": n == 1, "multi": n > 1, "any": F.lit(True), "published": F.col("publisher").isNotNull(), "named": F.col("article_id").isNotNull()}
    marks = [f"{v}_{side}_{name}" for v in ("publisher", "article_id") for side in ("end", "start") for name in WINDOWS]
    told = _marks(news.filter(F.col("available_at").isNotNull()))
    latest = F.struct(F.col("available_at").alias("at"), F.col("article_id").alias("article"), s.alias("sentiment"), n.alias("tickers"))
    sums = [*counted, "net", *marks]
    told = told.select("instrument_id", F.col("available_at").alias("_t"), F.lit(1).alias("_order"), F.lit(None).cast("string").alias("_kind"), latest.alias("_latest"), *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in counted.items()], F.coalesce(s, F.lit(0)).cast("int").alias("net"), *marks)
    # a probe behind the news of its own time sees it, one before it doesn't
    probes = [F.struct(F.lit("now").alias("_kind"), F.lit(2).alias("_order"), F.col("decision_ts").alias("_t"))]
    probes += [F.struct(F.lit(name).alias("_kind"), F.lit(0 if closed else 2).alias("_order"), (F.col("decision_ts") - F.make_dt_interval(hours=F.lit(h))).alias("_t")) for name, (h, closed) in WINDOWS.items()]
    asked = rows.select(F.struct(*keys).alias("_key"), "instrument_id", F.inline(F.array(*probes)))
    both = told.withColumn("_key", F.lit(None).cast(asked.schema["_key"].dataType)).unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("instrument_id").orderBy("_t", "_order", F.col("_latest.article")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("_key", "_kind", F.last("_latest", ignorenulls=True).over(upto).alias("_latest"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in sums]).filter("_kind is not null")
    at = lambda kind, c: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    g = seen.groupBy("_key").agg(at("now", "_latest").alias("_latest"), *[at(k, c).alias(f"{c}@{k}") for k in ("now", *WINDOWS) for c in sums])
    col = lambda c, k: F.col(f"`{c}@{k}`")
    inside = lambda c, k: (col(c, "now") - col(c, k)).cast("long")
    distinct = lambda v, of, k: (inside(of, k) - (col(f"{v}_end_{k}", "now") - col(f"{v}_start_{k}", k))).cast("long")
    out = [F.col("_latest.at").alias("latest_news_available_at"), F.col("_latest.article").alias("latest_article_id"), F.col("_latest.sentiment").alias("latest_news_sentiment"), F.col("_latest.tickers").alias("latest_article_ticker_count")]
    for k in WINDOWS:
        out += [inside(c, k).alias(f"{c}_count_{k}") for c in ("positive", "neutral", "negative")]
        out += [inside(c, k).alias(f"{c}_ticker_news_count_{k}") for c in ("single", "multi")]
        out += [distinct("article_id", "named", k).alias(f"article_count_{k}"), distinct("publisher", "published", k).alias(f"publisher_count_{k}"), inside("net", k).alias(f"net_sentiment_{k}")]
    g = g.select(F.col("_key"), *out)
    pos, neg, neu = (F.col(f"{c}_count_2h") for c in ("positive", "negative", "neutral"))
    sent = F.col("latest_news_sentiment")
    g = g.withColumn("same_direction_news_count", F.when(sent == 1, pos).when(sent == -1, neg).otherwise(neu))
    g = g.withColumns({f"sentiment_{a}": F.col(f"net_sentiment_{k}") for a, k in (("last_2h", "2h"), ("last_4h", "4h"), ("today", "today"))})
    joined = rows.withColumn("_key", F.struct(*keys)).join(g, "_key", "left").drop("_key")
    since = F.floor((F.unix_micros(F.col("decision_ts").cast("timestamp")) - F.unix_micros(F.col("latest_news_available_at").cast("timestamp"))) / 60_000_000)
    return joined.withColumn("minutes_since_latest_available_news", since.cast("long"))


def news_jobs(lo: int, hi: int, ret: float, rvol: float, residual: float, reaction: float, strong: float, many: int, recent: int, early: str, late: str) -> dict[str, tuple[str, str]]:
    """Conditions and sides of the news families over features with news state: news and price (n1 to n4), news against the
    residual (n5), intensity (ni), residual reaction (nr) and baselines (bl). `early` and `late` are conditions on the clock;
    lo and hi minutes since the latest news."""
    fresh = f"minutes_since_latest_available_news between {lo} and {hi}"
    good, bad = "latest_news_sentiment = 1", "latest_news_sentiment = -1"
    long, short = "'LONG'", "'SHORT'"
    jobs = {
        "n1_good_up": (f"{early} and {good} and {fresh} and ret_5m >= {ret} and rvol_5m >= {rvol}", long),
        "n2_good_down": (f"{early} and {good} and {fresh} and ret_5m < 0", short),
        "n3_bad_down": (f"{early} and {bad} and {fresh} and ret_5m <= -{ret} and rvol_5m >= {rvol}", short),
        "n4_bad_up": (f"{early} and {bad} and {fresh} and ret_5m > 0", long),
        "ni_multi_pos": (f"{late} and positive_count_2h >= {many}", long),
        "ni_multi_neg": (f"{late} and negative_count_2h >= {many}", short),
        "ni_pub_agree": (f"{late} and publisher_count_2h >= {many} and net_sentiment_2h > 0", long),
        "ni_single": (f"{late} and single_ticker_news_count_2h >= 1 and {good}", long),
        "nr_pos_strong": (f"{early} and {fresh} and {good} and resid_5m >= {reaction}", long),
        "nr_pos_weak": (f"{early} and {fresh} and {good} and resid_5m <= -{reaction}", short),
        "nr_neg_weak": (f"{early} and {fresh} and {bad} and resid_5m <= -{reaction}", short),
        "nr_neg_strong": (f"{early} and {fresh} and {bad} and resid_5m >= {reaction}", long),
        "bl_news_pos": (f"{late} and {good} and minutes_since_latest_available_news <= {recent}", long),
        "bl_news_neg": (f"{late} and {bad} and minutes_since_latest_available_news <= {recent}", short),
        "bl_residual": (f"{late} and resid_5m >= {strong}", long),
    }
    for name, sent in (("good", good), ("bad", bad)):
        for kind, cond in (("weak", f"resid_5m <= -{residual}"), ("strong", f"resid_5m >= {residual}")):
            jobs[f"n5_{name}_{kind}"] = (f"{early} and {sent} and {fresh} and {cond}", long if kind == "weak" else short)
    return jobs
