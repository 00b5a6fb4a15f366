"""Summaries, robustness tables, block bootstrap, associations, trees and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import correlation, drawn, exact_percentiles, small, stored, wide_rank, with_top
from eventide.functions.tdist import t_p


def summary(returns: DataFrame, keys: list[str], x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Sample size, moments, quantiles, share above 0, t statistic, effect size and share of the sum that the top 1 % by
    size make up (signed over signed: above 1 where the others lose, 0 where the sum is)."""
    r = stored(returns.filter(F.col(x).isNotNull()).select(*keys, "event_id", "instrument_id", day, x), "returns")
    r = with_top(r, keys, F.abs(x), lambda n: F.ceil(n * 0.01), 0.01, ["event_id"])
    s = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((F.col(x) > 0).cast("double")).alias("positive_rate"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("_top"), F.col(x))), F.sum(x)), F.lit(0.0)).alias("top_share"), F.countDistinct(day).alias("days"), F.countDistinct("instrument_id").alias("names"), F.countDistinct(F.struct("instrument_id", day)).alias("name_days"),
    )
    s = s.withColumn("se", F.col("std") / F.sqrt("n")).withColumn("t_stat", F.try_divide("mean", "se")).withColumn("effect", F.try_divide("mean", "std"))
    q = exact_percentiles(r, keys, x, (0.1, 0.25, 0.5, 0.75, 0.9))
    return s.join(small(q), keys).select(*keys, "n", "mean", "std", "se", "t_stat", "effect", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "positive_rate", "top_share", "days", "names", "name_days")


def without_top(returns: DataFrame, keys: list[str], share: float, x: str = "forward_return") -> DataFrame:
    """Mean without the best ceil(share n) rows, and below the 99th percentile."""
    r = stored(returns.filter(F.col(x).isNotNull()).select(*keys, "event_id", x), "returns")
    q = small(exact_percentiles(r, keys, x, (0.99,)).select(*keys, F.col("q")[0].alias("_q99")))
    r = with_top(r, keys, F.col(x), lambda n: F.ceil(n * share), share, ["event_id"]).join(q, keys)
    return r.groupBy(*keys).agg(F.avg(F.when(~F.col("_top"), F.col(x))).alias("mean_without_top"), F.avg(F.when(F.col(x) <= F.col("_q99"), F.col(x))).alias("mean_below_q99"))


def day_agreement(returns: DataFrame, keys: list[str], x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Share of days with a mean above 0, and the mean without the best day."""
    d = returns.filter(F.col(x).isNotNull()).groupBy(*keys, day).agg(F.avg(x).alias("m"), F.sum(x).alias("s"), F.count("*").alias("c"))
    best = Window.partitionBy(*keys).orderBy(F.desc("m"), day)
    d = d.withColumn("_k", F.row_number().over(best))
    rest = F.col("_k") > 1
    return d.groupBy(*keys).agg(F.avg((F.col("m") > 0).cast("double")).alias("positive_days"), F.try_divide(F.sum(F.when(rest, F.col("s"))), F.sum(F.when(rest, F.col("c")))).alias("mean_without_best_day"), F.count("*").alias("days"))


def concentration(returns: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Largest share of one value of `by`."""
    c = returns.groupBy(*keys, by).count()
    return c.groupBy(*keys).agg((F.max("count") / F.sum("count")).alias("top_share"), F.count("*").alias("values"))


def replicate_means(returns: DataFrame, keys: list[str], replicates: int, x: str = "forward_return", day: str = "session_date", seed: int = 7) -> DataFrame:
    """keys, rep, m: means over drawn day blocks. Each replicate draws as many days as there are, each draw from a hash of
    (seed, replicate, slot). What is multiplied is days by replicates, never rows."""
    d = returns.filter(F.col(x).isNotNull()).groupBy(*keys, day).agg(F.sum(x).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    d = d.withColumn("i", F.row_number().over(w.orderBy(day)) - 1).withColumn("n", F.count("*").over(w))
    slots = d.select(*keys, F.col("i").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    return slots.withColumn("i", drawn(seed, "rep", "slot", "n")).join(d.select(*keys, "i", "s", "c"), [*keys, "i"]).groupBy(*keys, "rep").agg((F.sum("s") / F.sum("c")).alias("m"))


def bootstrap(returns: DataFrame, keys: list[str], replicates: int, x: str = "forward_return", day: str = "session_date", seed: int = 7) -> DataFrame:
    """Day-block bootstrap of the mean: 2.5 % and 97.5 % bounds and a two-sided p."""
    m = replicate_means(returns, keys, replicates, x, day, seed)
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    out = m.groupBy(*keys).agg(q.alias("_q"), F.avg((F.col("m") <= 0).cast("double")).alias("_a"), F.avg((F.col("m") >= 0).cast("double")).alias("_b"))
    return out.select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), F.least(F.lit(1.0), 2 * F.least("_a", "_b")).alias("p_boot"))


def reality_check(day_means: DataFrame, replicates: int, rule: str = "rule", day: str = "session_date", x: str = "m", least_days: int = 10, seed: int = 7) -> DataFrame:
    """p of the best of several rules against no edge: the largest studentised mean (over the root of all days), and in
    each replicate of drawn days the largest studentised mean of what is recentred by max(mean, 0), studentised anew. Days
    on which a rule has no mean are left out of its moments. Fewer than `least_days` days give no p."""
    d = day_means.select(F.col(rule).alias("rule"), F.col(day).alias("day"), F.col(x).alias("m")).filter("m is not null")
    days = d.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    days = days.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    se = lambda n: F.greatest(F.stddev_samp("m") / F.sqrt(n), F.lit(1e-12))
    total = days.agg(F.max("n").alias("n"))
    by_rule = d.crossJoin(F.broadcast(total)).groupBy("rule").agg((F.avg("m") / se(F.first("n"))).alias("t"), F.greatest(F.avg("m"), F.lit(0.0)).alias("c"), F.first("n").alias("n"))
    seen = by_rule.agg(F.max("t").alias("best"), F.count("*").alias("rules"), F.max("n").alias("n"))
    slots = days.select(F.col("i").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    per = slots.select("rep", drawn(seed, "rep", "slot", "n").alias("i")).join(days.select("i", "day", "n"), "i").join(d, "day").join(by_rule.select("rule", "c"), "rule").groupBy("rep", "rule").agg(((F.avg("m") - F.first("c")) / se(F.first("n"))).alias("t"))
    top = per.groupBy("rep").agg(F.max("t").alias("t"))
    p = (F.count_if(F.col("t") >= F.col("best") - 1e-9) + 1) / (F.count("*") + 1)
    out = top.crossJoin(F.broadcast(seen)).agg(F.first("best").alias("best_t"), F.first("rules").alias("rules"), F.first("n").alias("days"), p.alias("p"))
    return out.select("best_t", "rules", "days", F.when(F.col("days") >= least_days, F.col("p")).alias("p_value"))


def day_association(panel: DataFrame, features: list[str], target: str, day: str = "session_date", least_rows: int = 10) -> DataFrame:
    """Rank correlation of each feature with the target within each day, and the t statistic of the daily values. All
    features go through one job."""
    long = panel.filter(F.col(target).isNotNull()).select(day, F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_f"))
    long = long.select(day, "y", "_f.feature", "_f.x").filter("x is not null")
    rank = lambda c: F.rank().over(Window.partitionBy(day, "feature").orderBy(c)) + (F.count("*").over(Window.partitionBy(day, "feature", c)) - 1) / 2.0
    r = long.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    per_day = r.groupBy(day, "feature").agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho")).filter(F.col("rho").isNotNull() & ~F.isnan("rho") & (F.col("n") >= least_rows))
    s = per_day.groupBy("feature").agg(F.count("*").alias("days"), F.avg("rho").alias("mean_rho"), F.stddev_samp("rho").alias("sd"))
    return s.withColumn("t_stat", F.try_divide(F.col("mean_rho") * F.sqrt("days"), F.col("sd"))).drop("sd")


def row_association(panel: DataFrame, features: list[str], target: str, day: str = "session_date", least_rows: int = 30, least_days: int = 8) -> DataFrame:
    """Rank correlation of each feature with the target over all rows that have both: feature, n, days, distinct, rho,
    t_stat and p (n - 2 degrees of freedom). p is 1 with fewer rows or days than asked for, and where one side doesn't
    vary; rows of a day aren't independent, so that days guard the test. Ranks are average ones over the whole table."""
    long = panel.select(day, F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    long = stored(long.select(day, "y", "f.*").filter(finite("x") & finite("y")), "pairs")
    ranked = wide_rank(wide_rank(long, ["feature"], "x", "rx"), ["feature"], "y", "ry")
    s = ranked.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct(day).alias("days"), F.countDistinct("x").alias("distinct"), correlation("rx", "ry").alias("rho"))
    s = s.withColumn("t_stat", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("rho") * F.col("rho"))))
    tested = (F.col("n") >= least_rows) & (F.col("days") >= least_days) & F.col("rho").isNotNull()
    p = F.when(~tested, 1.0).when(F.abs("rho") >= 1, 0.0).otherwise(t_p("t_stat", (F.col("n") - 2).cast("double")))
    return s.withColumn("p", p)


def mechanism_tests(panel: DataFrame, features: list[str], target: str, day: str = "session_date", least_rows: int = 30, least_panel: int = 200) -> DataFrame:
    """row_association with a status: SIGNAL_ONLY, as an association is no pass, or NOT_EVALUATED (and no p) for a panel of
    fewer than `least_panel` rows and for features that are constant or have fewer than `least_rows` rows. Every feature has
    a row."""
    a = row_association(panel, features, target, day, least_rows)
    size = panel.agg(F.count("*").alias("_rows"))
    every = panel.sparkSession.createDataFrame([(f,) for f in features], "feature string").crossJoin(F.broadcast(size)).join(a, "feature", "left")
    known = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    ok = (F.col("_rows") >= least_panel) & (known("n") >= least_rows) & (known("distinct") > 1)
    return every.select("feature", known("n").alias("n"), known("distinct").alias("distinct"), F.when(ok, F.col("rho")).alias("rho"), F.when(ok, F.col("p")).alias("p"), F.when(ok, "SIGNAL_ONLY").otherwise("NOT_EVALUATED").alias("status"))


def quantile_bank(panel: DataFrame, features: list[str], parts: int = 10) -> DataFrame:
    """Inner quantile cuts of all features: (feature, no, cut)."""
    fs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = stored(panel.select(F.explode(fs).alias("f")).select("f.feature", "f.x").filter("x is not null"), "long")
    cuts = exact_percentiles(long, ["feature"], "x", tuple(i / parts for i in range(1, parts)))
    return stored(cuts.select("feature", F.posexplode("q").alias("no", "cut")), "bank")


def split_scores(panel: DataFrame, bank: DataFrame, features: list[str], target: str, node: str | None = None, least: int = 5) -> DataFrame:
    """|mean left - mean right| of every cut. The bank (cuts by features, a few hundred rows) is carried as one array."""
    cuts = bank.groupBy("feature").agg(F.collect_list("cut").alias("cuts"))
    keys = [node] if node else []
    long = panel.filter(F.col(target).isNotNull()).select(*keys, F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f"))
    j = long.select(*keys, "y", "f.feature", "f.x").filter("x is not null").join(F.broadcast(cuts), "feature").select(*keys, "y", "feature", "x", F.explode("cuts").alias("cut"))
    left = F.col("x") <= F.col("cut")
    g = j.groupBy(*keys, "feature", "cut").agg(F.avg(F.when(left, F.col("y"))).alias("left_mean"), F.avg(F.when(~left, F.col("y"))).alias("right_mean"), F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))
    return g.filter((F.col("n_left") >= least) & (F.col("n_right") >= least)).withColumn("score", F.abs(F.col("left_mean") - F.col("right_mean")))


def gate(stats: DataFrame, floor: Column, least: int, top_share: float) -> DataFrame:
    """KILL, WATCH or PASS of each job by sample, concentration, sign and size, with the first reason that applies."""
    reason = (
        F.when(F.col("n") < least, "sample")
        .when(F.col("top_share") > top_share, "concentration")
        .when(F.col("mean") <= 0, "sign")
        .when(F.col("mean") < floor, "size")
    )
    return stats.withColumn("reason", reason).withColumn("decision", F.when(reason.isNull(), "PASS").when(reason == "size", "WATCH").otherwise("KILL"))


def hash_panel(days: DataFrame, day: str, salt: str, n: int) -> DataFrame:
    """n days by a salted hash, the same in every run."""
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.col(day).cast("string")), 256), 1, 8), 16, 10).cast("long") % 10007
    return days.withColumn("_h", key).withColumn("_k", F.row_number().over(Window.orderBy("_h", day))).filter(F.col("_k") <= n).select(day)


def chronological_split(days: DataFrame, day: str, warmup: int, shares=(0.4, 0.2, 0.4)) -> DataFrame:
    """D1, D2, D3 by share of the days after a warm-up."""
    d = days.withColumn("_i", F.row_number().over(Window.orderBy(day)) - warmup).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))) - warmup).filter("_i > 0")
    part = F.col("_i") / F.col("_n")
    return d.select(day, F.when(part <= shares[0], "D1").when(part <= shares[0] + shares[1], "D2").otherwise("D3").alias("split"))


def frame_hash(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: rows and the sum of row hashes over the columns by name, nulls as \\N."""
    said = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))


def falsify_panel(days: DataFrame, day: str, salt: str, n: int, used: list[DataFrame]) -> DataFrame:
    """n days by a salted hash of those that no other panel uses."""
    for other in used:
        days = days.join(other, day, "left_anti")
    return hash_panel(days, day, salt, n)


def calendar_buckets(returns: DataFrame, events: DataFrame, volume: str, x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Count and mean by year, by year and month, and by quartile of the events' dollar volume, in one job."""
    e = stored(events.select("event_id", F.col(volume).alias("_v")), "volumes")
    q = small(exact_percentiles(e, [], "_v", (0.25, 0.5, 0.75)))
    quartile = F.when(F.col("_v").isNull(), None).when(F.col("_v") <= F.col("q")[0], 1).when(F.col("_v") <= F.col("q")[1], 2).when(F.col("_v") <= F.col("q")[2], 3).otherwise(4)
    r = returns.select("event_id", day, x).join(e.crossJoin(F.broadcast(q)).select("event_id", quartile.alias("quartile")), "event_id")
    r = r.select(F.year(day).alias("year"), F.month(day).alias("month"), "quartile", x)
    return r.groupingSets([("year",), ("year", "month"), ("quartile",)], "year", "month", "quartile").agg(F.count("*").alias("n"), F.avg(x).alias("mean"))


def chart_means(returns: DataFrame, keys: list[str], most_days: int = 60, x: str = "forward_return", day: str = "session_date") -> DataFrame:
    """Count and mean by day, or by month where there are more than `most_days` days."""
    r = returns.filter(F.col(x).isNotNull()).groupBy(*keys, day).agg(F.count("*").alias("n"), F.sum(x).alias("_s"))
    many = r.agg((F.countDistinct(day) > most_days).alias("_many"))
    period = F.when(F.col("_many"), F.to_date(F.date_trunc("month", day))).otherwise(F.col(day))
    return r.crossJoin(F.broadcast(many)).groupBy(*keys, period.alias("period")).agg(F.sum("n").alias("n"), (F.sum("_s") / F.sum("n")).alias("mean"))
