"""Job tables: many event definitions as data, found, measured and judged in one pass over the features."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.core import first_per, stored, with_bh
from eventide.functions.tdist import t_p
from eventide.operators.rules import stage_reason
from eventide.operators.statistics import bootstrap, day_agreement, summary


@dataclass(frozen=True)
class Job:
    """One event definition: rows of the features on which `where` holds, on the side that `side` says (null: none). Entry is
    at the bar after, or with entry_next=False at the bar itself."""

    job_id: str
    family: str
    where: str
    side: str
    parent: str | None = None
    engine: str = "threshold"
    entry_next: bool = True


def opposite(job: Job, suffix: str) -> Job:
    """The same trigger on the other side, as a job of its own that names its parent."""
    flipped = f"case ({job.side}) when 'LONG' then 'SHORT' when 'SHORT' then 'LONG' end"
    return replace(job, job_id=f"{job.job_id}.{suffix}", side=flipped, parent=job.job_id)


def variants(job: Job, name: str, values: dict[str, str]) -> list[Job]:
    """A job a value of the placeholder {name} in its condition."""
    return [replace(job, job_id=f"{job.job_id}.{k}", where=job.where.replace("{" + name + "}", v), parent=job.job_id) for k, v in values.items()]


def job_table(spark, jobs: list[Job]) -> DataFrame:
    """The jobs as a table; a repeated id is an error."""
    if len({j.job_id for j in jobs}) < len(jobs):
        raise ValueError("job ids repeat")
    return spark.createDataFrame([(j.job_id, j.family, j.parent, j.engine) for j in jobs], "job_id string, family string, parent string, engine string")


def job_events(features: DataFrame, jobs: list[Job], bar_minutes: int) -> DataFrame:
    """Events of all jobs in one pass: a row of features is tested against every job, hits are exploded, and the first of
    each job, instrument and day stays. Only sides are laid out, in compiled code (a lambda over them would be interpreted,
    conditions included), and rows without a hit go no further."""
    hit = lambda j: F.when(F.expr(j.where), F.expr(j.side))
    rows = features.select("instrument_id", "session_date", "ts_utc", F.array(*map(hit, jobs)).alias("_sides"))
    rows = rows.select("instrument_id", "session_date", "ts_utc", F.posexplode("_sides").alias("_j", "side")).filter("side is not null")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_j"))
    rows = rows.select("instrument_id", "session_date", "ts_utc", of([j.job_id for j in jobs]).alias("job_id"), "side", of([j.entry_next for j in jobs]).alias("next"))
    rows = first_per(rows, ["job_id", "instrument_id", "session_date"], [F.col("ts_utc")])
    decided = F.col("ts_utc") + F.make_dt_interval(mins=F.lit(bar_minutes))
    event_id = F.concat_ws("-", "job_id", "instrument_id", F.date_format(decided, "yyyyMMddHHmm"))
    return rows.select("job_id", event_id.alias("event_id"), "instrument_id", "session_date", decided.alias("decision_ts"), F.when(F.col("next"), decided).otherwise(F.col("ts_utc")).alias("entry_ts"), "side")


def stage_summary(returns: DataFrame, primary: str) -> DataFrame:
    """returns(job_id, horizon, event_id, instrument_id, session_date, forward_return) -> a row a job and horizon: summary
    statistics, share of positive days, largest share of one name, and whether the horizon is the primary one."""
    keys = ["job_id", "horizon"]
    # read four times: the events behind it would be found anew each time
    r = stored(returns.filter("forward_return is not null").select(*keys, "event_id", "instrument_id", "session_date", "forward_return"), "stage")
    names = r.groupBy(*keys, "instrument_id").count().groupBy(*keys).agg((F.max("count") / F.sum("count")).alias("top_name_share"))
    days = day_agreement(r, keys).select(*keys, "positive_days", "mean_without_best_day")
    return summary(r, keys).join(names, keys).join(days, keys).withColumn("is_primary", F.col("horizon") == primary)


def primary_bootstrap(returns: DataFrame, primary: str, replicates: int, absolute: bool = False) -> DataFrame:
    """A row a job: mean of its returns on the primary horizon, day-block bootstrap bounds and p, and the share of days whose
    mean is above 0. With `absolute` sizes count instead of returns (jobs without a side). Other horizons aren't drawn."""
    x = F.abs("forward_return") if absolute else F.col("forward_return")
    r = stored(returns.filter((F.col("horizon") == primary) & F.col("forward_return").isNotNull()).select("job_id", "session_date", x.alias("forward_return")), "primary")
    means = r.groupBy("job_id").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean"))
    days = r.groupBy("job_id", "session_date").agg(F.avg("forward_return").alias("m")).groupBy("job_id").agg(F.avg((F.col("m") > 0).cast("double")).alias("positive_days"))
    return means.join(days, "job_id").join(bootstrap(r, ["job_id"], replicates), "job_id")


def with_p_values(stage: DataFrame, q: float = 0.10) -> DataFrame:
    """Adds p of the primary horizon's t statistic over days, and q values over all jobs of the stage; other horizons have
    none."""
    p = F.when(F.col("is_primary"), t_p("t_stat", (F.col("days") - 1).cast("double")))
    return with_bh(stage.withColumn("p", p).withColumn("_stage", F.lit(1)), "p", ["_stage"], q, ["job_id", "horizon"]).drop("_stage")


def judged(stage: DataFrame, floor: float, least: int, name_share: float, top_share: float) -> DataFrame:
    """KILL, WATCH or PASS of each job on its primary horizon, with the first reason that applies."""
    reason = reduce(
        lambda acc, x: acc.when(*x),
        [(F.col("top_name_share") > name_share, "one_name"), (F.col("top_share") > top_share, "outliers"), (F.col("mean") <= 0, "sign"), (F.col("mean_without_best_day") <= 0, "best_day"), (F.col("positive_days") < 0.5, "days"), (F.col("mean") < floor, "size")],
        F.when(F.col("n") < least, "sample"),
    )
    s = stage.filter("is_primary").withColumn("reason", reason)
    return s.withColumn("decision", F.when(F.col("reason").isNull(), "PASS").when(F.col("reason") == "size", "WATCH").otherwise("KILL"))


def inverted(events: DataFrame, stage: DataFrame, floor: float) -> DataFrame:
    """Events of the opposites of losing jobs: of each job whose primary mean is at most -2 * floor, on the other side, as
    <job>.opp."""
    losing = stage.filter(F.col("is_primary") & (F.col("mean") <= -2 * floor)).select("job_id")
    other = F.when(F.col("side") == "LONG", "SHORT").otherwise("LONG")
    return events.join(losing, "job_id", "left_semi").withColumn("side", other).withColumn("job_id", F.concat("job_id", F.lit(".opp")))


def redirected(stage: DataFrame, directions: DataFrame, least_name_days: int, least_days: int, name_share: float, least_mean: float | None = None) -> DataFrame:
    """Direction correction: a stage's stored statistics (job_id, mean, name_days, days, top_name_share) through the gate again,
    in the frozen direction of a variant (directions: job_id, direction of 1 or -1) instead of the long one that all were
    first judged by. The earlier decision and reason are kept beside the new ones; bars aren't scanned. Jobs without a
    frozen direction keep theirs."""
    gate = lambda direction: stage_reason(least_name_days, least_days, name_share, direction, least_mean)
    d = stage.join(F.broadcast(directions) if directions.limit(1_000_001).count() <= 1_000_000 else directions, "job_id", "left")
    d = d.withColumn("original_reason", gate(F.lit(1))).withColumn("_again", gate(F.col("direction")))
    d = d.withColumn("reason", F.when(F.col("direction").isNull(), F.col("original_reason")).otherwise(F.col("_again")))
    said = lambda c: F.when(F.col(c).isNull(), "PASS").otherwise("KILL")
    return d.select("job_id", "mean", F.col("direction").alias("frozen_direction"), "original_reason", said("original_reason").alias("original"), "reason", said("reason").alias("decision"))


def family_pairs(families: DataFrame) -> DataFrame:
    """families(id, hypothesis, policy, engine, direction, neighborhood, parent, derived_from, mechanism, context) -> id_a, id_b,
    relation: the first of these that holds of a pair, a's id being the lesser one. EXACT_DUPLICATE: one hypothesis and
    policy. PARAMETER_VARIANT: one engine and direction, a's parameters differ. DERIVED_OPPOSITE_DIRECTION: long and short of
    one engine and hypothesis. DERIVED: parent and child, or one experiment behind both. DIFFERENT_MECHANISM, and
    DIFFERENT_CONTEXT_SAME_MECHANISM, by taxonomy. Else RELATED_OR_UNCLEAR. The table has a row a family: a few dozen."""
    a, b = families.alias("a"), families.alias("b")
    j = a.join(b, F.col("a.id") < F.col("b.id"))
    A, B = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda c: F.coalesce(A(c) == B(c), F.lit(False))
    opposite_sides = ((A("direction") == "long") & (B("direction") == "short")) | ((A("direction") == "short") & (B("direction") == "long"))
    some = lambda c: F.size(F.coalesce(A(c), F.array().cast("array<string>"))) > 0
    kind = (
        F.when(same("hypothesis") & same("policy"), "EXACT_DUPLICATE")
        .when(same("engine") & (A("engine") != "unimplemented") & same("direction") & (F.coalesce(A("neighborhood"), F.lit("")) != "") & ~same("neighborhood"), "PARAMETER_VARIANT")
        .when(opposite_sides & same("engine") & A("hypothesis").eqNullSafe(B("hypothesis")), "DERIVED_OPPOSITE_DIRECTION")
        .when(F.coalesce(A("parent") == B("id"), F.lit(False)) | F.coalesce(B("parent") == A("id"), F.lit(False)), "DERIVED")
        .when(same("derived_from"), "DERIVED")
        .when(some("mechanism") & ~F.sort_array(A("mechanism")).eqNullSafe(F.sort_array(B("mechanism"))), "DIFFERENT_MECHANISM")
        .when(some("context") & ~F.coalesce(F.arrays_overlap(A("context"), B("context")), F.lit(False)), "DIFFERENT_CONTEXT_SAME_MECHANISM")
        .otherwise("RELATED_OR_UNCLEAR")
    )
    return j.select(A("id").alias("id_a"), B("id").alias("id_b"), kind.alias("relation"))


def shared_events(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs with `shared`, how many decisions (instrument and time) both jobs make. Decisions meet within their instrument and
    time only, where a job has one at most."""
    e = events.groupBy("instrument_id", "decision_ts").agg(F.array_sort(F.collect_set("job_id")).alias("_j")).filter(F.size("_j") > 1)
    e = e.select("_j", F.posexplode("_j").alias("_i", "id_a")).select("id_a", F.explode(F.slice("_j", F.col("_i") + 2, F.size("_j"))).alias("id_b"))
    return pairs.join(e.groupBy("id_a", "id_b").agg(F.count("*").alias("shared")), ["id_a", "id_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
