"""Mixing sources to target weights by hash-threshold histograms.

Every document hashes to 0 .. 2**60 - 1. Words are summed by source and leading hash bits; a running sum over these
buckets gives, for each nested budget of a source, the one bucket in which the budget ends. Only documents of such
boundary buckets are looked at again, with the next bits, until the bits are used up. The result is a threshold a
source and budget, and a document is in the sample if its hash is at most the threshold: no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import md5_unit, small, stored, words_count

HASH_BITS = 60
#: Bits looked at in each pass; four passes use up the hash.
STEP_BITS = 15
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often.
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with target.

    Sharing by weight with the excess of capped sources reshared ends at target = min(cap, level * weight) for the one
    level at which targets add up to all sizes. Sources in the order of cap / weight are capped up to some point; running
    sums find it. One row a source takes part, not one a document. Sources of size 0 get 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )
    ranked = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_no", F.row_number().over(ratio))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn(
            "_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
        )
    )
    # the first source in the order that the level leaves below its cap fixes the level
    open_here = F.when(F.col("_ratio") * F.col("_open") >= F.col("_left"), F.struct("_no", (F.col("_left") / F.col("_open")).alias("level")))
    level = F.min(open_here).over(everything)["level"]
    return ranked.withColumn("target", F.least("_cap", F.coalesce(level, F.col("_ratio")) * F.col("_weight"))).select(
        "source", "source_size", "target"
    )


def hash_thresholds(
    rows: DataFrame, budgets: DataFrame, key: str, weight: str = "weight", hash_: str = "hash", bits: int = HASH_BITS
) -> DataFrame:
    """Largest hash up to which the weights of a group stay within each of its budgets, the next value included if
    that comes nearer.

    rows(key, hash, weight); budgets(key, budget_no, budget), the key null-safe; gives budgets with `threshold` (-1:
    nothing taken) and `reached`, the weight at or below it. Budgets of a key are nested, as they share the hash."""
    left = budgets.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_below", F.lit(0.0))
    shift = bits
    while shift > 0:
        step = min(STEP_BITS, shift)
        bound = small(left.select(key, "_prefix").distinct())
        rows_here = rows.withColumn("_prefix", F.shiftright(hash_, shift)).withColumn(
            "_bucket", F.shiftright(hash_, shift - step)
        )
        rows_here = rows_here.alias("r").join(
            bound.alias("b"),
            F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("r._prefix") == F.col("b._prefix")),
            "left_semi",
        )
        if shift < bits:
            rows_here = stored(rows_here.select(key, hash_, weight, "_prefix", "_bucket"), "boundary")
            rows = rows_here.select(key, hash_, weight)
        histogram = rows_here.groupBy(key, "_prefix", "_bucket").agg(F.sum(weight).cast("double").alias("_w"))
        running = Window.partitionBy(key, "_prefix").orderBy("_bucket")
        histogram = histogram.withColumn("_upto", F.sum("_w").over(running)).withColumn(
            "_next", F.lead("_bucket").over(running)
        )
        joined = left.alias("l").join(
            histogram.alias("h"),
            F.col(f"l.{key}").eqNullSafe(F.col(f"h.{key}")) & (F.col("l._prefix") == F.col("h._prefix")),
            "left",
        )
        start = F.col("l._below") + F.coalesce(F.col("h._upto") - F.col("h._w"), F.lit(0.0))
        # the boundary bucket: the last that begins within the budget
        inside = F.when(F.coalesce(start <= F.col("budget"), F.lit(False)), F.struct(F.col("h._bucket"), start, F.col("h._w")))
        left = stored(
            joined.groupBy(F.col(f"l.{key}").alias(key), "budget_no", "budget")
            .agg(
                F.max(inside).alias("_m"),
                F.max("l._prefix").alias("_p"),
                F.max("l._below").alias("_b"),
            )
            .select(
                key,
                "budget_no",
                "budget",
                F.coalesce(F.col("_m").getField("_bucket"), F.shiftleft("_p", step)).alias("_prefix"),
                F.coalesce(F.col("_m").getField("col2"), F.col("_b")).alias("_below"),
                F.coalesce(F.col("_m").getField("_w"), F.lit(0.0)).alias("_last"),
            ),
            "threshold",
        )
        if shift > step:
            left = left.drop("_last")
        shift -= step
    nearer = F.col("_below") + F.col("_last") - F.col("budget") <= F.col("budget") - F.col("_below")
    return left.select(
        key,
        "budget_no",
        "budget",
        F.when(nearer & (F.col("_last") > 0), F.col("_prefix")).otherwise(F.col("_prefix") - 1).alias("threshold"),
        (F.col("_below") + F.when(nearer, F.col("_last")).otherwise(0.0)).alias("reached"),
    )


def plan_mix(sized: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS, shares=(1.0,)) -> DataFrame:
    """sized(source, hash, size) -> one row a source: source, source_size, target, and for each share of the target (an
    ascending tuple, the nested budgets) whole copies and the threshold of the partial one, as array `plan`."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, repeats), "targets")
    wanted = targets.select(
        "source", "source_size", "target", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("budget_no", "_share")
    ).withColumn("_want", F.col("target") * F.col("_share"))
    copies = F.least(
        F.lit(repeats), F.coalesce(F.floor(F.try_divide("_want", F.col("source_size"))), F.lit(0)).cast("int")
    )
    budgets = wanted.withColumn("copies", copies).withColumn(
        "budget", F.greatest(F.lit(0.0), F.col("_want") - F.col("copies") * F.col("source_size"))
    )
    # a whole number of copies leaves a budget of rounding error only
    budgets = budgets.withColumn("budget", F.when(F.col("copies") >= repeats, 0.0).otherwise(F.col("budget")))
    found = hash_thresholds(sized, budgets.select("source", "budget_no", "budget"), "source", weight="size")
    return (
        budgets.alias("b")
        .join(
            found.alias("f"),
            F.col("b.source").eqNullSafe(F.col("f.source")) & (F.col("b.budget_no") == F.col("f.budget_no")),
        )
        .groupBy(F.col("b.source").alias("source"), "source_size", "target")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("b.budget_no"), "copies", "threshold"))).alias("plan"))
    )


def with_size(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[Column]:
    """size and hash; rows without an id hash by their text, lest they all go together."""
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x01"), F.coalesce(F.col(text_col), F.lit(""))))
    return [words_count(text_col).alias("size"), md5_unit(named).alias("hash")]


def take(sized: DataFrame, plan: DataFrame, budget_no: int = 0) -> DataFrame:
    """Adds source_size, target, taken to rows that have source, hash, size."""
    plan = plan.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("plan")[budget_no].alias("_plan")
    )
    joined = sized.join(small(plan), F.col("source").eqNullSafe(F.col("_source")), "left")
    times = F.col("_plan.copies") + F.when(F.col("hash") <= F.col("_plan.threshold"), 1).otherwise(0)
    return joined.withColumn("taken", (F.col("size") * F.coalesce(times, F.lit(0))).cast("long")).drop("_source", "_plan")


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS, shares=(1.0,)) -> DataFrame:
    """documents(doc_id, source, text) -> doc_id, source, size, source_size, target, taken.

    size: words of the text (null or empty: 0). Sources in code point order, null last as a source of its own, weigh
    `weights` in turn. taken: size times the copies that the mix has of the document, at most `repeats`. Rows with equal
    doc_id, or without one and equal text, have equal hashes and are taken together. Very long texts
    count with all their words: one may be larger than a budget, and is then taken or left as a whole. An empty table gives
    no rows; other columns are ignored.
    The last share's budget is the one reported.
    """
    narrow = stored(docs.select("doc_id", "source", *with_size(docs)), "sizes")
    plan = plan_mix(narrow, weights, repeats, shares)
    return take(narrow, plan, len(shares) - 1).select("doc_id", "source", "size", "source_size", "target", "taken")
