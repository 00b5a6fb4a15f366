"""Conditional-inference trees: features are tested before anything is cut, at every node of a level in one job, and all trees
of a forest of day samples together.

Days are the independent unit: each feature has one statistic a day, tested over days. All folds (which days a tree sees) go
through the jobs of one tree: a row says of each fold on which node it is, and is neither copied nor stored by fold. The
driver holds a row a fold and day, node, feature or cut, never rows of the panel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.core import correlation, small, stored, with_bh
from eventide.functions.tdist import t_p
from eventide.operators import rules as tables


@dataclass
class Rule:
    """A path of (feature, operator, cut) and what the training rows on it do."""

    path: list[tuple[str, str, float]]
    n: int
    mean: float
    log: list[str] = field(default_factory=list)

    @property
    def direction(self) -> str:
        return "LONG" if self.mean >= 0 else "SHORT"

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {c:.6f}" for f, op, c in self.path)


def holds(path: list[tuple[str, str, float]]) -> Column:
    """Whether a row lies on a path; unknown features never do."""
    out = F.lit(True)
    for f, op, c in path:
        x = F.col(f).cast("double")
        out = out & F.coalesce({">": x > c, "<=": x <= c, "==": x == c}[op], F.lit(False))
    return out


def binary_features(panel: DataFrame, features: list[str]) -> list[str]:
    """Features without other values than 0 and 1 (true and false)."""
    other = lambda f: F.count_if(~F.col(f).cast("double").isin(0.0, 1.0)).alias(f)
    row = panel.agg(*[other(f) for f in features]).first()
    return [f for f in features if row[f] == 0]


#: Rows a day for a rank correlation, rows a day and a side for a difference of means, and days for a test.
RANK_ROWS, SIDE_ROWS, LEAST_SIDE, LEAST_DAYS = 10, 20, 5, 8
#: Cuts need so many values, more than so many of them different.
CUT_VALUES, CUT_DISTINCT = 50, 4


def panel_rows(panel: DataFrame, features: list[str], target: str, **keys: str) -> DataFrame:
    """The keys under their new names, y, x: the features as one array of doubles, what isn't a number null; rows without a
    target are left out."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = panel.select(*[F.col(c).alias(k) for k, c in keys.items()], number(target).alias("y"), F.array(*map(number, features)).alias("x"))
    return rows.filter("y is not null")


def daily_statistics(rows: DataFrame, keys: list[str], numbers: list[int], flags: list[int]) -> DataFrame:
    """rows(keys, day, y, x) -> keys, day, f, s: for each feature number and day the rank correlation with the target (ten rows
    at least), or for flags the difference of the target's means (twenty rows, five a side)."""
    group = [*keys, "day", "f"]
    long = rows.select(*keys, "day", "y", F.posexplode("x").alias("f", "v")).filter("v is not null")
    of = lambda some: long.filter(F.col("f").isin(some)) if some else long.limit(0)
    rank = lambda c: F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2.0
    ranked = of(numbers).withColumn("rx", rank("v")).withColumn("ry", rank("y")).groupBy(*group).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("s"))
    one, zero = F.when(F.col("v") == 1, F.col("y")), F.when(F.col("v") == 0, F.col("y"))
    sides = of(flags).groupBy(*group).agg(F.count("*").alias("n"), F.count(one).alias("n1"), F.count(zero).alias("n0"), (F.avg(one) - F.avg(zero)).alias("s"))
    sides = sides.filter((F.col("n") >= SIDE_ROWS) & (F.least("n1", "n0") >= LEAST_SIDE))
    both = ranked.filter((F.col("n") >= RANK_ROWS) & ~F.isnan("s")).select(*group, "s").unionByName(sides.select(*group, "s"))
    return both.filter("s is not null")


def day_tests(daily: DataFrame, keys: list[str], nodes: DataFrame, n_features: int) -> DataFrame:
    """keys, f, days, t, p, q_value for every feature of every node (nodes: keys): t test of the daily statistics against 0;
    with fewer than eight days p is 1. q_value controls false discoveries within the node."""
    every = nodes.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("f"))
    stats = daily.groupBy(*keys, "f").agg(F.count("s").alias("days"), F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"))
    both = every.join(stats, [*keys, "f"], "left").withColumn("t", F.try_divide(F.col("m") * F.sqrt("days"), F.col("sd")))
    p = F.when((F.col("days") >= LEAST_DAYS) & F.col("t").isNotNull(), t_p("t", (F.col("days") - 1).cast("double")))
    tested = both.select(*keys, "f", F.coalesce("days", F.lit(0)).alias("days"), "t", F.coalesce(p, F.lit(1.0)).alias("p"))
    return with_bh(tested, "p", keys, 1.0, ["f"]).drop("rejected")


def associations(panel: DataFrame, features: list[str], binary: list[str], target: str, node: str = "_node", day: str = "session_date") -> DataFrame:
    """(node, feature, days, t, p, q_value): for each node and feature whether it has to do with the target, by day."""
    rows = panel_rows(panel, features, target, node=node, day=day)
    flags = [i for i, f in enumerate(features) if f in binary]
    daily = daily_statistics(rows, ["node"], [i for i in range(len(features)) if i not in flags], flags)
    names = F.array(*map(F.lit, features))
    return day_tests(daily, ["node"], rows.select("node").distinct(), len(features)).select(F.col("node").alias(node), F.get(names, F.col("f")).alias("feature"), "days", "t", "p", "q_value")


def welch(panel: DataFrame, flags: list[str], target: str, least_side: int = 10) -> DataFrame:
    """(feature, t, df, p): Welch's test of the target's means where a flag holds and where it doesn't, over rows."""
    fs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in flags])
    long = panel.select(F.col(target).cast("double").alias("y"), F.inline(fs)).filter("y is not null and not isnan(y) and v is not null")
    one, zero = F.when(F.col("v") == 1, F.col("y")), F.when(F.col("v") == 0, F.col("y"))
    g = long.groupBy("feature").agg(F.count(one).alias("n1"), F.avg(one).alias("m1"), F.var_samp(one).alias("v1"), F.count(zero).alias("n0"), F.avg(zero).alias("m0"), F.var_samp(zero).alias("v0"))
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    df = F.try_divide(F.pow(a + b, F.lit(2.0)), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n0") - 1))
    g = g.select("feature", F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), df.alias("df"), (F.least("n1", "n0") >= least_side).alias("_ok"))
    return g.select("feature", "t", "df", F.coalesce(F.when(F.col("_ok") & F.col("t").isNotNull() & (F.col("df") > 0), t_p("t", "df")), F.lit(1.0)).alias("p"))


def half_samples(days: DataFrame, day: str, folds: int, share: float = 0.5, seed: int = 7) -> DataFrame:
    """fold, day: in each fold exactly floor(share * n) of the n days (one at least), those with the least digests of (seed,
    fold, day): drawn without replacement, the same in every run."""
    d = days.select(F.col(day).alias("day")).distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("fold").cast("string"), F.col("day").cast("string")))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("fold").orderBy(digest))).withColumn("_n", F.count("*").over(Window.partitionBy("fold")))
    return d.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select("fold", "day")


class Nodes:
    """Which node of each fold a row is on. inside[day, fold]: whether the fold has the day; paths[fold]: of each node its steps
    (feature, above, cut). Nodes of a fold have no row in common, so that one code a fold says all; 0 is none."""

    def __init__(self, inside: np.ndarray, paths: list[list[list[tuple[int, bool, float]]]]):
        self.inside, self.paths = inside, paths
        self.most = max(map(len, paths), default=0)
        self.kind = np.min_scalar_type(self.most)

    def codes(self, d: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(d), len(self.paths)), self.kind)
        for j, paths in enumerate(self.paths):
            own = self.inside[d, j]
            for c, path in enumerate(paths, 1):
                on = own
                for f, above, cut in path:
                    on = on & ((x[:, f] > cut) if above else (x[:, f] <= cut))  # unknown values are on neither side
                out[on, j] = c
        return out


def _matrix(x: pa.Array) -> np.ndarray:
    """Arrays of doubles as rows of a matrix, null as NaN."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _bytes(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(a)])


def _unbytes(b: pa.Array, kind: np.dtype) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    _, offsets, data = b.buffers()
    at = np.frombuffer(offsets, np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(b), -1)


def _whole_values(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(day, feature, rows) of a stream sorted by day, feature and `by`: a piece has rows of one day and feature, and equal
    values are never parted. Held back are only the rows of the last value."""
    held: list[pa.RecordBatch] = []

    def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            d, f = b.column("d").to_numpy(), b.column("f").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
            for i, k in zip(at, [*at[1:], b.num_rows]):
                yield int(d[i]), int(f[i]), b.slice(int(i), int(k - i))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("d", "f", by)]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (held and any(k[0] != held[-1].column(c)[0].as_py() for k, c in zip(key, ("d", "f", by)))):
            if last:
                held.append(batch.slice(0, last))
            yield from pieces()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from pieces()


def _doubled_ranks(sorted_values: np.ndarray, before: int) -> np.ndarray:
    """Twice the average ranks (from 1) of sorted values after `before` smaller ones."""
    n = len(sorted_values)
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    end = np.append(at[1:], n)
    return np.repeat(at + end + 1 + 2 * before, end - at)


def rank_statistics(rows: DataFrame, nodes: Nodes, numbers: list[int]) -> DataFrame:
    """rows(d, y, x) -> j, c, d, f, s: for each fold number, node code, feature number and day the rank correlation with the
    target (ten rows at least).

    A row travels once a feature, whatever the number of folds. Rows of a day and feature are sorted by the target and
    ranked in all nodes at once, then sorted in place by the feature and ranked again, while the products are summed: no
    task holds a day."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(nodes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, y, x = b.column("d").to_numpy(), b.column("y").to_numpy(), _matrix(b.column("x"))
            codes = sent.value.codes(d, x)
            on = codes.any(axis=1)
            for f in numbers:
                at = np.flatnonzero(on & ~np.isnan(x[:, f]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(np.full(len(at), f, np.int32)), pa.array(x[at, f]), pa.array(y[at]), _bytes(codes[at])], names=["d", "f", "v", "y", "codes"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, group, before = sent.value, None, None
        for d, f, b in _whole_values(batches, "y"):
            if (d, f) != group:
                group, before = (d, f), np.zeros((len(n.paths), n.most + 1), np.int64)
            own, y = np.flatnonzero(n.inside[d]), b.column("y").to_numpy()
            codes = _unbytes(b.column("codes"), n.kind)[:, own]
            ranks = np.zeros(codes.shape, np.int64)
            for k, j in enumerate(own):
                for c in range(1, len(n.paths[j]) + 1):
                    at = np.flatnonzero(codes[:, k] == c)
                    if len(at):
                        ranks[at, k] = _doubled_ranks(y[at], before[j, c])
                        before[j, c] += len(at)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("f"), b.column("v"), _bytes(codes), _bytes(ranks)], names=["d", "f", "v", "codes", "ranks"])

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, group = sent.value, None
        # of each node the rows so far, its first ranks, and sums of what ranks are beyond these
        seen, first, sums = (np.zeros((len(n.paths), n.most + 1, *k), t) for k, t in (((), np.int64), ((2,), float), ((5,), float)))

        def out() -> pa.RecordBatch:
            j, c = np.nonzero(seen >= RANK_ROWS)
            m, (x, y, xx, yy, xy) = seen[j, c], sums[j, c].T
            spread = np.maximum(xx - x * x / m, 0.0) * np.maximum(yy - y * y / m, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(spread > 0, (xy - x * y / m) / np.sqrt(spread), np.nan)
            columns = [pa.array(k.astype(np.int32)) for k in (j, c, np.full(len(j), group[0]), np.full(len(j), group[1]))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(s)], names=["j", "c", "d", "f", "s"])

        for d, f, b in _whole_values(batches, "v"):
            if (d, f) != group:
                if group:
                    yield out()
                group = d, f
                for a in (seen, first, sums):
                    a[:] = 0
            own, v = np.flatnonzero(n.inside[d]), b.column("v").to_numpy()
            codes, ranks = _unbytes(b.column("codes"), n.kind), _unbytes(b.column("ranks"), np.int64)
            for k, j in enumerate(own):
                for c in range(1, len(n.paths[j]) + 1):
                    at = np.flatnonzero(codes[:, k] == c)
                    if len(at):
                        x, y = _doubled_ranks(v[at], seen[j, c]).astype(float), ranks[at, k].astype(float)
                        if not seen[j, c]:
                            first[j, c] = x[0], y[0]
                        x, y = x - first[j, c, 0], y - first[j, c, 1]
                        seen[j, c] += len(at)
                        sums[j, c] += x.sum(), y.sum(), x @ x, y @ y, x @ y
        if group:
            yield out()

    long = rows.select("d", "y", "x").mapInArrow(coded, "d int, f int, v double, y double, codes binary")
    dealt = long.repartition(4 * sc.defaultParallelism, "d", "f").sortWithinPartitions("d", "f", "y")
    both = dealt.mapInArrow(ranked, "d int, f int, v double, codes binary, ranks binary").sortWithinPartitions("d", "f", "v")
    return both.mapInArrow(correlated, "j int, c int, d int, f int, s double").filter("not isnan(s)")


def side_statistics(rows: DataFrame, nodes: Nodes, flags: list[int]) -> DataFrame:
    """rows(d, y, x) -> j, c, d, f, s as in rank_statistics, for flags the difference of the target's means (twenty rows, five a
    side). Tasks hand on sums by fold, node and day."""
    sent = rows.sparkSession.sparkContext.broadcast(nodes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sent.value
        shape = (len(n.paths), len(flags), (n.most + 1) * len(n.inside))
        sums = np.zeros((4, *shape))
        for b in batches:
            d, y, x = b.column("d").to_numpy(), b.column("y").to_numpy(), _matrix(b.column("x"))
            codes = n.codes(d, x)
            for j in range(len(n.paths)):
                place = codes[:, j].astype(np.int64) * len(n.inside) + d
                for k, f in enumerate(flags):
                    for i, side in enumerate((1.0, 0.0)):
                        at = x[:, f] == side
                        sums[2 * i, j, k] += np.bincount(place[at], minlength=shape[2])
                        sums[2 * i + 1, j, k] += np.bincount(place[at], weights=y[at], minlength=shape[2])
        j, k, place = np.nonzero(sums[0] + sums[2])
        of = lambda a, t: pa.array(a.astype(t))
        some = sums[:, j, k, place]
        yield pa.RecordBatch.from_arrays(
            [of(j, np.int32), of(place // len(n.inside), np.int32), of(np.array(flags)[k], np.int32), of(place % len(n.inside), np.int32), of(some[0], np.int64), of(some[1], float), of(some[2], np.int64), of(some[3], float)],
            names=["j", "c", "f", "d", "n1", "s1", "n0", "s0"],
        )

    parts = rows.select("d", "y", "x").mapInArrow(summed, "j int, c int, f int, d int, n1 long, s1 double, n0 long, s0 double")
    g = parts.filter("c > 0").groupBy("j", "c", "f", "d").agg(*[F.sum(k).alias(k) for k in ("n1", "s1", "n0", "s0")])
    g = g.filter((F.col("n1") + F.col("n0") >= SIDE_ROWS) & (F.least("n1", "n0") >= LEAST_SIDE))
    return g.select("j", "c", "d", "f", (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("s"))


def split_sums(rows: DataFrame, nodes: Nodes, asked: list[tuple[int, int, int, list[float]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each (fold number, node code, feature, cuts) the rows of the node and the sum of their target between its cuts: below
    the first (itself included), up to the second and so on. Rows without the feature are left out."""
    sent = rows.sparkSession.sparkContext.broadcast((nodes, asked))
    width = max(len(cuts) for *_, cuts in asked) + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asked = sent.value
        count, total = np.zeros((len(asked), width), np.int64), np.zeros((len(asked), width))
        for b in batches:
            y, x = b.column("y").to_numpy(), _matrix(b.column("x"))
            codes = n.codes(b.column("d").to_numpy(), x)
            for i, (j, c, f, cuts) in enumerate(asked):
                at = np.flatnonzero((codes[:, j] == c) & ~np.isnan(x[:, f]))
                place = np.searchsorted(cuts, x[at, f], side="left")  # so many cuts are smaller
                count[i] += np.bincount(place, minlength=width)
                total[i] += np.bincount(place, weights=y[at], minlength=width)
        i, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(count[i, k]), pa.array(total[i, k])], names=["i", "k", "n", "s"])

    count, total = np.zeros((len(asked), width), np.int64), np.zeros((len(asked), width))
    parts = rows.select("d", "y", "x").mapInArrow(summed, "i int, k int, n long, s double")
    for r in parts.groupBy("i", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        count[r.i, r.k], total[r.i, r.k] = r.n, r.s
    return list(zip(count, total))


#: Nodes whose membership fits a long.
BITS = 62


def name_days(rows: DataFrame, nodes: Nodes) -> dict[tuple[int, int], int]:
    """(fold number, node code) -> how many pairs of name and day have a row on the node; rows(name, d, x)."""
    every = [(j, c) for j, paths in enumerate(nodes.paths) for c in range(1, len(paths) + 1)]
    if not every:
        return {}
    sent = rows.sparkSession.sparkContext.broadcast(nodes)
    longs = [f"b{i}" for i in range(-(-len(every) // BITS))]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("d").to_numpy()
            codes = sent.value.codes(d, _matrix(b.column("x")))
            out = np.zeros((len(longs), len(d)), np.int64)
            for i, (j, c) in enumerate(every):
                out[i // BITS] |= (codes[:, j] == c).astype(np.int64) << (i % BITS)
            at = np.flatnonzero(out.any(axis=0))
            yield pa.RecordBatch.from_arrays([b.column("name").take(pa.array(at)), pa.array(d[at]), *[pa.array(x[at]) for x in out]], names=["name", "d", *longs])

    schema = T.StructType([T.StructField("name", rows.schema["name"].dataType), T.StructField("d", T.IntegerType()), *[T.StructField(b, T.LongType()) for b in longs]])
    pairs = rows.select("name", "d", "x").mapInArrow(bits, schema).groupBy("name", "d").agg(*[F.bit_or(b).alias(b) for b in longs])
    row = pairs.agg(*[F.sum(F.getbit(longs[i // BITS], F.lit(i % BITS)).cast("long")) for i in range(len(every))]).first()
    return {k: n or 0 for k, n in zip(every, row)}


def by_day_number(folds: DataFrame) -> DataFrame:
    """folds(fold, day) with d, the day's place among all days of folds; in the shared folder."""
    return stored(folds.select("fold", "day", (F.dense_rank().over(Window.orderBy("day")) - 1).cast("int").alias("d")), "folds")


#: Values are dealt to so many bins before cuts are looked for.
BINS = 1000


def fold_cuts(rows: DataFrame, folds: DataFrame, numbers: list[int], parts: int = 10) -> DataFrame:
    """fold, f, cut: the inner quantiles, interpolated, of every feature over each fold's days.

    Values are counted by day, feature and bin; sums of these rows tell in which bin of a fold a quantile lies and at which
    place of it. Only different values in such bins, a few of a thousand, meet the folds and are ranked."""
    if "d" not in folds.columns:
        folds = by_day_number(folds)
    long = rows.select(F.posexplode("x").alias("f", "v")).filter(F.col("v").isNotNull() & F.col("f").isin(numbers))
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = long.groupBy("f").agg(F.percentile_approx("v", steps, F.lit(10_000)).alias("edges"), F.approx_count_distinct("v").alias("distinct"))
    edges = {r.f: np.unique(r.edges) for r in found.filter(F.col("distinct") > CUT_DISTINCT).collect()}
    numbered = rows.join(F.broadcast(folds.select("day", "d").distinct()), "day").select("d", "x")
    sent = rows.sparkSession.sparkContext.broadcast((edges, None))

    def binned(said) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, near = said.value
            for b in batches:
                d, x = b.column("d").to_numpy(), _matrix(b.column("x"))
                for f, e in edges.items():
                    at = np.flatnonzero(~np.isnan(x[:, f]))
                    k = np.searchsorted(e, x[at, f]).astype(np.int32)
                    if near is not None:
                        at, k = at[near[f][k]], k[near[f][k]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(np.full(len(at), f, np.int32)), pa.array(k), pa.array(x[at, f])], names=["d", "f", "bin", "v"])

        return run

    schema = "d int, f int, bin int, v double"
    counts = numbered.mapInArrow(binned(sent), schema).groupBy("d", "f", "bin").agg(F.count("*").alias("c")).join(F.broadcast(folds.select("fold", "d")), "d").groupBy("fold", "f", "bin").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("fold", "f").orderBy("bin")
    counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("fold", "f"))).filter(F.col("n") >= CUT_VALUES)
    # the places of the values below and above each quantile, with their weights
    places = []
    for i in range(1, parts):
        at = F.lit(i / parts) * (F.col("n") - 1)
        part = at - F.floor(at)
        places += [F.struct(F.lit(i).alias("no"), (F.floor(at) + k).alias("place"), (part if k else 1 - part).alias("weight")) for k in (0, 1)]
    wanted = counts.select("fold", "f", "bin", "before", "c", F.inline(F.array(*places))).filter("weight > 0 and place >= before and place < before + c")
    wanted = stored(wanted.select("fold", "f", "bin", "no", (F.col("place") - F.col("before")).alias("place"), "weight"), "places")
    bins = wanted.select("f", "bin").distinct().collect()  # a row a feature and bin at most
    near = {f: np.isin(np.arange(len(e) + 1), [r.bin for r in bins if r.f == f]) for f, e in edges.items()}
    asked = rows.sparkSession.sparkContext.broadcast((edges, near))
    # equal values are one row, so that a frequent one is no load
    meets = numbered.mapInArrow(binned(asked), schema).groupBy("d", "f", "bin", "v").agg(F.count("*").alias("c")).join(F.broadcast(folds.select("fold", "d")), "d")
    meets = meets.join(F.broadcast(wanted.select("fold", "f", "bin").distinct()), ["fold", "f", "bin"], "left_semi").groupBy("fold", "f", "bin", "v").agg(F.sum("c").alias("c"))
    ranked = meets.withColumn("upto", F.sum("c").over(Window.partitionBy("fold", "f", "bin").orderBy("v")))
    own = ranked.join(F.broadcast(wanted), ["fold", "f", "bin"]).filter("place >= upto - c and place < upto")
    return own.groupBy("fold", "f", "no").agg(F.sum(F.col("weight") * F.col("v")).alias("cut")).select("fold", "f", "cut").distinct()


@dataclass
class _Node:
    path: list[tuple[str, str, float]]
    steps: list[tuple[int, bool, float]]
    n: int
    name_days: int
    mean: float
    parent_n: int


def _ints(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A table of numbers that is part of the plan."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int32()) for i, c in enumerate(names)}))


def _best_cut(cuts: list[float], n: np.ndarray, s: np.ndarray, least: int, parent_share: float, parent: int) -> tuple[float, list[tuple[bool, int, float]]] | None:
    """The cut with the largest difference of means (the smallest of equal ones), and of both its sides whether above, rows and
    mean."""
    found = []
    for i, cut in enumerate(cuts):
        a, b = int(n[i + 1 :].sum()), int(n[: i + 1].sum())
        if min(a, b) >= max(5, 0.15 * least) and max(a, b) >= parent_share * max(1, parent):
            above, below = s[i + 1 :].sum() / a, s[: i + 1].sum() / b
            found.append((-round(abs(above - below), 12), cut, [(True, a, float(above)), (False, b, float(below))]))
    return min(found)[1:] if found else None


def forest(
    panel: DataFrame, folds: DataFrame, features: list[str], target: str, depth: int = 3, alpha: float = 0.05, least: int = 50, parent_share: float = 0.0, parts: int = 10, name: str = "instrument_id", day: str = "session_date",
) -> dict[int, list[Rule]]:
    """folds(fold, day) -> the leaves of each fold's tree as rules, in the order of their paths.

    A node is split if it has `least` name-days and its best feature's q_value is at most alpha (ties: the earlier feature),
    at the cut of that feature (quantiles of the fold's days; true for binary ones) with the largest difference of means.
    Both sides need 0.15 * least rows and five, one of them parent_share of the rows of the node's parent. A tree that never
    splits has no rules. Daily statistics of the root are shared by all folds; a level reads the panel three times, for all
    folds at once."""
    binary = binary_features(panel, features)
    flags = [i for i, f in enumerate(features) if f in binary]
    numbers = [i for i in range(len(features)) if i not in flags]
    spark, keys = panel.sparkSession, ["j", "c"]
    whole, folds = stored(panel_rows(panel, features, target, name=name, day=day), "panel"), by_day_number(folds)
    rows = whole.join(F.broadcast(folds.select("day", "d").distinct()), "day").select("name", "d", "y", "x")
    by_day = {r.d: r for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.countDistinct("name").alias("k")).collect()}
    days_of: dict[int, list[int]] = {}
    for r in folds.select("fold", "d").collect():
        if r.d in by_day:
            days_of.setdefault(r.fold, []).append(r.d)
    ids = sorted(days_of)
    inside = np.zeros((max(by_day, default=0) + 1, len(ids)), bool)
    level: dict[tuple[int, str], _Node] = {}
    for j, fold in enumerate(ids):
        inside[days_of[fold], j] = True
        n, s, k = (sum(by_day[d][c] for d in sorted(days_of[fold])) for c in ("n", "s", "k"))
        level[j, ""] = _Node([], [], n, k, s / n, n)
    nodes, split_at, bank = dict(level), set(), None
    for depth_now in range(depth):
        tried = sorted(k for k, v in level.items() if v.name_days >= least)
        if not tried:
            break
        of_fold = [[node for i, node in tried if i == j] for j in range(len(ids))]
        at = Nodes(inside, [[level[j, node].steps for node in own] for j, own in enumerate(of_fold)])
        code = {(j, node): c for j, own in enumerate(of_fold) for c, node in enumerate(own, 1)}
        # the root is the same in all folds but for their days
        asked = at if depth_now else Nodes(np.ones((len(inside), 1), bool), [[[]]])
        daily = [f(rows, asked, some) for f, some in ((rank_statistics, numbers), (side_statistics, flags)) if some]
        daily = daily[0].unionByName(daily[1]) if len(daily) > 1 else daily[0]
        if not depth_now:
            own = _ints(spark, [(j, int(d)) for j, _ in tried for d in np.flatnonzero(inside[:, j])], "j", "d")
            daily = daily.drop("j").join(F.broadcast(own), "d")
        some = _ints(spark, [(j, code[j, node]) for j, node in tried], "j", "c")
        best = Window.partitionBy(*keys).orderBy("q_value", "f")
        tests = day_tests(daily, keys, some, len(features)).withColumn("_k", F.row_number().over(best)).filter((F.col("_k") == 1) & (F.col("q_value") <= alpha))
        feature_of = {(r.j, of_fold[r.j][r.c - 1]): r.f for r in tests.select("j", "c", "f").collect()}
        if bank is None and any(f in numbers for f in feature_of.values()):
            bank = {}
            for r in fold_cuts(whole, folds, numbers, parts).collect():
                bank.setdefault((r.fold, r.f), set()).add(r.cut)
        cuts = {k: [0.5] if f in flags else sorted(bank.get((ids[k[0]], f), [])) for k, f in feature_of.items()}
        chosen = sorted(k for k in cuts if cuts[k])
        splits = {}
        if chosen:
            for k, (n, s) in zip(chosen, split_sums(rows, at, [(k[0], code[k], feature_of[k], cuts[k]) for k in chosen])):
                cut = _best_cut(cuts[k], n, s, least, parent_share, level[k].parent_n)
                if cut:
                    splits[k] = cut
        split_at |= set(splits)
        following = {}
        for (j, node), (cut, sides) in splits.items():
            up, f = level[j, node], feature_of[j, node]
            for above, n, mean in sides:
                step = (features[f], "==", 1.0 if above else 0.0) if f in flags else (features[f], ">" if above else "<=", cut)
                following[j, node + ("L" if above else "R")] = _Node([*up.path, step], [*up.steps, (f, above, cut)], n, 0, mean, up.n)
        # how many name-days a node has is asked only where it may be split
        large = sorted(k for k, v in following.items() if v.n >= least) if depth_now + 1 < depth else []
        paths = [[k for k in large if k[0] == j] for j in range(len(ids))]
        for (j, c), k in name_days(rows, Nodes(inside, [[following[k].steps for k in own] for own in paths])).items():
            following[paths[j][c - 1]].name_days = k
        nodes |= following
        level = following
    leaves: dict[int, list[Rule]] = {fold: [] for fold in ids}
    for (j, node), v in nodes.items():
        if v.path and (j, node) not in split_at:
            leaves[ids[j]].append(Rule(v.path, v.n, v.mean))
    return {k: sorted(v, key=str) for k, v in leaves.items()}


def grow(panel: DataFrame, features: list[str], target: str, depth: int = 3, alpha: float = 0.05, least: int = 50, parent_share: float = 0.0, parts: int = 10, day: str = "session_date", name: str = "instrument_id") -> list[Rule]:
    """The leaves of one tree over all days."""
    days = panel.select(F.lit(0).alias("fold"), F.col(day).alias("day")).distinct()
    return forest(panel, days, features, target, depth, alpha, least, parent_share, parts, name, day).get(0, [])


def estimates(panel: DataFrame, paths: list[list[tuple[str, str, float]]], target: str, name: str = "instrument_id", day: str = "session_date") -> list[dict]:
    """What tables.estimated says of the rows on each path, all paths in one pass; None for a path without rows."""
    got = {int(r.rule): r.asDict() for r in tables.estimated(panel, {str(i): holds(p) for i, p in enumerate(paths)}, target, name=name, day=day).collect()}
    return [got.get(i) for i in range(len(paths))]


def simplified(panel: DataFrame, rules: list[Rule], target: str, least: int = 0, least_days: int = 0, least_names: int = 0, name_share: float = 1.0) -> list[Rule]:
    """Parsimony on fresh rows: as long as a rule without one of its conditions is as good as the best variant to within
    that one's standard error (over day means), with the same sign, the shortest (then largest mean) is taken. Variants with
    too few name-days, days or names, or with too large a share of one name, don't count; all rules' variants of a round go
    through one aggregate."""
    done, open_ = {}, dict(enumerate(rules))
    while open_:
        asked = {i: [[c for j, c in enumerate(r.path) if j != k] for k in range(len(r.path))] * (len(r.path) > 1) + [r.path] for i, r in open_.items()}
        flat = [(i, path) for i, paths in asked.items() for path in paths]
        found = list(zip(flat, estimates(panel, [p for _, p in flat], target)))
        following = {}
        for i, r in open_.items():
            own = [(p, e) for (k, p), e in found if k == i and e and e["name_days"] >= least and e["days"] >= least_days and e["names"] >= least_names and e["top_name_share"] <= name_share]
            pick = None
            if own and len(r.path) > 1:
                _, best = max(own, key=lambda x: abs(x[1]["mean"]))
                good = [(p, e) for p, e in own if abs(e["mean"]) + 1e-12 >= abs(best["mean"]) - (best["se"] or 0.0) and (e["mean"] > 0) == (best["mean"] > 0) and len(p) < len(r.path)]
                pick = min(good, key=lambda x: (len(x[0]), -abs(x[1]["mean"])), default=None)
            if pick is None:
                done[i] = r
            else:
                following[i] = Rule(pick[0], pick[1]["n"], pick[1]["mean"], [*r.log, f"dropped to {len(pick[0])}"])
        open_ = following
    return [done[i] for i in range(len(rules))]


def places(panel: DataFrame, folds: DataFrame, pairs: list[tuple[str, float]], day: str) -> dict[tuple[int, str, float], float]:
    """(fold, feature, value) -> share of the fold's values at or below it, from counts by day."""
    if not pairs:
        return {}
    names = sorted({f for f, _ in pairs})
    asked = F.create_map(*[x for f in names for x in (F.lit(f), F.array(*[F.lit(float(c)) for g, c in sorted(set(pairs)) if g == f]))])
    long = panel.select(F.col(day).alias("day"), F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in names]))).filter("v is not null and not isnan(v)")
    counts = long.select("day", "f", "v", F.explode(asked[F.col("f")]).alias("c")).groupBy("day", "f", "c").agg(F.count_if(F.col("v") <= F.col("c")).alias("below"), F.count("*").alias("n"))
    shares = counts.join(small(folds), "day").groupBy("fold", "f", "c").agg((F.sum("below") / F.sum("n")).alias("share")).collect()
    return {(r.fold, r.f, r.c): r.share for r in shares}


def path_stability(
    panel: DataFrame, rules: list[Rule], features: list[str], target: str, draws: int, least_found: float = 0.5, least_agreed: float = 0.8, near: float = 0.10, day: str = "session_date", seed: int = 7, **tree,
) -> list[dict]:
    """Of each rule the share of trees, each grown on half of the days, that have a rule with the same features and operators
    from the root on, every cut within `near` of the same place among the fold's values, and of these the share with the
    same direction. A rule counts as settled at the fold from which on it can reach neither share any more; what comes after
    isn't counted. `features` of the first row: how many trees use each feature."""
    folds = stored(half_samples(panel.select(day), day, draws, seed=seed), "folds")
    grown = forest(panel, folds, features, target, day=day, **tree)
    steps = lambda r: [(f, op) for f, op, _ in r.path]
    like = {(i, k): [g for g in grown.get(k, []) if steps(g) == steps(r)] for i, r in enumerate(rules) for k in range(draws)}
    numeric = lambda r: [(f, c) for f, op, c in r.path if op != "=="]
    at = places(panel, folds, [p for (i, _), own in like.items() if own for g in [rules[i], *own] for p in numeric(g)], day)

    def close(k: int, one: Rule, other: Rule) -> bool:
        for (f, op, a), (_, _, b) in zip(one.path, other.path):
            if op == "==":
                if a != b:
                    return False
            elif abs(at.get((k, f, a), float("inf")) - at.get((k, f, b), 0.0)) > near:
                return False
        return True

    used = {f: sum(any(f == g for r in own for g, _, _ in r.path) for own in grown.values()) for f in features}
    out = []
    for i, r in enumerate(rules):
        hits = same = 0
        settled = None
        for k in range(draws):
            own = [g for g in like[i, k] if close(k, r, g)]
            hits += bool(own)
            same += any(g.direction == r.direction for g in own)
            rest = draws - k - 1
            if hits + rest < least_found * draws - 1e-9 or (hits and (same + rest) / (hits + rest) < least_agreed - 1e-12):
                settled = k + 1
                break
        stable = settled is None and hits / draws >= least_found - 1e-12 and hits > 0 and same / hits >= least_agreed - 1e-12
        out.append({"rule": str(r), "found": hits / draws, "agreed": same / hits if hits else None, "settled": settled or draws, "stable": stable, "features": used})
    return out
