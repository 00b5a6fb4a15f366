"""Lead/lag peer graph: weekly edges from past residuals, and what leaders tell about followers now."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import average_rank, small, stored, with_bh
from eventide.functions.tdist import t_p
from eventide.operators.grid import CLOCK


def history(panel: DataFrame, days: int = 20) -> DataFrame:
    """Rows of the last `days` trading dates strictly before each week's Monday, with as_of. A panel row falls into few
    weeks, so the fan-out is bounded by days / 5 + 1."""
    dates = panel.select("trading_date").distinct()
    weeks = dates.select(F.to_date(F.date_trunc("week", "trading_date")).alias("as_of")).distinct()
    pairs = weeks.join(dates, F.col("trading_date") < F.col("as_of"))
    last = Window.partitionBy("as_of").orderBy(F.desc("trading_date"))
    keep = pairs.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= days).drop("_k")
    return panel.join(keep, "trading_date")


#: Names of a block; pairs of blocks are correlated by matrix products, so nothing is joined row by row. A name's history
#: travels once a block of others; where all pairs are handed on, a task does so by strips of so many leaders.
BLOCK, STRIP = 1024, 64
PAIRS = "as_of date, leader_id string, follower_id string, corr double, n long, lag_corr double, lag_n long"
#: Listed pairs are correlated so many at a time, so that a run of them stays in a core's cache.
RUN = 128
#: Strengths are compared to so many digits, so that equal ones go by name and not by their last bits.
DIGITS = 12


def _correlations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise correlation of the rows of a and b over the columns that both have, and how many those are."""
    ma, mb = np.isfinite(a), np.isfinite(b)
    a, b = (np.where(m, x - np.nanmean(np.where(m, x, np.nan), axis=1, keepdims=True), 0.0) if x.size else x for x, m in ((a, ma), (b, mb)))
    ma, mb = ma.astype(float), mb.astype(float)
    n = ma @ mb.T
    sa, sb = a @ mb.T, ma @ b.T
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = (a * a) @ mb.T - sa * sa / n, ma @ (b * b).T - sb * sb / n
        r = (a @ b.T - sa * sb / n) / np.sqrt(va * vb)
        flat = (va <= 1e-12 * np.maximum(1e-300, (a * a) @ mb.T)) | (vb <= 1e-12 * np.maximum(1e-300, ma @ (b * b).T))
    return np.where(flat | ~np.isfinite(r), np.nan, np.clip(r, -1, 1)), n


def _of_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_correlations of row i of x with row j of y, for listed pairs only."""
    r, n = np.full(len(i), np.nan), np.zeros(len(i))
    x, y = (np.where(np.isfinite(z), z - np.nanmean(z, axis=1, keepdims=True), np.nan) for z in (x, y))
    for at in range(0, len(i), RUN):
        a, b = x[i[at : at + RUN]], y[j[at : at + RUN]]
        both = np.isfinite(a) & np.isfinite(b)
        a, b, m = np.where(both, a, 0.0), np.where(both, b, 0.0), both.sum(axis=1)
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        with np.errstate(divide="ignore", invalid="ignore"):
            aa, bb, sa, sb = dot(a, a), dot(b, b), a.sum(axis=1), b.sum(axis=1)
            va, vb = aa - sa * sa / m, bb - sb * sb / m
            c = (dot(a, b) - sa * sb / m) / np.sqrt(va * vb)
            flat = (va <= 1e-12 * np.maximum(1e-300, aa)) | (vb <= 1e-12 * np.maximum(1e-300, bb))
        r[at : at + RUN], n[at : at + RUN] = np.where(flat | ~np.isfinite(c), np.nan, np.clip(c, -1, 1)), m
    return r, n


def _block_pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame, peers: int | None = None, step_minutes: int = 60) -> Iterator[pd.DataFrame]:
    """Pairs of a block's names with another's, in both directions (of a block with itself: once), by strips of leaders; with
    `peers` only the strongest leaders of each follower, as only they can be among its strongest of all."""
    left, right = (rows.sort_values("instrument_id", ignore_index=True) for rows in (left, right))
    cells = np.unique(np.concatenate([*left["cells"], *right["cells"]]))

    def laid_out(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out, nexts = np.full((len(rows), len(cells)), np.nan), np.full((len(rows), len(cells)), np.nan)
        for i, (at, x) in enumerate(zip(rows["cells"], rows["xs"])):
            x, place = np.asarray(x, float), np.searchsorted(cells, at)
            out[i, place] = x
            near = (np.diff(at) <= step_minutes) & (at[1:] // 1440 == at[:-1] // 1440)
            nexts[i, place[:-1][near]] = x[1:][near]
        return out, nexts

    def pairs(i: np.ndarray, j: np.ndarray, lead: np.ndarray, follow: np.ndarray, r: np.ndarray, n: np.ndarray, lag_r: np.ndarray, lag_n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"as_of": pd.Series([key[0]] * len(i), dtype=object), "leader_id": lead[i], "follower_id": follow[j], "corr": r[i, j], "n": n[i, j].astype(int), "lag_corr": lag_r, "lag_n": lag_n.astype(int)})

    (x, x_next), (y, y_next) = laid_out(left), laid_out(right)
    names, others = left["instrument_id"].to_numpy(), right["instrument_id"].to_numpy()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # rows without a next step have no mean
        r, n = _correlations(x, y)
        for lead, follow, r, n, a, b, nexts in ((names, others, r, n, x, y, y_next), (others, names, r.T, n.T, y, x, x_next))[: 1 if key[1] == key[2] else 2]:
            if peers is None:
                lags, lag_ns = _correlations(a, nexts)
                for at in range(0, len(lead), STRIP):
                    i, j = np.nonzero((n[at : at + STRIP] > 0) & (lead[at : at + STRIP, None] != follow[None, :]))
                    i += at
                    yield pairs(i, j, lead, follow, r, n, lags[i, j], lag_ns[i, j])
            else:
                size = np.where(np.isfinite(r) & (lead[:, None] != follow[None, :]), np.round(np.abs(r), DIGITS), -1.0)
                i = np.argsort(-size, axis=0, kind="stable")[:peers]  # rows are in order of name
                j = np.broadcast_to(np.arange(len(follow)), i.shape)
                kept = size[i, j] >= 0
                i, j = i[kept], j[kept]
                yield pairs(i, j, lead, follow, r, n, *_of_pairs(a, nexts, i, j))


def _histories(hist: DataFrame, value: str) -> DataFrame:
    """as_of, instrument_id, cells, xs: a name's history of a week as one row, in order of time."""
    cell = F.unix_date("trading_date") * 1440 + F.col("minute_of_day")
    h = hist.filter(F.col(value).isNotNull()).select("as_of", "instrument_id", F.struct(cell.alias("cell"), F.col(value).cast("double").alias("x")).alias("c"))
    v = h.groupBy("as_of", "instrument_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return v.select("as_of", "instrument_id", F.transform("c", lambda s: s["cell"]).alias("cells"), F.transform("c", lambda s: s["x"]).alias("xs"))


def _paired(v: DataFrame, peers: int | None, step_minutes: int) -> DataFrame:
    blocks = max(1, -(-v.select("instrument_id").distinct().count() // BLOCK))
    own = F.pmod(F.xxhash64("instrument_id"), F.lit(blocks)).cast("int")
    keys = ["as_of", "a", "b"]
    side = lambda first, a, b: v.select("*", F.lit(first).alias("first"), a.alias("a"), b.alias("b"))
    # a block meets itself and later ones
    sides = side(True, own, F.explode(F.sequence(own, F.lit(blocks - 1)))).unionByName(side(False, F.explode(F.sequence(F.lit(0), own)), own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).to_pandas(date_as_object=True)  # two blocks of histories
        left, right = rows[rows["first"]], rows[~rows["first"]]
        if len(left) and len(right):
            for found in _block_pair(tuple(rows.iloc[0][keys]), left, right, peers, step_minutes):
                yield pa.RecordBatch.from_pandas(found, pa.schema([("as_of", pa.date32()), ("leader_id", pa.string()), ("follower_id", pa.string()), ("corr", pa.float64()), ("n", pa.int64()), ("lag_corr", pa.float64()), ("lag_n", pa.int64())]), preserve_index=False)

    # as many tasks as pairs of blocks ask for: small results would otherwise be computed in one
    tasks = max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, blocks * (blocks + 1) // 2))
    both = sides.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, PAIRS)
    return both.withColumn("corr", F.nanvl("corr", F.lit(None))).withColumn("lag_corr", F.nanvl("lag_corr", F.lit(None)))


def pair_statistics(hist: DataFrame, value: str = "resid", least: int = 40, step_minutes: int = 60) -> DataFrame:
    """Per as_of and ordered pair: correlation at the same clock, and of the leader with the follower's next step of the
    same day (at most step_minutes later), with counts. Names need `least` values; pairs without a common clock are left
    out.

    A name's history of a week is one row, as long as there are days and clocks; names are dealt to blocks, and each task
    correlates one block with another. Rows travel once a block, not once a pair. This gives all pairs: a graph needs
    `structural_pairs` only."""
    return _paired(stored(_histories(hist, value).filter(F.size("cells") >= least), "histories"), None, step_minutes)


def structural_pairs(hist: DataFrame, value: str = "resid", least: int = 40, step_minutes: int = 60, peers: int = 20, least_names: int = 3, least_clocks: int = 30) -> tuple[DataFrame, DataFrame]:
    """The `peers` leaders of each follower with the largest |corr|, with what pair_statistics tells of them; and of each week
    how many names, names with enough values, and clocks there were. Weeks with too few names or clocks have no pairs.

    A task hands on no more than `peers` leaders of each follower, whatever the number of names: what crosses the network
    grows with followers and blocks, never with pairs."""
    v = stored(_histories(hist, value), "histories")
    clocks = v.select("as_of", F.explode("cells").alias("cell")).distinct().groupBy("as_of").agg(F.count("*").alias("clocks"))
    weeks = stored(v.groupBy("as_of").agg(F.count("*").alias("names"), F.count_if(F.size("cells") >= least).alias("usable")).join(clocks, "as_of"), "weeks")
    fit = weeks.filter((F.col("names") >= least_names) & (F.col("clocks") >= least_clocks)).select("as_of")
    near = _paired(stored(v.filter(F.size("cells") >= least).join(small(fit), "as_of", "left_semi"), "histories"), peers, step_minutes)
    w = Window.partitionBy("as_of", "follower_id").orderBy(F.round(F.abs("corr"), DIGITS).desc(), "leader_id")
    return near.withColumn("peer_rank", F.row_number().over(w)).filter(F.col("peer_rank") <= peers), weeks


def lag_tests(pairs: DataFrame, least: int = 40, q: float = 0.10) -> DataFrame:
    """structural_pairs whose lagged correlation rests on `least` pairs of values, with t, p, and q_value over all tests of a
    week."""
    tested = pairs.filter((F.col("lag_n") >= least) & F.col("lag_corr").isNotNull() & (F.abs("lag_corr") < 1))
    tested = tested.withColumn("t", F.col("lag_corr") * F.sqrt((F.col("lag_n") - 2) / (1 - F.col("lag_corr") * F.col("lag_corr"))))
    return with_bh(tested.withColumn("p", t_p("t", (F.col("lag_n") - 2).cast("double"))), "p", ["as_of"], q, ["leader_id", "follower_id"])


def survivors(tests: DataFrame, q: float = 0.10) -> DataFrame:
    return tests.filter((F.col("q_value") <= q) & (F.col("lag_corr") > 0))


def edges(tests: DataFrame, leaders: int = 5, q: float = 0.10) -> DataFrame:
    """Of the tests that survive false discovery control with a positive correlation the strongest `leaders` a follower."""
    w = Window.partitionBy("as_of", "follower_id").orderBy(F.round("lag_corr", DIGITS).desc(), "leader_id")
    return survivors(tests, q).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= leaders)


def peer_features(grid: DataFrame, graph: DataFrame, value: str = "resid") -> DataFrame:
    """For each grid row what its leaders do at the same clock, from the graph of the row's own week: weighted shock and
    agreement (weights: share of a follower's edges), plain mean, breadth and median size, and the row's gaps to them.
    Names without leaders stay null, with count 0."""
    each = Window.partitionBy("as_of", "follower_id")
    w = F.try_divide(F.abs("lag_corr"), F.sum(F.abs("lag_corr")).over(each))
    e = graph.select("as_of", "leader_id", "follower_id", w.alias("w"))
    own = grid.withColumn("as_of", F.to_date(F.date_trunc("week", "trading_date")))
    lead = own.select("as_of", "trading_date", "minute_of_day", F.col("instrument_id").alias("leader_id"), F.col(value).alias("lx"))
    j = lead.join(e, ["as_of", "leader_id"]).filter("lx is not null")
    # a follower's few leaders are added up in order of name: equal leaders give equal sums, to the last bit and in any run
    met = j.groupBy("trading_date", "minute_of_day", F.col("follower_id").alias("instrument_id")).agg(F.array_sort(F.collect_list(F.struct("leader_id", "w", "lx"))).alias("_l"))
    added = lambda f: F.aggregate("_l", F.lit(0.0), lambda s, x: s + f(x))
    rises = lambda x: (x["lx"] > 0).cast("double")
    sizes, n = F.array_sort(F.transform("_l", lambda x: F.abs(x["lx"]))), F.size("_l")
    weighted = lambda f: F.when(F.exists("_l", lambda x: x["w"].isNotNull()), F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.coalesce(x["w"] * f(x), F.lit(0.0))))
    g = met.select(
        "trading_date", "minute_of_day", "instrument_id",
        weighted(lambda x: x["lx"]).alias("leader_shock"),
        weighted(rises).alias("leader_agreement"),
        (added(lambda x: x["lx"]) / n).alias("peer_return"),
        (added(rises) / n).alias("peer_breadth"),
        ((F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2).alias("peer_dispersion"),
    )
    counts = graph.groupBy("as_of", F.col("follower_id").alias("instrument_id")).agg(F.countDistinct("leader_id").alias("leader_count"))
    out = own.join(g, ["trading_date", "minute_of_day", "instrument_id"], "left").join(counts, ["as_of", "instrument_id"], "left")
    out = out.withColumn("leader_count", F.coalesce("leader_count", F.lit(0).cast("long"))).withColumn("peer_count", F.col("leader_count"))
    return out.select(
        "*",
        (F.col("leader_shock") - F.col(value)).alias("response_gap"),
        (F.col("peer_return") - F.col(value)).alias("peer_response_gap"),
        (average_rank("peer_return", CLOCK) - average_rank(value, CLOCK)).alias("peer_rank_gap"),
        (F.col("leader_count") > 0).alias("graph_available"),
    )


def lineage(weeks: DataFrame, pairs: DataFrame, tests: DataFrame, graph: DataFrame, q: float = 0.10) -> DataFrame:
    """What each week's graph was made from: names, usable ones, clocks, structural pairs, tests, survivors, edges, and the
    median |r| of survivors (null without one)."""
    count = lambda df, name: df.groupBy("as_of").agg(F.count("*").alias(name))
    alive = survivors(tests, q).groupBy("as_of").agg(F.count("*").alias("survivors"), F.percentile(F.abs("lag_corr"), F.lit(0.5)).alias("median_abs_r"))
    out = weeks.join(count(pairs, "structural"), "as_of", "left").join(count(tests, "tests"), "as_of", "left").join(alive, "as_of", "left").join(count(graph, "edges"), "as_of", "left")
    return out.select("as_of", "names", "usable", "clocks", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("structural", "tests", "survivors", "edges")], "median_abs_r")


def overlay_days(overlay: DataFrame, value: str, least: int = 50, near: float = 1e-12) -> DataFrame:
    """A row a day of what was joined to it: rows, rows with a graph, repeated keys, and for days with more than `least` rows
    with a graph whether the gap to the leaders is but the negative own value for most rows (the leaders then say nothing)
    and whether all leaders' shocks are one value. Counts only, so that no task holds a day."""
    has = F.col("graph_available")
    alias = F.abs(F.col("response_gap") + F.col(value)) < near
    d = overlay.groupBy("trading_date").agg(
        F.count("*").alias("rows"), F.count_if(has).alias("available"), (F.count("*") - F.countDistinct("instrument_id", "minute_of_day")).alias("repeated"),
        F.count(F.when(has, F.col("response_gap") + F.col(value))).alias("_gaps"), F.count_if(has & alias).alias("_same"),
        F.countDistinct(F.when(has, F.col("leader_shock"))).alias("_shocks"),
    )
    enough = F.col("available") > least
    return d.select("trading_date", "rows", "available", "repeated", (enough & (2 * F.col("_same") > F.col("_gaps"))).alias("aliased"), (enough & (F.col("_shocks") <= 1)).alias("constant"))


def overlay_checks(edges: DataFrame, hist: DataFrame) -> DataFrame:
    """Whether a graph is fit to be joined: edges, edges whose history reaches their own week, repeated edges, self-edges."""
    ends = hist.groupBy("as_of").agg(F.max("trading_date").alias("history_end"))
    e = edges.join(ends, "as_of").withColumn("_k", F.struct("as_of", "leader_id", "follower_id"))
    return e.agg(
        F.count("*").alias("edges"), F.count_if(F.col("history_end") >= F.col("as_of")).alias("late"), (F.count("*") - F.countDistinct("_k")).alias("repeated"), F.count_if(F.col("leader_id") == F.col("follower_id")).alias("own")
    )
