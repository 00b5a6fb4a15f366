"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over 2**20 places; a second one, read from the place onwards, gives all signature
coordinates at once: coordinate k is the least value at place + k. A shingle's coordinates thus lie side by side in one
array. Bands of five or six coordinates propose candidates; links count only if the full shingle sets pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_bytes, packed, small, space_words, stored

SHINGLE = 5
PERCENT = 85
#: A pair at the wanted similarity shares no band with this probability at most.
MISSED = 2e-6
PLACES_LOG2 = 20
#: Bits of the sketch by which a proposed pair is ruled out before its sets are fetched. At 0.85 about 77 +- 8.4 bits
#: differ; a pair goes at 5 such deviations more, a true link with probability 3e-7, below MISSED. Without deviations
#: (None) every proposed pair is verified.
SKETCH, DEVIATIONS = 1024, 5.0
#: Rows of one hot component or bucket are dealt to so many tasks.
SALTS = 16
#: Words whose hashes a task keeps.
CACHED_WORDS = 300_000

FACTS = "row long, doc_id long, n_shingles long, fp binary, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Rows a band and the number of bands: 6 and 28 at 85 percent, 5 and 34 at 80."""
    rows = 6 if percent >= 85 else 5
    return rows, 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** rows))


def most_different(percent: int) -> int:
    """Bits of two sketches that may differ in a link."""
    if DEVIATIONS is None:
        return SKETCH
    each = (1 - percent / 100) / 2
    return int(SKETCH * each + DEVIATIONS * math.sqrt(SKETCH * each * (1 - each)))


class WordHash(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `size` are one shingle, none give none."""
    words = space_words(text or b"")
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    x = np.full(n - width + 1, 2 * width + 1, np.uint64)
    for i in range(width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i]
    return np.unique(_mixed(x))


@lru_cache(maxsize=2)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the circulant one as one row of coordinates a place (a view, not a copy)."""
    rng, places = np.random.default_rng(20240501), 1 << PLACES_LOG2
    first, second = rng.permutation(places).astype(np.uint32), rng.permutation(places).astype(np.uint32)
    circle = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    first, rows = permutations(coordinates)
    at = first[(shingles >> np.uint64(64 - PLACES_LOG2)).astype(np.int64)]
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(least, rows[at[i : i + 2048]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = len(least) // rows
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def _facts(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rows, count = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ns, fps, bands = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), hashes)
                ns.append(len(s))
                fps.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s, rows * count), rows) if len(s) else None)
            offsets = np.cumsum([0, *(0 if b is None else count for b in bands)])
            flat = np.concatenate([np.empty(0, np.int64), *(b for b in bands if b is not None)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ns, pa.int64()),
                    pa.array(fps, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["row", "doc_id", "n_shingles", "fp", "bands"],
            )

    return run


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH circulant coordinates, packed into longs."""
    bits = (signature(shingles, SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
            ],
            names=["fp", "shingles", "bits"],
        )


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the texts whose ids are wanted, made anew from the texts: sets of other texts are never kept."""
    ids = small(wanted.select(F.col("rep").alias("_rep")).distinct())
    chosen = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    made = chosen.select(as_bytes("text").alias("text")).mapInArrow(_sets, "fp binary, shingles array<long>, bits array<long>")
    return made.dropDuplicates(["fp"])


def _possible(percent: int, n_a: Column, n_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """Whether sizes and sketches of two sets allow a link."""
    differ = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differ <= most_different(percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs(a, b, n_a, n_b) those with percent / 100 of their united shingles in common. Sketches come first; the sets
    themselves are fetched for what they leave."""
    a = sets.select(F.col("fp").alias("a"), F.col("bits").alias("_ba"))
    b = sets.select(F.col("fp").alias("b"), F.col("bits").alias("_bb"))
    near = pairs.join(b, "b").join(a, "a").filter(_possible(percent, F.col("n_a"), F.col("n_b"), F.col("_ba"), F.col("_bb")))
    near = stored(near.select("a", "b", "n_a", "n_b"), "near")
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("_sb"))
    both = near.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, root), the root being the least node. Alternating large and small
    stars; each round is a distributed grouping and is kept in the shared folder."""
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    stars = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        around = both(stars).toDF("u", "v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large, "large")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(root, "a")
        down = joined.select(F.col("b").alias("x"), F.col("m")).union(root.select(F.col("a"), F.col("m")))
        stars = stored(down.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        # done when every node points at one root and no root points on
        kinds = stars.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select(F.col("b"), F.lit(0), F.lit(1)))
        mixed = kinds.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
        if not mixed.head(1):
            break
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(stars.select(F.col("b"), F.col("b")).distinct())


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def _hub_pairs(now: DataFrame, best_only: bool, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of hubs and members of now(fp, n, key, root) in different components. The hub of a bucket is
    the member that meets most others over all its buckets: an original before its edited copies. A member is paired with
    the best hub of each other component in its buckets; with best_only with the best of all."""
    sizes = stored(now.groupBy("key").agg(F.count("*").alias("m")), "sizes")
    met = stored(now.join(small(sizes), "key").groupBy("fp").agg(F.sum(F.col("m") - 1).alias("met")), "met")
    hubs = stored(now.join(met, "fp").groupBy("key").agg(F.max(F.struct("met", "fp", "n", "root")).alias("h")), "hubs")
    near = now.join(hubs, "key").filter((F.col("root") != F.col("h.root")) & (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")))
    near = near.groupBy("fp", "n", *([] if best_only else ["h.root"])).agg(F.max("h").alias("h"))
    return near.select(F.col("h.fp").alias("a"), F.col("fp").alias("b"), F.col("h.n").alias("n_a"), F.col("n").alias("n_b")).distinct()


def _still_open(now: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their components as root."""
    now = now.drop("root").join(labels, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    now = stored(now, "rooted")
    opened = stored(now.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("key"), "keys")
    return now.join(small(opened), "key", "left_semi")


def grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(row, doc_id, text): the stored facts (row, doc_id, n_shingles, fp, bands), and the stored groups(fp,
    component_id, root) of the sets that several rows have or that are linked to others. root names a component;
    component_id is its least doc_id, null if it has none.

    Buckets are counted by partial sums and met by joins with their stored sizes, so a hot bucket is never sorted in one
    task."""
    facts = stored(docs.select("row", F.col("doc_id").cast("long"), as_bytes("text").alias("text")).mapInArrow(_facts(percent), FACTS), "facts")
    classes = stored(
        facts.filter("n_shingles > 0")
        .groupBy("fp")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("copies"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    keyed = classes.select("fp", "rep", "n", F.explode("bands").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    members = stored(keyed.join(small(buckets), "key").drop("m").withColumn("root", F.col("fp")), "members")
    sets = stored(sets_of(docs.select(F.col("doc_id").cast("long"), "text"), members.select("rep").distinct()), "sets")

    # first every member meets the best hub of all its buckets, which joins most groups; then, in buckets that still hold
    # several components, the best hub of each other one; what lies apart even then is met pair by pair
    now, pairs, edges, labels = members, None, None, None
    for best_only in (True, False):
        found = stored(_hub_pairs(now, best_only, percent), "pairs")
        pairs = found.select("a", "b") if pairs is None else pairs.union(found.select("a", "b"))
        links = verified(found, sets, percent)
        edges = stored(links if edges is None else edges.union(links), "links")
        labels = stored(components(edges), "labels")
        now = stored(_still_open(now, labels), "open")
        if not now.head(1):
            break
    bits = sets.select(F.col("fp").alias("_fp"), "bits")
    rest = now.join(classes.select("fp", "bands"), "fp").join(bits, F.col("fp") == F.col("_fp")).drop("_fp")
    rest = stored(rest, "rest")
    x = rest.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).alias("x")
    y = rest.withColumn("salt", _every_salt()).alias("y")
    possible = _possible(percent, F.col("x.n"), F.col("y.n"), F.col("x.bits"), F.col("y.bits"))
    left = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") < F.col("y.root")) & possible
                  & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")))
    left = left.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    done = pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct()
    left = stored(left.join(done, ["a", "b"], "left_anti"), "left")
    if left.head(1):
        edges = stored(edges.union(verified(left, sets, percent)), "links")
        labels = stored(components(edges), "labels")
    linked = classes.select("fp", "rep", "copies").join(labels, F.col("fp") == F.col("node"), "left").filter("copies > 1 or node is not null")
    linked = stored(linked.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "linked")
    # a component may be large: its name goes to every salt, its members to one each
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    least = least.withColumn("salt", _every_salt())
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    return facts, stored(salted.join(least, ["root", "salt"]).select("fp", "component_id", "root"), "groups")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row a document row.

    Words are split at white space, A-Z lower-cased. Null and empty texts have no shingles and stand alone. Equal sets
    link at once; only one of each such class is banded. A pair that shares a band (all but a share MISSED of those at
    the wanted similarity do) is either verified on full sets, or already in one component, or ruled out by its sketch
    (see DEVIATIONS). component_id: least doc_id reachable; rows with a null doc_id join components but never name them.
    Repeated rows are one class; very long texts are shingled whole; no rows give none. Other columns are ignored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    facts, groups = grouped(rows, percent)
    out = facts.select("doc_id", "n_shingles", "fp").join(small(groups.drop("root")), "fp", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, in all their columns, one row of each component: that with the least doc_id, nulls last, then the
    least fingerprint. Rows are told apart by where they are stored, so null and repeated doc_ids do no harm; texts
    without shingles all stay. Of repeated rows the one stored first stays; very long texts count whole; no rows give none.
    Columns of any name pass through."""
    rows = stored(packed(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    facts, groups = grouped(rows.select(F.col("_row").alias("row"), "doc.doc_id", "doc.text"), percent)
    members = stored(facts.select("row", "doc_id", "fp").join(small(groups.select("fp", "root")), "fp"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "row")
    stays = members.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = stored(members.select("row").join(stays, "row", "left_anti").select(F.col("row").alias("_gone")), "gone")
    return rows.join(small(gone), F.col("_row") == F.col("_gone"), "left_anti").select("doc.*")
