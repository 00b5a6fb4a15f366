"""Exact dedup by an extendible-hash index on shared files.

Texts are normalised (ASCII white space deleted) and keyed by the first 63 bits of their SHA-256. Tasks that read the
documents first gather equal texts of their own into runs, byte by byte, so that a text with any number of copies becomes
one entry a run; entries are written to the shared folder. The index over them deals keys by their leading bits: a
directory of buckets doubles, splitting those that hold more than `capacity` keys, until none does. Owner tasks then take
whole buckets, which are ranges of keys: entries of equal key form a chain, along which bytes are compared. A chain of many
entries is dealt to several owners first, level by level, each handing one entry a text on to the next level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from eventide.llm.common import as_bytes, small, stored

#: Bits of a key.
BITS = 63
#: A bucket splits beyond so many keys, a chain beyond so many entries.
CAPACITY, CHAIN = 500, 32
#: A run ends after so many rows or bytes of distinct texts: what a task holds at once.
RUN_ROWS, RUN_BYTES = 50_000, 32 << 20
#: What normalising deletes.
SPACE = b" \t\n\x0b\x0c\r"


def runs(docs: DataFrame, bits: int = BITS, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """documents(doc_id, text) -> one row for each distinct text of a run: key, sha, text (normalised), n, chars (most code
    points of a member), best (the doc_id that goes with them), at (its place), members (doc_ids in order)."""
    rows = docs.select("doc_id", as_bytes("text").alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))
    kind = rows.schema["doc_id"].dataType

    def better(a: tuple, b: tuple) -> bool:
        """(chars, doc_id): whether a stays before b; null ids come last."""
        return a[0] > b[0] or a[0] == b[0] and a[1] is not None and (b[1] is None or a[1] < b[1])

    def packed(found: dict, ids: pa.DataType) -> pa.RecordBatch:
        digests = [sha256(t) for t in found]
        keys = [int.from_bytes(d.digest()[:8]) >> 1 >> (BITS - bits) << (BITS - bits) for d in digests]
        own = list(found.values())
        columns = [
            pa.array(keys, pa.int64()), pa.array([d.hexdigest() for d in digests]), pa.array(list(found), pa.binary()), pa.array([len(m) for _, _, m in own], pa.int64()),
            pa.array([b[0] for b, _, _ in own], pa.int64()), pa.array([b[1] for b, _, _ in own], ids), pa.array([at for _, at, _ in own], pa.int64()), pa.array([m for _, _, m in own], pa.list_(ids)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "sha", "text", "n", "chars", "best", "at", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, seen, ids = {}, 0, 0, None
        for batch in batches:
            ids = batch.column(0).type
            for doc_id, text, chars in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = (text.as_py() or b"").translate(None, SPACE)
                if text not in found:
                    found[text] = ((chars, doc_id), 0, [doc_id])
                    held += len(text)
                else:
                    best, at, members = found[text]
                    members.append(doc_id)
                    if better((chars, doc_id), best):
                        found[text] = ((chars, doc_id), len(members) - 1, members)
                seen += 1
                if seen >= run_rows or held >= run_bytes:
                    yield packed(found, ids)
                    found, held, seen = {}, 0, 0
        if found:
            yield packed(found, ids)

    schema = StructType.fromDDL("key long, sha string, text binary, n long, chars long")
    schema = StructType([*schema, StructField("best", kind), StructField("at", LongType()), StructField("members", ArrayType(kind))])
    return rows.mapInArrow(run, schema)


def _prefix(depth: int) -> Column:
    return F.shiftright("key", BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """keys(key), each once -> depth, prefix, n: the buckets, leaves of the tree of key prefixes.

    The directory starts at the depth at which buckets are half full on average or more, and doubles while some bucket holds
    more keys than `capacity`; only keys of such buckets take part in the next doubling. Keys differ, so that it ends."""
    depth = max(0, min(BITS, (max(1, -(-keys.count() // capacity)) - 1).bit_length()))
    leaves, open_keys = [], keys.select("key")
    while True:
        level = stored(open_keys.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("n")), "directory").withColumn("depth", F.lit(depth))
        full = (F.col("n") > capacity) & (F.col("depth") < BITS)
        over = level.filter(full)
        leaves.append(level.filter(~full))
        if over.isEmpty():
            break
        open_keys = open_keys.withColumn("prefix", _prefix(depth)).join(small(over.select("prefix")), "prefix", "left_semi").select("key")
        depth += 1
    return reduce(DataFrame.unionByName, leaves).select("depth", "prefix", "n")


def with_bucket(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """entries(key, ...) -> the same with `bucket`, the least key of the bucket that a key falls in. Depths are few: each is
    an equality on the key's prefix."""
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
    places = [F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix"), F.shiftleft(_prefix(d), BITS - d if d else 0).alias("bucket")) for d in depths]
    places = F.array(*places) if places else F.array().cast("array<struct<depth:int,prefix:bigint,bucket:bigint>>")
    return entries.select("*", F.inline(places)).join(small(buckets.select("depth", "prefix")), ["depth", "prefix"]).drop("depth", "prefix")


def owned(entries: DataFrame) -> DataFrame:
    """entries(bucket, salt, key, entry, text) -> entry, root: the first entry of the same key, salt and bytes.

    Owner tasks get whole buckets, in order of key; what they hold is the distinct texts of one chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            out = []
            for key, salt, entry, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if (key, salt) != now:
                    now, chain = (key, salt), []
                text = text.as_py()
                root = next((r for t, r in chain if t == text), None)
                if root is None:
                    root = entry
                    chain.append((text, entry))
                out.append(root)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], names=["entry", "root"])

    rows = entries.repartition("bucket", "salt").sortWithinPartitions("bucket", "key", "salt", "entry")
    return rows.select("key", "salt", "entry", "text").mapInArrow(run, "entry long, root long")


def same_texts(entries: DataFrame, capacity: int = CAPACITY, chain: int = CHAIN) -> DataFrame:
    """Stored entries(entry, key, text) -> entry, root for every entry whose key another one has too: the entry that stands
    for all of equal bytes."""
    keys = stored(entries.groupBy("key").agg(F.count("*").alias("length")), "keys")
    shared = keys.filter("length > 1")
    at = entries.select("entry", "key", "text").join(small(shared), "key")
    level = stored(with_bucket(at, directory(keys, capacity)), "chains")
    parts = F.ceil(F.col("length") / chain)
    result = None
    while True:
        salted = level.withColumn("salt", F.when(F.col("length") > chain, F.pmod(F.xxhash64("entry"), parts)).otherwise(0).cast("long"))
        found = stored(owned(salted), "roots")
        if result is None:
            result = found
        else:
            up = small(found.select(F.col("entry").alias("root"), F.col("root").alias("_up")))
            result = result.join(up, "root", "left").select("entry", F.coalesce("_up", "root").alias("root"))
        long = level.filter(F.col("length") > chain)
        if long.isEmpty():
            return result
        heads = long.join(small(found.filter("entry = root").select("entry")), "entry", "left_semi").drop("length")
        counts = heads.groupBy("key").agg(F.count("*").alias("length"))
        following = stored(heads.join(small(counts), "key"), "chains")
        # a chain that no longer gets shorter holds that many texts of one key; one owner then compares them all
        chain = max(chain, chain * 2) if following.count() == long.count() else chain
        level = following


def exact_duplicates(docs: DataFrame, bits: int = BITS, capacity: int = CAPACITY, chain: int = CHAIN, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """documents(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; one row a document row, other columns ignored.

    Texts are equal when identical after white space is deleted; null counts as empty and is equal to it. Of equal texts the
    row with the most code points stays, then the least doc_id, null last, then the first as stored: of repeated rows
    exactly one stays. Very long texts are hashed and compared whole; a table without rows gives none."""
    entries = stored(runs(docs, bits, run_rows, run_bytes).withColumn("entry", F.monotonically_increasing_id()), "entries")
    roots = same_texts(entries, capacity, chain)
    own = F.struct((-F.col("chars")).alias("c"), F.col("best").isNull().alias("z"), F.col("best").alias("b"), F.col("entry").alias("e"), F.col("at").alias("a"))
    light = entries.select("entry", "sha", "n", "members", own.alias("first"))
    linked = roots.join(light.select("entry", "n", "first"), "entry")
    groups = linked.groupBy("root").agg(F.sum("n").alias("size"), F.min("first").alias("stays"))
    known = roots.join(small(groups), "root").select("entry", "size", "stays")
    out = light.join(known, "entry", "left").withColumn("stays", F.coalesce("stays", "first")).withColumn("size", F.coalesce("size", "n"))
    out = out.select("*", F.posexplode("members").alias("place", "doc_id"))
    kept = (F.col("stays.e") == F.col("entry")) & (F.col("stays.a") == F.col("place"))
    return out.select("doc_id", F.col("stays.b").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
