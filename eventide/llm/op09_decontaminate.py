"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

The automaton's letters are words: every window of ten consecutive words of an item (a shorter item is one window) is a
key. A text is cut into normalised words once and run through the automaton once; a match ends at a word number, and
word numbers map back to places in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import ALNUM_TABLE, alnum_words, as_bytes, packed, stored

WINDOW = 10
#: Words of items that one automaton takes (about a kilobyte a word). The items of a larger benchmark are dealt by a hash to
#: several automata, which scan the texts one after the other.
MOST_WORDS = 300_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD.encode())


def item_windows(text: bytes, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = alnum_words(text)
    if not words:
        return set()
    if len(words) <= window:
        return {tuple(words)}
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class Index:
    """Vocabulary and automaton over the windows of all items: of a benchmark of MOST_WORDS words at most."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).update([] if item_id is None else [str(item_id)])
        self.ids: dict[bytes, int] = {}
        self.owners: list[frozenset[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in sorted(owners):
            for word in key:
                self.ids.setdefault(word, len(self.ids) + 1)
            self.automaton.add_word(tuple(self.ids[word] for word in key), (len(self.owners), len(key)))
            self.owners.append(frozenset(owners[key]))
        if self.owners:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Flags of the words inside an occurrence of a window, and the items that have one."""
        flags, found = np.zeros(len(words), dtype=bool), set()
        if self.owners:
            for end, (owner, length) in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
                flags[end - length + 1 : end + 1] = True
                found |= self.owners[owner]
        return flags, found


def dealt(benchmark: DataFrame) -> list[DataFrame]:
    """The items by automaton, of half of MOST_WORDS words each on average where there are several; an item stays whole."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    n = benchmark.agg(F.sum(words).alias("n")).first().n or 0
    shards = 1 if n <= MOST_WORDS else -(-2 * n // MOST_WORDS)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    return [benchmark.filter(place == i) for i in range(shards)]


def read_items(benchmark: DataFrame) -> list[tuple[object, bytes]]:
    """The items of one automaton, of which null and empty texts have no windows."""
    rows = benchmark.select("item_id", as_bytes("text").alias("text")).dropna(subset=["text"]).toLocalIterator()
    return [(r.item_id, bytes(r.text)) for r in rows]


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of flagged words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _places(text: bytes, flags: np.ndarray) -> list[tuple[int, int]]:
    """Flagged words as stretches of code points of the original text, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text.translate(ALNUM_TABLE))]
    spans, at, before = [], 0, 0
    for i, j in stretches(flags):
        begin, end = places[i][0], places[j - 1][1]
        start = before + len(text[at:begin].decode("utf-8", "replace"))
        at, before = end, start + len(text[begin:end].decode("utf-8", "replace"))
        spans.append((start, before))
    return spans


def hit_spans(text: bytes, index: Index) -> list[tuple[int, int]]:
    """The hit stretches as code point offsets in the original text, end exclusive."""
    return _places(text, index.hits(alnum_words(text))[0])


def sharded_hits(rows: DataFrame, shards: list[DataFrame], window: int = WINDOW) -> DataFrame:
    """Stored rows(_row, text) -> _row, words (stretches of hit words), items: only rows that some automaton hits, whose
    finds are brought together by row."""

    def scan(items: DataFrame) -> DataFrame:
        index = rows.sparkSession.sparkContext.broadcast(Index(read_items(items), window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    flags, found = index.value.hits(alnum_words(text.as_py() or b""))
                    if flags.any():
                        out.append((row, [{"a": a, "b": b} for a, b in stretches(flags)], sorted(found)))
                kinds = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((), (), ()), kinds)], names=["_row", "words", "items"])

        found = rows.select("_row", as_bytes("text").alias("text")).mapInArrow(run, "_row long, words array<struct<a:int,b:int>>, items array<string>")
        return stored(found, "hits")  # the next automaton takes this one's place in memory

    every = reduce(DataFrame.unionByName, map(scan, shards))
    return every.groupBy("_row").agg(F.flatten(F.collect_list("words")).alias("words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """decontaminate with `spans` as an array, the hit stretches as code points of the original text, in order."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def told(batches: Iterator[pa.RecordBatch], hits: Callable[[pa.RecordBatch, int, list[bytes]], tuple]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, n_items, shas, spans = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = text.as_py() or b""
                words = alnum_words(data)
                flags, found = hits(batch, i, words)
                n_words.append(len(words))
                n_hit.append(int(flags.sum()))
                n_items.append(len(found))
                shas.append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in _places(data, flags)] if n_hit[-1] else [])
            whole = [pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)]
            columns = [batch.column(0), *whole, pa.array(shas, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    shards = dealt(benchmark)
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("text"))
    if len(shards) == 1:
        index = docs.sparkSession.sparkContext.broadcast(Index(read_items(shards[0]), window))
        return rows.mapInArrow(lambda batches: told(batches, lambda _, __, words: index.value.hits(words)), RESULT)

    def gathered(batch: pa.RecordBatch, i: int, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        flags = np.zeros(len(words), bool)
        for s in batch.column(2)[i].as_py() or []:
            flags[s["a"] : s["b"]] = True
        return flags, set(batch.column(3)[i].as_py() or [])

    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = rows.join(sharded_hits(rows, shards, window), "_row", "left").select("doc_id", "text", "words", "items")
    return rows.mapInArrow(lambda batches: told(batches, gathered), RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans
    (start:end of the hit stretches in code points, comma-joined).

    One row a document row, repeated ones included. Null and empty texts have no words and no hits; very long ones are
    scanned whole. Items that share a window all count; a null item_id makes hits but isn't listed. An empty benchmark finds
    nothing, an empty table gives no rows. Other columns are ignored. One automaton finds everything in one scan; a
    benchmark of over MOST_WORDS words takes several, one scan each, with the same result."""
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return marked(docs, benchmark, window).withColumn("spans", said)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, in all their columns, in which no benchmark window occurs; null and empty texts stay. Repeated rows go
    or stay together; very long texts are scanned whole; an empty benchmark keeps all, an empty table gives no rows."""
    shards = dealt(benchmark)
    if len(shards) > 1:
        rows = stored(packed(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
        found = sharded_hits(rows.select("_row", "doc.text"), shards, window).select(F.col("_row").alias("_gone"))
        return rows.join(found, F.col("_row") == F.col("_gone"), "left_anti").select("doc.*")
    index = docs.sparkSession.sparkContext.broadcast(Index(read_items(shards[0]), window))

    @F.arrow_udf("boolean")
    def free(texts: pa.Array) -> pa.Array:
        own = index.value
        return pa.array([not own.hits(alnum_words(t.as_py() or b""))[0].any() for t in texts], pa.bool_())

    return docs.filter(free(as_bytes("text")))
