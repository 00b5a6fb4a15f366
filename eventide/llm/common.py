"""Helpers that the training-data operators share: shared-folder tables, size-checked joins, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 1_000_000

#: Word bytes are those that aren't ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

#: Maps A-Z to a-z and every other ASCII byte that isn't a digit or a-z to a space; bytes over 127 stay.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df, which Spark then joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def space_words(data: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of UTF-8 text with A-Z in lower case."""
    return data.lower().split()


def alnum_words(data: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text with A-Z in lower case."""
    return data.translate(ALNUM_TABLE).split()


def as_bytes(column: str) -> Column:
    return F.col(column).cast("binary")


def words_count(column: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def md5_unit(*columns: str | Column) -> Column:
    """A hash of the columns in 0 .. 2**60 - 1, the same in every run and at every size."""
    text = F.concat_ws("\x01", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one column `doc`, so that no name of theirs meets a working column; `doc.*` unpacks them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Arrays are folded in blocks of so many elements and texts cut in blocks of so many characters: folding appends to an
#: array, and finding a character walks through the text, both of which would be quadratic in one go.
FOLD_BLOCK, TEXT_BLOCK = 256, 4096


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of the associative op over an array of ints, the element itself included."""

    def of(all_values: Column) -> Column:
        empty, last = F.array().cast("array<int>"), F.ceil(F.size(all_values) / FOLD_BLOCK).cast("int") - 1
        grow = lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(op(F.element_at(acc, F.greatest(F.lit(1), F.size(acc))), v))))
        inner = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(all_values, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), empty, grow))

        def joined(blocks: Column) -> Column:
            upto = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), empty, grow)
            return let(upto, lambda u: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: op(F.get(u, i - 1), v))))))

        return F.when(F.size(all_values) == 0, empty).otherwise(let(inner, joined))

    return let(values, of)


def text_blocks(text: Column) -> Column:
    """The text in pieces of TEXT_BLOCK characters."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in blocks; touches the blocks of these characters only."""
    first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
    at = start - first * TEXT_BLOCK + 1
    spread = F.concat(
        F.substring(F.get(blocks, first), at, F.lit(TEXT_BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(F.lit(0), last - first - 1)), ""),
        F.substring(F.get(blocks, last), F.lit(1), end - last * TEXT_BLOCK),
    )
    return F.when(start >= end, F.lit("")).when(first == last, F.substring(F.get(blocks, first), at, end - start)).otherwise(spread)


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of struct(kind, start, end, value) of all leftmost non-overlapping matches, in code points, in order.

    The matches and the pieces between them alternate, so running lengths give the positions; the time taken grows in
    proportion to the matches. `pattern` must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def placed(values: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.char_length(g) + F.char_length(v))
        return F.zip_with(
            running(lengths, lambda a, b: a + b),
            values,
            lambda e, v: F.struct(F.lit(kind).alias("kind"), (e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")),
        )

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(empty)


def met(span: Column, others: Column) -> Column:
    """Whether the span overlaps one of `others`, spans in order that don't overlap each other: by halving, the last one
    that begins before the span's end decides."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    begins = lambda n: F.get(others, n - 1)["start"] < span["end"]
    n = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.coalesce(begins(n + step), F.lit(False)), step).otherwise(0))
    return let(n, lambda i: F.coalesce(F.get(others, i - 1)["end"] > span["start"], F.lit(False)))


def apart(spans: Column, *others: Column) -> Column:
    """The spans that overlap none of the others, each of which is an array of spans in order."""

    def free(s: Column) -> Column:
        out = ~met(s, others[0])
        for o in others[1:]:
            out = out & ~met(s, o)
        return out

    return F.when(F.size(spans) == 0, spans).otherwise(F.filter(spans, free))
