"""Fill-in-middle transformation.

Each text is cut in two places and reordered, so that a model learns to write what stands between. Cuts are given in units
(code points, or what a pattern matches); where they lie in the stored bytes is found by an index: the text's UTF-8 bytes
are dealt into fixed blocks, a Fenwick tree over the blocks holds how many units and how many code points end in each, and
a binary-lifting descent finds the block of a cut, within which alone the boundary is then looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.llm.common import as_bytes

#: Bytes of a block.
BLOCK = 1024
#: What opens prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Words with the white space behind them, over UTF-8 bytes; one of the patterns that `unit` takes.
WORDS = rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Outputs are handed on in batches of about so many bytes.
BATCH_BYTES = 16 << 20
_ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


class BlockIndex:
    """Fenwick trees over the blocks of one text.

    A unit counts in the block of its last byte, and so does a code point. `unit` is a pattern over bytes, which has to match
    whole characters, or None for code points; matches of no bytes aren't units."""

    def __init__(self, data: bytes, unit: re.Pattern | None = None, block: int = BLOCK) -> None:
        self.data, self.unit, self.block = data, unit, block
        bounds = np.arange(0, len(data), block)
        chars = np.add.reduceat(self._char_ends(0, len(data)), bounds, dtype=np.int64) if data else np.zeros(0, np.int64)
        units, self.resume = chars, None
        if unit is not None:
            ends = np.array([m.end() for m in unit.finditer(data) if m.end() > m.start()], np.int64)
            units = np.bincount((ends - 1) // block, minlength=len(bounds)).astype(np.int64)
            # where the last unit that ends before a block ends: from there matching can be taken up again
            self.resume = np.concatenate([[0], ends])[np.searchsorted(ends, bounds, side="right")]
        self.n_units, self.n_chars = int(units.sum()), int(chars.sum())
        self.units, self.chars = self._tree(units), self._tree(chars)

    def _char_ends(self, a: int, b: int) -> np.ndarray:
        """Whether bytes a to b are the last of their code point."""
        following = np.frombuffer(self.data, np.uint8)[a + 1 : b + 1]
        ends = np.ones(b - a, bool)
        ends[: len(following)] = (following & 0xC0) != 0x80
        return ends

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        upto, at = np.concatenate([[0], np.cumsum(counts)]), np.arange(len(counts) + 1)
        return (upto - upto[at - (at & -at)]).tolist()

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first `units` units, with what stands between them."""
        if units <= 0:
            return 0, 0
        block, rest, chars, step = 0, units, 0, 1 << (len(self.units) - 1).bit_length()
        while step:
            if block + step < len(self.units) and self.units[block + step] < rest:
                block += step
                rest -= self.units[block]
                chars += self.chars[block]
            step >>= 1
        a = block * self.block
        b = min(a + self.block, len(self.data))
        if self.unit is None:
            end = a + int(np.flatnonzero(self._char_ends(a, b))[rest - 1]) + 1
        else:
            own = (m.end() for m in self.unit.finditer(self.data, int(self.resume[block])) if m.end() > m.start())
            end = next(e for i, e in enumerate(own, 1) if i == rest)
        return end, chars + int(self._char_ends(a, end).sum())


def transformed(text: bytes, h: tuple[int, int, int, int], unit: re.Pattern | None = None, block: int = BLOCK) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text; h are its four draws."""
    index = BlockIndex(text, unit, block)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - PLAIN:
        return index.n_units, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (index.cut(u) for u in sorted(x % (index.n_units + 1) for x in h[:2]))
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    first = h[3] % 100 < SUFFIX_FIRST
    return index.n_units, "spm" if first else "psm", a_chars, b_chars - a_chars, b"".join((suffix, prefix, middle) if first else (prefix, suffix, middle))


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the digest of `1:` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: bytes | None = None, block: int = BLOCK) -> DataFrame:
    """documents(doc_id, text) -> all columns but text, and n (units), form, prefix_chars, middle_chars, output.

    The draws hang on doc_id alone: repeated rows are cut alike, and a null doc_id counts as an empty one. Null and empty
    texts and those that contain a mark stay plain; cuts of equal place make an empty middle. A text of any length is
    indexed whole, its blocks taking 16 bytes each. Columns of the input with added names give way, all others pass through;
    no rows give none."""
    added = [c.split()[0] for c in _ADDED.split(", ")]
    rest = {c: docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("text", *added)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit)
        for batch in batches:
            texts, numbers = batch.column(1), [batch.column(2 + k).to_pylist() for k in range(4)]
            start, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                rows.append(transformed(texts[i].as_py() or b"", tuple(x[i] for x in numbers), pattern, block))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    n, form, a, b, out = zip(*rows)
                    columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), *columns], names=["rest", *added])
                    start, size, rows = i + 1, 0, []

    packed = F.struct(F.lit(0).alias("row"), *[c.alias(f"c{i}") for i, c in enumerate(rest.values())]).alias("rest")
    rows = docs.select(packed, as_bytes("text").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(docs["doc_id"]))])
    out = rows.mapInArrow(run, StructType([rows.schema["rest"], *StructType.fromDDL(_ADDED)]))
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(rest)], *added)


def restored(output: Column, form: Column) -> Column:
    """The text again from output and form: each mark occurs once in an output that isn't plain."""
    first, last = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    head, tail = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    one = F.when(form == "psm", F.substring_index(head, SUFFIX, 1)).otherwise(F.substring_index(head, PREFIX, 1))
    two = F.when(form == "psm", F.substring_index(head, SUFFIX, -1)).otherwise(F.substring_index(head, PREFIX, -1))
    one = F.substr(one, F.lit(len(PREFIX) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, tail, two)).otherwise(F.concat(two, tail, one))


def fim_digests(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; one row a document row."""
    rows = fill_in_middle(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
