"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of text items and media references with captions. References name their payload by
digest; the media table holds the payload of every document, and equal payloads fall together by digest before the join
that resolves references, without disturbing positions or captions. A payload is stored as a binary grey image (PGM, 8 bits a sample), whose samples are the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from html import escape
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import SPACE_WORD, as_bytes, small, stored

#: Samples of a row of the image, and the byte that fills the last row.
WIDTH, FILL = 576, b"\xff"
SCHEME = "digest:"
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "body", "figure", "blockquote", "pre"}
_HIDDEN = {"script", "style", "noscript", "template"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class Sequence(HTMLParser):
    """Collects (kind, text, ref, caption) in reading order. A figcaption belongs to the media of its figure, wherever it
    stands in it; without one, alt or title is the caption."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self._text: list[str] = []
        self._hidden, self._figure, self._caption, self._given = 0, None, None, None

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split(" ")).strip()
        self._text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag in _BLOCKS:
            self._flush()
            if tag == "figure":
                self._figure, self._given = len(self.items), None
        elif tag == "figcaption":
            self._caption = []
        elif tag in _MEDIA:
            own = dict(attrs)
            if own.get("src"):
                self._flush()
                self.items.append(["media", None, own["src"], self._given or own.get("alt") or own.get("title")])

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption = "".join(self._caption).strip()
            for item in self.items[self._figure or 0 :] if self._figure is not None else []:
                if item[0] == "media" and caption:
                    item[3] = caption
            if self._figure is not None:
                self._given = caption or None
            self._caption = None
        elif tag in _BLOCKS:
            self._flush()
            if tag == "figure":
                self._figure = self._given = None

    def handle_data(self, data: str) -> None:
        if self._caption is not None:
            self._caption.append(data)
        elif not self._hidden:
            self._text.append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page in order, positions from 0; none for null or empty HTML."""
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [dict(zip(("pos", "kind", "text", "ref", "caption"), (i, *x))) for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str, html_col: str = "html", text: bool = True) -> DataFrame:
    """pages(id, html) -> id, items: array of structs in reading order. text=False leaves the texts themselves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            items = [parse(h.as_py()) for h in batch.column(1)]
            if not text:
                items = [[x | {"text": None} for x in page] for page in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, kind)], names=["id", "items"])

    kept = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(run, f"id {kept}, items array<{ITEM}>")


def payload_of(text: bytes) -> bytes:
    """The text's bytes filled up to a positive multiple of the image's width."""
    rows = max(1, -(-len(text) // WIDTH))
    return text + FILL * (rows * WIDTH - len(text))


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(media: bytes) -> np.ndarray:
    """The samples of a stored image, as rows."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a grey image of 8 bits a sample")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Height, mean, standard deviation, entropy in bits and mean step between neighbours."""
    n = samples.size
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / n
    mean = float(np.dot(counts, np.arange(256)) / n)
    spread = float(np.sqrt(max(0.0, np.dot(counts, np.arange(256) ** 2) / n - mean * mean)))
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean())
    return f"h={samples.shape[0]};mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(0)]
        payloads = list(map(payload_of, texts))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array(list(map(encode, payloads)), pa.binary()),
            ],
            names=["digest", "n_bytes", "media"],
        )


def media_table(docs: DataFrame) -> DataFrame:
    """documents(text) -> digest, n_bytes, media: what is stored."""
    return docs.select(as_bytes("text").alias("text")).mapInArrow(_media, "digest string, n_bytes long, media binary")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            stored_form = media.as_py()
            samples = decode(stored_form)
            payload = samples.tobytes()
            rows.append((digest, n, len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]), len(stored_form), sha256(stored_form).hexdigest(), feature(samples)))
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


#: References to a payload of more copies than this are dealt to several tasks, so many a task.
HOT = 1000


def described(media: DataFrame) -> DataFrame:
    """One row a digest, stored, with what reading the stored bytes back gives and how many copies there are. Copies fall
    together before the join."""
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    facts = media.select("digest", "n_bytes", "media").mapInArrow(_described, schema)
    values = facts.columns[1:]
    return stored(facts.groupBy("digest").agg(F.min(F.struct(*values)).alias("f"), F.count("*").alias("copies")).select("digest", "copies", "f.*"), "facts")


def resolved(items: DataFrame, media: DataFrame, columns: list[str], hot: int = HOT) -> DataFrame:
    """(id, items) -> one row a media reference: id, pos, caption, digest and the columns of the media table, null for a
    reference that the table doesn't have. The media table (described) has one row a digest; that of a payload with many
    copies stands in several places, among which references to it are dealt by their id."""
    refs = items.select("id", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("x"))
    refs = refs.select("id", F.col("x.pos").alias("pos"), F.col("x.caption").alias("caption"), F.regexp_replace("x.ref", f"^{SCHEME}", "").alias("digest"))
    parts = F.ceil(F.col("copies") / hot).cast("int")
    spread = small(media.filter(F.col("copies") > hot).select("digest", parts.alias("_parts")))
    refs = refs.join(spread, "digest", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("id", "pos"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    places = media.select("digest", *columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return refs.join(places, ["digest", "_part"], "left").drop("_part")


def page_sequences(pages: DataFrame, media: DataFrame) -> DataFrame:
    """pages(page_id, html), media(digest, n_bytes) with a row a digest -> page_id, n_items, n_words, n_media, n_captions,
    n_resolved, media_positions; one row a page row.

    Null and empty HTML has no items. Media whose reference isn't a digest, or isn't in the table, stay in the sequence
    unresolved. Repeated page_ids and pages stay apart; very long pages are parsed whole; no pages give no rows. Other
    columns are ignored."""
    rows = stored(sequences(pages, "page_id"), "sequences").withColumn("_row", F.monotonically_increasing_id())
    kind = lambda k: F.filter("items", lambda x: x["kind"] == k)
    counted = rows.select(
        "_row",
        F.col("id").alias("page_id"),
        F.size("items").cast("long").alias("n_items"),
        F.aggregate(kind("text"), F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x["text"], F.lit(SPACE_WORD))).alias("n_words"),
        F.size(kind("media")).cast("long").alias("n_media"),
        F.size(F.filter("items", lambda x: F.coalesce(x["caption"], F.lit("")) != "")).cast("long").alias("n_captions"),
        F.array_join(F.transform(kind("media"), lambda x: x["pos"]), ",").alias("media_positions"),
    )
    refs = resolved(rows.select(F.col("_row").alias("id"), "items"), media, ["n_bytes"])
    found = refs.groupBy("id").agg(F.count("n_bytes").alias("_found")).withColumnRenamed("id", "_of")
    out = counted.join(found, F.col("_row") == F.col("_of"), "left")
    return out.select("page_id", "n_items", "n_words", "n_media", "n_captions", F.coalesce("_found", F.lit(0).cast("long")).alias("n_resolved"), "media_positions")


def page_of(lines: str, digest: str, caption: str) -> str:
    """A page with a paragraph a line of the text, and after the first one a figure that refers to the payload."""
    parts = [f"<p>{escape(x, quote=False)}</p>" for x in lines.split("\n")]
    parts.insert(1, f'<figure><img src="{SCHEME}{digest}"><figcaption>{escape(caption, quote=False)}</figcaption></figure>')
    return "<html><body>" + "".join(parts) + "</body></html>"


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        out = []
        for text in batch.column(1):
            data = text.as_py() or b""
            html = page_of(data.decode("utf-8", "replace"), sha256(payload_of(data)).hexdigest(), f"{len(data)} bytes")
            out.append([x | {"text": None} for x in parse(html)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "items"])


def media_columns(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, media_pos, n_items, caption; one row a document row.

    Each document becomes a page whose figure refers to the document's payload; the page is parsed, the reference is
    resolved against the stored media table by digest, and features come from the bytes read back. A null text is an
    empty one, whose payload is one row of fill; a very long one is stored whole, as a higher image. Equal texts share one
    stored payload and get equal values; no rows give none. Other columns are ignored."""
    media = stored(media_table(docs), "media")
    items = docs.select(F.col("doc_id").cast("long").alias("id"), as_bytes("text").alias("text")).mapInArrow(_paged, f"id long, items array<{ITEM}>")
    counted = items.select(F.struct("id", F.size("items").alias("n")).alias("id"), "items")
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = resolved(counted, described(media), columns)
    return rows.select(F.col("id.id").alias("doc_id"), *columns, F.col("pos").alias("media_pos"), F.col("id.n").alias("n_items"), "caption")
