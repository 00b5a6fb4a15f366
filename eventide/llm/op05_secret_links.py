"""Secret scans with multipart credential linking.

Every text is scanned once for parts: access identifiers, assigned secrets, hex strings, and weak candidates that alone
mean little (upper-case key names, mixed-case blobs, endpoints). Parts are cut into stretches of `scope` characters; an
interval join with what each neighbouring stretch holds tells whether complementary parts stand within `scope`
characters, from the end of one to the start of the other. Weak candidates are reported only then. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import let, met, packed, piece, running, spans_of, stored, text_blocks

#: Strong parts, reported wherever they stand: (kind, pattern, least length of what is measured).
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: Weak parts: upper-case names of up to 128 characters, and blobs that show an upper-case letter, a lower-case letter and a
#: digit among their first 40 characters.
KEY_NAME = r"(?<![A-Za-z0-9])(?!AKIA)(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,128}(?![A-Za-z0-9])"
BLOB = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\"'<>]+"
#: What role a part plays, and which other role a weak part needs near it.
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "keyname": "id", "endpoint": "endpoint"}
NEEDS = {"keyname": ("secret",), "blob": ("id", "endpoint"), "endpoint": ("id", "secret")}
SCOPE = 400
MASK = "[SECRET]"


def scanned(docs: DataFrame, text: Column) -> DataFrame:
    """docs with `_base`, `_weak` and `_inner`, arrays of struct(kind, start, end, value), a kind in order of start. `_inner`
    are weak parts that overlap a base one: they aren't reported, but are company to others."""
    text = F.coalesce(text, F.lit(""))
    # a value of fewer than six characters fails; the match that held it is not tried again
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= 6)
    weak = F.concat(spans_of(text, KEY_NAME, "keyname"), spans_of(text, BLOB, "blob"), spans_of(text, ENDPOINT, "endpoint"))
    out = docs.select("*", assign.alias("_assign"), spans_of(text, ACCESS, "access").alias("_access"), spans_of(text, HEX, "hex").alias("_hex"), weak.alias("_weak"))
    kinds = [F.col(f"_{k}") for k in BASE]
    lone = lambda s: ~(met(s, kinds[0]) | met(s, kinds[1]) | met(s, kinds[2]))
    out = out.withColumn("_split", F.transform("_weak", lambda s: F.struct(s.alias("s"), lone(s).alias("lone")))).withColumn("_base", F.concat(*kinds))
    of = lambda keep: F.transform(F.filter("_split", lambda t: t["lone"] == keep), lambda t: t["s"])
    return out.withColumn("_weak", of(True)).withColumn("_inner", of(False)).drop("_split", *[f"_{k}" for k in BASE])


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts(row, others, weak) -> row, spans: the weak parts that have a complementary part, weak or other, within `scope`
    characters.

    Distance is the gap between the intervals, 0 where they overlap. A part is cut at multiples of `scope`, with a piece
    for each stretch from that of its start to that of its end. Everything in a piece's own stretch is near; of the
    neighbours, the last end in the stretch before and the first start in the one after decide. Rows are thus as many as
    parts and stretches, never pairs."""
    tagged = lambda c, lone: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(lone).alias("lone")))
    one = parts.select("row", F.inline(F.concat(tagged("others", False), tagged("weak", True))), F.lit(scope).cast("long").alias("_w"))
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    stretch = lambda c: F.floor(F.col(c) / F.col("_w")).cast("long")
    one = one.select("row", "s", "lone", "_w", role[F.col("s.kind")].alias("role"), F.explode(F.sequence(stretch("s.start"), stretch("s.end"))).alias("at"))
    one = one.withColumn("lo", F.greatest("s.start", F.col("at") * F.col("_w"))).withColumn("hi", F.least("s.end", (F.col("at") + 1) * F.col("_w")))
    held = one.groupBy("row", "at", "role").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = held.select("row", "role", "lo", "hi", F.col("at").alias("own"), F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = one.filter("lone").select("row", "at", "s", "lo", "hi", F.explode(needs[F.col("s.kind")]).alias("role"))
    both = weak.alias("w").join(near.alias("n"), ["row", "at", "role"])
    gap = F.when(F.col("n.own") > F.col("at"), F.col("n.lo") - F.col("w.hi")).otherwise(F.col("w.lo") - F.col("n.hi"))
    close = both.filter((F.col("n.own") == F.col("at")) | (gap <= scope))
    return close.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.col("w.s.start").alias("start"), F.col("w.s.kind").alias("kind"), F.col("w.s.end").alias("end")))).alias("spans"))


def _said(spans: Column, order: tuple[str, ...]) -> Column:
    """kind:start:end by start, then the kind's place in order, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["a"], s["c"])), ",")


def _counted(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _with_links(rows: DataFrame) -> DataFrame:
    """Stored rows with _row, _base, _weak, _inner -> the same with _linked. Only rows with weak parts take part in the join."""
    plain = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    some = rows.filter(F.size("_weak") > 0)
    found = linked(some.select(F.col("_row").alias("row"), F.concat("_base", "_inner").alias("others"), F.col("_weak").alias("weak")))
    found = found.select(F.col("row").alias("_of"), F.col("spans").alias("_spans"))
    some = some.join(found, F.col("_row") == F.col("_of"), "left").withColumn("_linked", F.coalesce("_spans", plain)).drop("_of", "_spans")
    return rows.filter(F.size("_weak") == 0).withColumn("_linked", plain).unionByName(some)


def secrets(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked; one row a document row.

    Null and empty texts have no spans; the digest is then that of the empty string. Rows are told apart by where they
    are stored, so null and repeated doc_ids do no harm; repeated rows get equal spans. Of spans that begin at one place the
    kind listed first comes first. Very long texts are scanned whole, in time in proportion; no rows give none. Other columns
    are ignored."""
    found = scanned(docs.select("doc_id", "text"), F.col("text")).drop("text").withColumn("_row", F.monotonically_increasing_id())
    rows = _with_links(stored(found, "parts"))
    shape = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    everything = F.concat(shape("_base"), F.col("_linked"))
    return rows.select(
        "doc_id",
        *map(_counted, BASE),
        F.sha2(_said(F.col("_base"), BASE), 256).alias("base_sha256"),
        _said(everything, (*BASE, *NEEDS)).alias("spans"),
        F.size("_linked").cast("long").alias("n_linked"),
    )


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents in all their columns, every reported span replaced by the mask; n_chars, if there, is counted anew
    for changed texts. Spans that overlap are replaced as one. Null and empty texts stay as they are; repeated rows are
    masked alike, and columns of any name pass through."""
    rows = _with_links(stored(scanned(packed(docs), F.col("doc.text")).withColumn("_row", F.monotonically_increasing_id()), "parts"))
    pair = lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))
    spans = F.array_sort(F.concat(F.transform("_base", pair), F.transform("_linked", pair)))

    def kept(blocks: Column, own: Column, ends: Column) -> Column:
        # what stays lies between the furthest end so far and a span that begins there or later
        between = F.transform(own, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("a"), s["a"].alias("b")))
        between = F.filter(between, lambda g: g["a"] <= g["b"])
        rest = F.struct(F.element_at(ends, -1).alias("a"), F.char_length("doc.text").alias("b"))
        return F.array_join(F.transform(F.concat(between, F.array(rest)), lambda g: piece(blocks, g["a"], g["b"])), mask)

    ends = lambda own: running(F.transform(own, lambda s: s["b"]), lambda a, b: F.greatest(a, b))
    done = let(text_blocks(F.col("doc.text")), lambda blocks: let(spans, lambda own: let(ends(own), lambda upto: kept(blocks, own, upto))))
    changed = F.size("_base") + F.size("_linked") > 0
    out = rows.select("doc", F.when(changed, done).alias("_new"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.coalesce("_new", "doc.text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.char_length("_new").cast("long"), F.col("doc.n_chars"))
    return out.select(*[v.alias(c) for c, v in columns.items()])
