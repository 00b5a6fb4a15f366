"""Exact dedup, fill-in-middle and whitening against plain restatements, with awkward rows, forced collisions and splits."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import op11_extendible_hash as xh
from eventide.llm import op12_fill_in_middle as fim
from eventide.llm import op13_whitening as white
from eventide.llm import oracles
from tests.llm.test_awkward import CLASHES, timed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_as_sql(got, docs, sql):
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda r: sorted(map(repr, r))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())


def copies(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, int(n))) for n in rng.integers(0, 4, 120)]
    texts += ["hot text"] * 90 + ["hot  text", "hottext", " hottext", "a\x0bb", "ab", "a\x1fb", "", None, None, " \n", "é" * 40_000, "é" * 40_000 + " "]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order] + [(None, "hot text"), (None, "only null"), (7, "twice"), (7, "twice"), (8, "twi ce"), (6, "twi ce"), (6, "twi ce")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def plain_duplicates(rows):
    """Per group: keep_id and size; and how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {sha(t): (min(g)[3], len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("sizes", [{}, {"run_rows": 3, "chain": 2}, {"bits": 2, "chain": 3, "capacity": 1}, {"bits": 0, "run_bytes": 1}, {"capacity": 4, "run_rows": 2, "chain": 5}])
def test_groups_equal_a_plain_grouping(spark, sizes):
    docs = copies(spark)
    rows = [tuple(r) for r in docs.collect()]
    got = xh.exact_duplicates(docs, **sizes).collect()
    want = plain_duplicates(rows)
    ids = {}
    for i, t in rows:
        ids.setdefault(sha(re.sub(r"[\x20\x09-\x0D]", "", t or "")), []).append(i)
    assert len(got) == len(rows)
    for key, own in ids.items():
        mine = [r for r in got if r.text_sha256 == key]
        assert sorted(map(repr, own)) == sorted(repr(r.doc_id) for r in mine)
        assert {(r.keep_id, r.group_size) for r in mine} == {want[key]}
        assert [r.doc_id for r in mine if r.kept] == [want[key][0]]


def test_duplicates_equal_their_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    same_as_sql(xh.exact_duplicates(docs), docs, oracles.OP11)
    same_as_sql(fim.fim_digests(docs), docs, oracles.OP12)


def test_directory_covers_all_keys_within_capacity(spark):
    keys = spark.range(3000).select(F.shiftright(F.xxhash64("id"), 1).bitwiseAND((1 << 63) - 1).alias("key"))
    keys = keys.unionByName(spark.range(50).select((F.lit(1 << 61) + F.col("id")).alias("key"))).distinct()
    buckets = xh.directory(keys, 40).collect()
    assert sum(b.n for b in buckets) == keys.count() and max(b.n for b in buckets) <= 40
    # fifty neighbouring keys share 57 bits: their buckets are that deep, others aren't, and no range meets another
    assert max(b.depth for b in buckets) >= 57
    spans = sorted((b.prefix << (63 - b.depth), (b.prefix + 1) << (63 - b.depth)) for b in buckets)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    placed = xh.with_bucket(keys, xh.directory(keys, 40))
    assert placed.count() == keys.count() and placed.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 40
    assert xh.directory(keys.limit(0)).count() == 0


def test_other_columns_and_empty_tables(spark):
    docs = copies(spark)
    extra = docs.select("*", *[F.lit("x").alias(c) for c in [*CLASHES, "entry", "sha", "chars", "best", "at", "members", "rest", "h0", "N", "output", "form", "_"]])
    for f in (xh.exact_duplicates, fim.fim_digests):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(extra).collect()))
        assert f(extra.limit(0)).count() == 0
    out = fim.fill_in_middle(extra)
    assert set(out.columns) == (set(extra.columns) - {"text", "N"}) | {"n", "form", "prefix_chars", "middle_chars", "output"}
    assert all(r["_"] == "x" and r.rest == "x" and r.output != "x" for r in out.collect())


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_middles_equal_a_plain_cut(spark):
    rng = np.random.default_rng(8)
    letters = ["a", "é", "€", "\U0001f600", " ", "<", "P", ">", "S", "M", "\n"]
    texts = ["".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(0, 3000)))) for _ in range(150)]
    texts = [re.sub("<(?=[PSM]>)", "(", t) if i % 3 else t for i, t in enumerate(texts)] + ["<", "<P", "<P>", "", None, "x" * 1024, "é" * 512, "é" * 2_000_000]
    rows = [*enumerate(texts), (None, "null id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.fim_digests(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_fim(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_cuts_by_words_equal_plain_counting(block):
    rng, pattern = np.random.default_rng(1), re.compile(fim.WORDS)
    for _ in range(60):
        text = "".join(" \naé€x"[k] for k in rng.integers(0, 6, int(rng.integers(0, 60)))).encode()
        index = fim.BlockIndex(text, pattern, block)
        ends = [0, *(m.end() for m in pattern.finditer(text))]
        assert index.n_units == len(ends) - 1 and index.n_chars == len(text.decode())
        assert [index.cut(u) for u in range(len(ends))] == [(e, len(text[:e].decode())) for e in ends]
        index = fim.BlockIndex(text, None, block)
        assert [index.cut(u)[0] for u in range(index.n_units + 1)] == [len(text.decode()[:u].encode()) for u in range(index.n_units + 1)]


def test_cuts_by_words_restore_the_text(spark):
    docs = spark.createDataFrame([(i, "  alpha beta é gamma\n" * i) for i in range(40)], "doc_id long, text string")
    out = fim.fill_in_middle(docs, unit=fim.WORDS, block=16).select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == "  alpha beta é gamma\n" * r.doc_id and r.n == 4 * r.doc_id for r in out)
    for r in out:
        if r.form != "plain" and 0 < r.prefix_chars < len(r.back):
            assert r.back[r.prefix_chars - 1] in " \n" or r.back[r.prefix_chars - 1 :].isspace()


def test_long_texts_take_time_in_proportion(spark):
    make = lambda n: spark.createDataFrame([(1, "é word " * n)], "doc_id long, text string")
    for f in (xh.exact_duplicates, fim.fim_digests):
        timed(lambda: f(make(10)).collect())
        assert timed(lambda: f(make(800_000)).collect()) < 8 * timed(lambda: f(make(200_000)).collect()) + 5


def vectors(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def checked(rows, got, k):
    """Rows of the result against numpy's own eigenvectors."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    some = [j for j in range(k) if values[j] > len(cov) * np.finfo(float).eps * values[0]]
    assert len(got) == n * k
    by = {(r.vec_id, r.component): r for r in got}
    out = np.array([[by[i, j + 1].whitened if j in some else 0.0 for j in range(k)] for i, _ in rows])
    assert all((by[i, j + 1].whitened is None) == (j not in some) for i, _ in rows[:3] for j in range(k))
    want = c @ basis[:, :k] / np.sqrt(np.where([j in some for j in range(k)], np.maximum(values[:k], 1e-300), np.inf))
    out, want = out[:, some], want[:, some]
    assert np.allclose(out * np.sign((out * want).sum(0)), want, atol=1e-6)
    for r in got:
        if r.component - 1 in some:
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.n == n and (r.identity_error is None if not some else r.identity_error < 1e-6)
    assert [by[i, 1].deviation for i, _ in rows] == [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))) for v in x]
    assert np.abs(out.T @ out / n - np.eye(len(some))).max(initial=0) < 1e-6


@pytest.mark.parametrize("block", [1, 256])
@pytest.mark.parametrize("n,d", [(400, 12), (300, 40), (5, 12), (2, 3), (1, 3), (60, 1)])
def test_whitening_equals_numpy(spark, n, d, block):
    rng = np.random.default_rng(n + d)
    mix = rng.normal(size=(d, d)) * np.geomspace(30, 0.3, d)
    data = rng.normal(size=(n, d)) @ mix
    if d > 5:
        data[:, 3] = 2.5  # a constant column
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(data)]
    bad = [(-1, None), (-2, [float("nan")] * d), (-3, [float("inf")] * d), (-4, [None] * d), (-5, [1.0] * (d + 1))] if n > 1 else []
    got = white.whitened(vectors(spark, rows + bad), block=block).collect()
    checked(rows, got, min(32, d))


def test_whitening_of_awkward_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 50 if i % 7 else None, [float(v) for v in rng.normal(size=4)]) for i in range(200)] + [(500, [1.0, 2.0, 3.0, 4.0])] * 100
    got = white.whitened(vectors(spark, rows)).collect()
    assert len(got) == 4 * len(rows) and sum(r.vec_id == 500 for r in got) == 400
    assert max(r.identity_error for r in got) < 1e-9
    extra = vectors(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("v", "component", "n", "part", "spectrum", "Deviation")])
    assert white.whitened(extra).count() == len(got)
    same = [(i, [1.0, 2.0]) for i in range(9)]
    assert all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in white.whitened(vectors(spark, same)).collect())
    for empty in ([], [(1, None)], [(1, [])]):
        frame = white.whitened(vectors(spark, empty, 1))
        assert frame.count() == 0 and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(4)]
    assert len(white.whitened(vectors(spark, huge)).collect()) == 8


def test_equal_eigenvalues_make_one_basis(spark):
    rows = [(8 * i + 2 * j + s, [float((1 - 2 * s) * (j == k)) for k in range(4)]) for i in range(20) for j in range(4) for s in range(2)]
    got = white.whitened(vectors(spark, rows)).collect()
    assert max(r.identity_error for r in got) < 1e-9 and {round(r.explained, 9) for r in got} == {0.25}


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(0)
    for d in (1, 2, 9, 33):
        x = rng.normal(size=(80, d)) * rng.uniform(0.01, 9, d)
        x[:, : d // 3] = np.round(x[:, : d // 3])
        parts = []
        for half in (x[:40], np.repeat(x[40:50], 3, axis=0)):
            found = (np.zeros(d), np.eye(d))
            for v in half:
                found = white.rank_one(*found, v)
            parts.append(found)
            assert np.abs(found[1] @ np.diag(found[0]) @ found[1].T - half.T @ half).max() < 1e-10 * found[0].max()
            assert np.abs(found[1].T @ found[1] - np.eye(d)).max() < 1e-12
        both = white.combined(*parts)
        want = x[:40].T @ x[:40] + 3 * x[40:50].T @ x[40:50]
        assert np.allclose(both[0], np.linalg.eigvalsh(want), atol=1e-10 * both[0].max())


def test_references_to_a_hot_payload_are_dealt(spark):
    from eventide.llm import op02_media_sequences as media

    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i % 40}") for i in range(600)] + [(None, None), (None, "hot")], "doc_id long, text string")
    facts = media.described(media.media_table(docs))
    assert {r.copies for r in facts.collect() if r.n_bytes == 3} == {401}
    digest = facts.filter("n_bytes = 3").first().digest
    items = spark.createDataFrame([(i, [(0, "media", None, f"{media.SCHEME}{digest if i % 2 else 'none'}", f"c{i}")]) for i in range(300)], f"id long, items array<{media.ITEM}>")
    one, many = (sorted(map(tuple, media.resolved(items, facts, ["n_bytes"], hot).select("id", "pos", "caption", "digest", "n_bytes").collect())) for hot in (1000, 7))
    assert one == many and len(one) == 300 and sum(r[-1] == 3 for r in one) == 150 and all(r[2] == f"c{r[0]}" for r in one)
