"""Media, near-duplicates, decontamination, quality, toxicity and language model on small and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import op01_toxicity as tox
from eventide.llm import op02_media_sequences as media
from eventide.llm import op04_recurrent_lm as lm
from eventide.llm import op06_importance_resampling as dsir
from eventide.llm import op07_circulant_minhash as mh
from eventide.llm import op09_decontaminate as dec
from tests.llm import brute

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def edited(t, *at):
    words = t.split(" ")
    for i in at:
        words[i] = f"new{i}"
    return " ".join(words)


def near_rows():
    rows, base = [], text(1, 200)
    for i in range(40):  # copies with two edits each: linked to the original only
        rows.append((100 + i, edited(base, 3 * i + 2, 199 - 2 * i)))
    rows += [(500, base), (7, base.upper().replace(" ", "\t ")), (None, base), (3, text(2, 4)), (4, text(2, 4)), (5, ""), (6, None), (8, " \n"), (9, "one"), (9, "one"), (10, text(3, 5000)), (11, edited(text(3, 5000), 10, 2000))]
    rows += [(600 + i, text(50 + i, 60) + " " + text(9, 55)) for i in range(25)]  # a passage in common
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, kept int, fp int").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.near_duplicates(docs).collect()), key=repr)
    assert got == sorted((x[:3] for x in brute.near(rows)), key=repr)
    left = mh.first_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {3, 5, 6, 7, 8, 9, 10}
    assert mh.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_at_a_lower_similarity(spark):
    rows = near_rows() + [(1000 + 10 * i + j, edited(text(70 + i, 300), *range(j, 300, 43 - 2 * j)) if j else text(70 + i, 300)) for i in range(8) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.near_duplicates(docs, 70).collect()), key=repr)
    assert got == sorted((x[:3] for x in brute.near(rows, 70)), key=repr)
    assert mh.banding(85) == (6, 28) and mh.banding(80) == (5, 34)
    assert mh.most_different(85) == 118 and mh.most_different(80) == 150


def test_one_row_of_each_component_stays(spark):
    base, other, third = text(1, 200), text(2, 200), text(3, 200)
    rows = [
        (1, base, "a"), (None, edited(base, 5), "b"), (None, other, "c"),  # one of two null-id rows is linked
        (None, third, "d"), (None, third, "e"), (None, edited(third, 9), "f"),  # a group of null ids
        (4, text(4, 200), "g"), (4, text(4, 200), "h"), (4, text(5, 200), "i"),  # a repeated row; its id on a text of its own
        (6, base, "j"), (6, text(6, 200), "k"), (7, "", "l"), (None, None, "m"), (None, "", "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(4)
    left = mh.first_of_each(docs)
    assert left.columns == docs.columns
    marks = {r.mark for r in left.collect()}
    assert marks - set("defgh") == set("aciklmn") and len(marks & set("def")) == 1 and len(marks & set("gh")) == 1
    assert left.count() == len(marks) == 9 and mh.first_of_each(docs.limit(0)).count() == 0


def test_circulant_signature_estimates_jaccard():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    x, y = a[:2600], a[400:]
    same = (mh.signature(x, 1024) == mh.signature(y, 1024)).mean()
    assert abs(same - 2200 / 3000) < 0.06


def test_decontamination_equals_brute_force(spark, sf_dir):
    items = [(1, text(1, 30)), (2, "Just, four words here"), (3, ""), (4, None), (None, text(5, 12)), (5, text(1, 30)[:60])]
    rows = [(1, f"x {text(1, 30)} y"), (2, "say: JUST four-words HERE! just four words here"), (3, None), (4, ""), (5, text(1, 9)), (None, text(5, 12)), (6, text(1, 30).replace(" ", " é ", 15))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:-1] for r in dec.decontaminate(docs, bench).collect()), key=repr)
    named = [(i, t) for i, t in items if i is not None]
    want = []
    for i, t in rows:
        n, hit, *_, flag = brute.contaminated(t, items)
        want.append((i, n, hit, *brute.contaminated(t, named)[2:4], flag))
    assert got == sorted(want, key=repr)
    assert {r.doc_id for r in dec.clean(docs, bench).collect()} == {w[0] for w in want if not w[-1]}
    assert dec.decontaminate(docs.limit(0), bench).count() == 0 and dec.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    index = dec.Index([(1, b"alpha beta")])
    assert dec.hit_spans("é Alpha, beta; alpha".encode(), index) == [(2, 13)]


def test_html_sequences_keep_positions_and_captions():
    html = "<html><script>x</script><p>One &amp; two</p><figure><figcaption>cap</figcaption><img src='a'></figure>t<img src=b alt=alt><br>end<img></html>"
    assert [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse(html)] == [(0, "text", "One & two", None), (1, "media", "a", "cap"), (2, "text", "t", None), (3, "media", "b", "alt"), (4, "text", "end", None)]
    assert media.parse(None) == [] == media.parse("")


def test_media_columns_round_trip(spark):
    texts = [None, "", "a", "a", "é" * 288, "x" * 577, "<b>&amp;\n<img src='q'>\n" * 50, "z" * 200_000]
    docs = spark.createDataFrame([(i if i else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id or 0] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        stored = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.caption) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{len(data)} bytes")
    assert media.media_columns(docs.limit(0)).count() == 0
    items = media.sequences(spark.createDataFrame([(1, "<p>a</p><img src='digest:none'>")], "page_id long, html string"), "page_id")
    assert media.resolved(items, media.described(media.media_table(docs)), ["n_bytes"]).first().n_bytes is None


def test_html_pages_of_the_driver(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = media.sequences(pages, "page_id").collect()
    assert len(got) == pages.count() and all([x.pos for x in r["items"]] == list(range(len(r["items"]))) for r in got)


def labelled(spark, n=600):
    rng, rows, labels = np.random.default_rng(4), [], []
    for i in range(n):
        bad, rude = i % 7 == 0, i % 5 == 0
        words = [WORDS[k] + ("***" if bad else "") for k in rng.integers(0, 400, 40 + i % 60)]
        if rude:
            for k in range(4):
                words[k * 7] = ["idiot", "scum", "moron"][(i + k) % 3]
        rows.append((i, " ".join(words), 1))
        labels.append((i, 0 if bad else 1, int(rude)) if i % 2 == 0 else (i, None, None))
    rows += [(n, None, 1), (None, "", 1), (3, rows[3][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_keeps_good_and_drops_bad(spark):
    docs, labels = labelled(spark)
    rows = dsir.resample(docs, labels.filter("quality is not null")).collect()
    assert len(rows) == docs.count()
    bad = [r.kept for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 7 == 0]
    good = [r.kept for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 7]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    assert dsir.keep_good(docs, labels).columns == docs.columns
    assert dsir.resample(docs.limit(0), labels).count() == 0
    assert all(r.kept and r.log_weight == 0 for r in dsir.resample(docs, labels.limit(0)).collect())


def test_long_clean_texts_stay_beside_short_junk(spark):
    rows = [(i, 20_000, -2_000.0) for i in range(50)]  # mean -0.1
    rows += [(100 + i, 10, -30.0) for i in range(200)] + [(400 + i, 10, 1.0) for i in range(50)] + [(500, 0, 0.0), (501, 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, _n long, _w double")
    kept = {r.doc_id for r in dsir.with_decision(docs).filter("_kept").collect()}
    assert kept == {i for i, n, w in rows if w >= -0.2 * n}


def test_toxicity_on_texts_outside_of_the_labels(spark):
    docs, labels = labelled(spark)
    rows = tox.classify(docs, labels).collect()
    unseen = [(r.toxic, r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 600]
    assert np.mean([a == b for a, b in unseen]) > 0.97
    assert tox.classify(docs.limit(0), labels).count() == 0
    assert not any(r.toxic for r in tox.classify(docs, labels.limit(0)).collect())


def test_language_model_counts_and_beats_its_base(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(400):
        words, k = [], int(rng.integers(0, 50))
        for _ in range(int(rng.integers(0, 90))):
            k = (k * 3 + int(rng.integers(0, 2))) % 50
            words.append(f"S{k}" if rng.random() < 0.97 else f"rare{rng.integers(0, 10**6)}")
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (None, "S1 s1"), (1002, "unseen words only")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score(docs).collect()
    by = {i: t for i, t in rows}
    for r in got:
        w = tokens(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    out = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 10
    assert lm.score(docs.limit(0)).count() == 0


def symbols_of(docs):
    rows = docs.select("doc_id", "text")
    v = lm.vocabulary(lm.word_counts(rows.filter(~lm.held_out())))
    return v, lm.numbered(rows, v)


def test_every_training_document_is_trained_on_once(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)

    class Noting:
        def __init__(self, p):
            self.p = p

        def learn(self, docs, classes):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(f"{int(d[0])}\n" for d in docs)

    monkeypatch.setattr(lm, "Learner", Noting)
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(200)], "doc_id long, text string").repartition(3)
    v, facts = symbols_of(docs)
    lm.fitted(facts.filter(~lm.held_out()), v)
    seen = sorted(int(x) for f in tmp_path.iterdir() for x in f.read_text().split())
    place = {w: i for i, w in enumerate(v.words.to_pylist())}
    assert seen == sorted(place[f"w{r.doc_id}"] for r in docs.filter(~lm.held_out()).collect())


def plain_score(v, p, text):
    """Base-10 log-likelihood of a text, symbol by symbol."""
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    place = {w: i for i, w in enumerate(v.words.to_pylist())}
    n, h, fed, total = lm.HIDDEN, np.zeros(lm.HIDDEN), None, 0.0
    for w in [*(x.decode() for x in text.encode().lower().split()), " end"]:
        i = place.get(w, len(place))
        tail = int(lm.tail_classes(pa.array([w]))[0])
        a = p["g"] + (0 if fed is None else p["x"][fed])
        z, r = np.split(sigmoid(h @ p["h"][:, : 2 * n] + a[: 2 * n]), 2)
        h = h + z * (np.tanh((r * h) @ p["h"][:, 2 * n :] + a[2 * n :]) - h)
        fed = i if i < v.head else lm.HEAD + tail
        share = lambda logits, k: logits[k] - np.log(np.exp(logits).sum())
        if i < v.head:
            k = i // lm.CLASS_SIZE
            total += share(h @ p["c"] + p["d"], k) + share(h @ p["w"][k] + p["b"][k], i % lm.CLASS_SIZE)
        else:
            total += share(h @ p["c"] + p["d"], v.classes + tail)
            total += math.log((v.count[i] if i < len(place) else 0) + 1) - v.tail_log[tail] * math.log(10)
    return total / math.log(10)


def test_scores_are_those_of_a_plain_network(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "  ".join(f"W{int(k * k)}" for k in rng.integers(0, 14, int(rng.integers(0, 200))))) for i in range(60)]
    rows += [(70, "\u00e9t\u00e9 \u0130 x\ty\n"), (71, " "), (72, "Unseen " * 300), (None, "W1 W4")]
    rows += [(80, " ".join(f"Z{i}" for i in range(1500))), (81, " ".join(f"Z{i * 5}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v, facts = symbols_of(docs)
    p = lm.fitted(facts.filter(~lm.held_out()), v)
    again = lm.fitted(facts.filter(~lm.held_out()).repartition(7), v)
    assert all(np.array_equal(p[k], again[k]) for k in p)
    by = dict(rows)
    for r in lm.score(docs).collect():
        assert r.score == pytest.approx(plain_score(v, p, by[r.doc_id]), rel=1e-4), r.doc_id


def test_words_are_split_as_stated():
    texts = ["", None, " a  B\t\x0bc\x0c\r\nd ", "\u00a0x\u2003y \x1cz\x00", "\u00c9A"]
    words, sizes = lm.split_words(pa.array(texts))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert list(sizes) == [len(w) for w in want]
    assert [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]


def test_backpropagation_through_a_window_is_right():
    v, rng = some_vocabulary(), np.random.default_rng(6)
    start = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    docs = [rng.integers(0, 40, n).astype(np.int16) for n in (9, 4, 7, 1)]
    [(before, xs, owner, first)] = lm.windows_of(docs, 2)
    grads, _, _ = lm.gradients(start, before, xs, owner, first, np.zeros((2, lm.HIDDEN)), v.classes)
    loss = lambda p: -lm.likelihoods(p, docs, v.classes).sum() * math.log(10)
    for k, at in (("x", (int(docs[0][0]), 3)), ("h", (2, 5)), ("h", (1, 40)), ("g", (20,))):
        up, down = ({**start, k: start[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=0.02)


def some_vocabulary():
    return lm.Vocabulary([f"w{i}" for i in range(40)], [50 - i for i in range(40)], 2000, 60, {0: (30, 10), 5: (9, 3)})


def test_gates_are_whole_blocks_and_may_be_shut():
    rng = np.random.default_rng(4)
    n = lm.HIDDEN
    p = {"x": rng.normal(size=(lm.HEAD + lm.TAIL_CLASSES, 3 * n)).astype(np.float32) * 1e4, "h": rng.normal(size=(n, 3 * n)).astype(np.float32), "g": np.zeros(3 * n, np.float32)}
    before, first = rng.integers(0, lm.HEAD, (5, 6)), np.zeros((5, 6), bool)
    first[0] = first[3, 2] = True
    with np.errstate(all="raise", under="ignore"):
        states, h, (_, z, r, _, _) = lm.run_window(p, before, first, before, np.zeros((6, n), np.float32), True)
    assert all(a[t].flags.c_contiguous for a in (z, r) for t in range(5))
    want = np.zeros((6, n))
    for t in range(5):
        want[first[t]] = 0
        a = np.where(first[t][:, None], 0.0, p["x"][before[t]]).astype(float)
        gate = 1 / (1 + np.exp(-np.clip(a[:, : 2 * n] + want @ p["h"][:, : 2 * n], -700, 700)))
        c = np.tanh(a[:, 2 * n :] + (gate[:, n:] * want) @ p["h"][:, 2 * n :])
        want = want + gate[:, :n] * (c - want)
        assert states[t] == pytest.approx(want, abs=1e-4)
    assert h == pytest.approx(want, abs=1e-4)


def test_language_model_is_a_distribution_and_gradients_are_right():
    v = some_vocabulary()
    p = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    s = np.random.default_rng(0).standard_normal((1, lm.HIDDEN))
    every = np.array([*range(40), *range(lm.HEAD, lm.HEAD + lm.TAIL_CLASSES)])
    logs, _ = lm.outputs(p, np.repeat(s, len(every), axis=0), every, v.classes)
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-6)
    y = np.array([3, 39, lm.HEAD + 2])
    states = np.random.default_rng(1).standard_normal((3, lm.HIDDEN))
    grads = {k: np.zeros_like(x) for k, x in p.items()}
    _, ds = lm.outputs(p, states, y, v.classes, grads)
    for k, at in (("c", (2, 1)), ("w", (0, 3, 3)), ("b", (1, 7))):
        eps = 1e-5
        p[k][at] += eps
        up = -lm.outputs(p, states, y, v.classes)[0].sum()
        p[k][at] -= 2 * eps
        down = -lm.outputs(p, states, y, v.classes)[0].sum()
        p[k][at] += eps
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_documents_in_lanes_score_as_alone():
    v = some_vocabulary()
    p, rng = lm.start_weights(v), np.random.default_rng(3)
    docs = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 200, 3, 77, 150, 2)]
    together = lm.likelihoods(p, docs, v.classes)
    assert together == pytest.approx([lm.likelihoods(p, [d], v.classes)[0] for d in docs], rel=1e-4)


def test_windows_hold_each_document_once_and_in_order():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 3, 700, 48, 49, 96, 2, 5)]
    seen, begun = [[] for _ in docs], np.zeros(len(docs), int)
    for before, x, owner, first in lm.windows_of(docs, 3):
        assert before.shape == x.shape == owner.shape == first.shape
        for lane in range(x.shape[1]):
            for t in np.flatnonzero(owner[:, lane] >= 0):
                k = owner[t, lane]
                assert first[t, lane] == (not seen[k]) and (first[t, lane] or before[t, lane] == seen[k][-1])
                begun[k] += first[t, lane]
                seen[k].append(x[t, lane])
    assert [list(d) for d in docs] == seen and (begun == 1).all()
    assert not list(lm.windows_of([]))


def test_sent_words_are_the_most_frequent_and_do_not_change_scores(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "ROUNDS", 1)
    counts = lm.word_counts(docs.filter(~lm.held_out()))
    every = {r.word: r.c for r in counts.select("word", "c").collect()}
    few, scores = 2500, []
    for sent in (lm.SENT, few):
        monkeypatch.setattr(lm, "SENT", sent)
        v = lm.vocabulary(counts)
        words = v.words.to_pylist()
        assert [every[w] for w in words] == v.count.tolist() and all(a >= b for a, b in zip(v.count, v.count[1:]))
        scores.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(docs).collect()})
    assert abs(len(words) - few) < 200 and len(words) < len(every)
    assert max(c for w, c in every.items() if w not in set(words)) <= v.count[-1] * 2 ** (1 / 16)
    assert all(every[w] > v.count[-1] for w in words[: lm.HEAD])
    for i, row in scores[0].items():
        assert scores[1][i] == pytest.approx(row, rel=1e-3)


def test_one_common_level_does_not_shrink_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT", 100)
    counts = spark.createDataFrame([(f"w{i}", 5, 0) for i in range(1000)] + [("top", 900, 1)], "word string, c long, tail int")
    v = lm.vocabulary(counts)
    assert v.words[0].as_py() == "top" and 60 < len(v.words) < 140 and v.head == len(v.words)


def test_pieces_of_a_batch_are_its_rows_in_runs_of_bounded_text():
    import pyarrow as pa

    from eventide.llm import op04_recurrent_lm as op4

    texts = [None, "", "a" * 400_000, "b" * 700_000, "c" * 3_000_000, "", None, "d"] + ["e f " * 50_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = list(op4.pieces(batch, 1))
    assert [x for p in found for x in p.column(0).to_pylist()] == list(range(len(texts))) and len(found) > 4
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()[:-1]) <= op4.PIECE + 3_000_000 for p in found)
    assert not list(op4.pieces(batch.slice(0, 0), 1))


def test_places_build_no_table_of_all_sent_words(monkeypatch):
    from eventide.llm import op04_recurrent_lm as lm

    v = lm.Vocabulary([f"w{i}" for i in range(5000)], list(range(5000, 0, -1)), 12_502_500, 5000, {})
    real, sizes = lm.pc.index_in, []

    def index_in(values, *, value_set):
        sizes.append(len(value_set))
        return real(values, value_set=value_set)

    monkeypatch.setattr(lm.pc, "index_in", index_in)
    assert v.places(lm.pa.array(["w7", "other", "w4999", "w7"])).tolist() == [7, -1, 4999, 7] and sizes == [3]
    assert v.places(lm.pa.array([], lm.pa.string())).tolist() == []
