"""Mixing against a plain water-fill and the contract's bounds."""

import pytest

from eventide.llm.op03_mixing import mix


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return out


@pytest.mark.parametrize("skew", [1, 40])
def test_mix_meets_targets(spark, skew):
    rows = []
    for i in range(3000):
        source = [None, "a", "b", "é", "src0", "z"][i % 6]
        words = (i * 7919) % 23 + (skew * 5 if source == "src0" else 0)
        rows.append((i if i % 500 else None, source, " ".join(["w"] * words) if i % 97 else None, 1, 2))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, taken int").repartition(5)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, said = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        said[r.source] = (r.source_size, r.target)
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for s in sizes:
        assert said[s][0] == sizes[s] and said[s][1] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 250
    again = {(r.doc_id, r.source, r.size, r.taken) for r in mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.source, r.size, r.taken) for r in got}


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    rows = mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()
    assert sorted((r.size, r.target, r.taken) for r in rows) == [(0, 0.0, 0), (0, 0.0, 0)]
