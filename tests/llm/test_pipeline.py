"""The pipeline's stages on the smallest driver tables, each against what its own input calls for."""

import corpus_pipeline as cp
from eventide.llm import queries
from tests.llm import brute


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs.cache()]
    for name, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
        if name != "mixing":
            assert frames[-1].columns == columns
    start, good, single, clean, safe, mixed = ({r.doc_id: r for r in f.collect()} for f in frames)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [i in good for i, q in labels.items() if i in start and q == 1]
    gone = [i not in good for i, q in labels.items() if i in start and q == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.9 * len(gone)
    assert set(single) == {i for i, _, _, k in brute.near([(i, r.text) for i, r in good.items()], 80) if k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, r in single.items() if not brute.contaminated(r.text, items)[-1]}
    assert set(safe) == set(clean)
    for i, r in safe.items():
        found = sum(brute.secrets(clean[i].text)[:3])
        assert sum(brute.secrets(r.text)[:3]) == 0 and (r.text == clean[i].text) == (found == 0) and r.n_chars == len(r.text)
    assert set(mixed) <= set(safe) and all(0 < r.taken <= 3 * r.size for r in mixed.values() if r.size)


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontamination", "secret_scan", "mixing"]
