from helpers import SF_SMALL

import corpus_pipeline as cp

from .conftest import odd_rows
from .test_near_dedup import brute as near_brute
from .test_substrings import brute as passage_brute
from .test_substrings import words


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    good = stages["quality rules"](spark, docs, SF_SMALL).cache()
    known = stages["language ID"](spark, good, SF_SMALL).cache()
    single = stages["near-dedup"](spark, known, SF_SMALL).cache()
    cut = stages["substring dedup"](spark, single, SF_SMALL).cache()
    assert good.columns == known.columns == single.columns == cut.columns == columns
    rows = {r.doc_id: r.text for r in known.collect()}
    groups = near_brute(list(rows.items()), 5, 80)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == {i for i, (_, c) in groups.items() if i == c}
    expected = passage_brute(list(left.items()), 50, words)
    for r in cut.collect():
        _, gone, _, kept = expected[r.doc_id, left[r.doc_id]]
        assert r.text == (b" ".join(kept).decode() if gone else left[r.doc_id])
        assert r.n_chars == len(r.text)
    packed = stages["packing"](spark, cut, SF_SMALL)
    assert {r.doc_id: r.n_tokens for r in packed.collect()} == {
        r.doc_id: len(r.text.encode().split()) for r in cut.collect()}
    assert cp.run(spark, SF_SMALL).count() == len(left)


def test_odd_rows(spark, odd, empty):
    for df, n in ((odd, len(odd_rows())), (empty, 0)):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF_SMALL)
            assert name == "packing" or out.columns == df.columns
            assert out.count() <= n
