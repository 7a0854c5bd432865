from collections import Counter

import numpy as np
import pytest
from helpers import SF_CHECK

from marketgrid.llm import near_dedup as nd
from marketgrid.llm.components import components
from marketgrid.operators import lineage

from .conftest import odd_rows


def brute(docs, n, percent):
    """doc_id -> (size, component) by comparing every pair that shares a shingle."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen: dict = {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in seen.get(s, ()))
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_against_all_pairs(spark, n):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, 80)
    for r in nd.near_duplicates(docs, n, 80).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(odd, empty):
    rows = odd_rows()
    expected = brute([(r[0], r[1]) for r in rows], 2, 80)
    got = nd.near_duplicates(odd, 2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    kept = nd.keep_one(odd, 2)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}
    assert nd.near_duplicates(empty).count() == 0 and nd.keep_one(empty).count() == 0


@pytest.mark.parametrize("small, block", [(24, 2000), (2, 16)])
def test_chain_and_large_group(spark, monkeypatch, small, block):
    """Links that do not pass through the leader of a bucket, and hundreds of
    near copies, with buckets compared by joins and by blocks."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):                       # near copies of one text
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(4, 16)):
            w[k] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    for i in range(12):                        # each like the next, the ends unlike
        rows.append((1000 + i, " ".join(chain[i * 12:i * 12 + 200])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(df, 2).collect()} == {
        i: c for i, (_, c) in expected.items()}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    found = []
    for _ in range(40):
        x = rng.integers(1, 1 << 63, 700, dtype=np.uint64)
        a, b = x[:600], x[200:]
        r = nd.registers([a, b, x])
        assert (nd.merge(r[0], r[1]) == r[2]).all()
        found.append(nd.likely_similarity(r[:1], r[1:2], np.array([600.]), np.array([500.]))[0])
    assert abs(np.mean(found) - 400 / 700) < 0.03


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in
           components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[159] == 100 and got[300] == 200


def test_small_results_have_few_files(spark, monkeypatch):
    """Pairs are compared in many tasks, as the sets are large; the table of
    the results is small, and so is the number of its files."""
    files, write = {}, lineage.materialize

    def noted(df):
        out = write(df)
        files[tuple(out.columns)] = len(out.inputFiles())
        return out

    monkeypatch.setattr(nd, "materialize", noted)
    monkeypatch.setattr(lineage, "materialize", noted)
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
             "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        nd.near_duplicates(spark.read.parquet(f"{SF_CHECK}/documents.parquet"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files[("doc_id", "elements", "short", "regs")] > 3, files
    assert files[("a", "b", "both", "either")] == 1, files
