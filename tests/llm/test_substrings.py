import random

import numpy as np
import pytest
from helpers import SF_CHECK

from marketgrid.llm import bwt_dedup as bw
from marketgrid.llm import substring_dedup as sd

from .conftest import odd_rows


def brute(docs, size, cut):
    """doc_id -> (text, kept parts, removed, spans); ``cut`` makes the parts."""
    first: dict = {}
    for i, t in docs:
        p = cut(t)
        for k in range(len(p) - size + 1):
            w = p[k:k + size]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        p = cut(t)
        gone = np.zeros(len(p) + 1, bool)
        for k in range(len(p) - size + 1):
            if first[p[k:k + size]] < i:
                gone[k:k + size] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]).sum())
        out[i, t] = (len(p), int(gone.sum()), spans, [x for x, g in zip(p, gone) if not g])
    return out


def words(t):
    return tuple((t or "").encode().split())


def raw(t):
    return (t or "").encode()


def check_words(df, rows, size, bytes_each):
    expected = brute(rows, size, words)
    got = sd.repeated(df, size, bytes_each).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, _, kept = expected[r.doc_id, r.text]
        assert (r._n_words, r._n_removed, r._kept.encode()) == (n, gone, b" ".join(kept))


def check_bytes(df, rows, size, bytes_each, many_blocks=2):
    expected = brute(rows, size, raw)
    got = bw.repeated(df, size, bytes_each, many_blocks).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, spans, kept = expected[r.doc_id, r.text]
        assert (r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) == (n, gone, spans, bytes(kept))


@pytest.mark.parametrize("bytes_each", [4 << 20, 100_000])
def test_words_of_documents(spark, bytes_each):
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    check_words(df, [tuple(r) for r in df.collect()], 50, bytes_each)


@pytest.mark.parametrize("bytes_each", [2 << 20, 100_000])
def test_bytes_of_documents(spark, bytes_each):
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    check_bytes(df, [tuple(r) for r in df.collect()], 50, bytes_each)


@pytest.mark.parametrize("size", [2, 5, 8, 13])
def test_small_alphabet(spark, size):
    rng = random.Random(size)
    rows = [(k, " ".join(rng.choice(["a", "b", "é"]) for _ in range(rng.randint(0, 40))))
            for k in range(90)]
    rows += [(200, None), (201, ""), (3, "a b a b a b a b a b a b a b a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for bytes_each in (1 << 20, 400):
        check_words(df, rows, size, bytes_each)
        check_bytes(df, rows, size, bytes_each)


def test_odd_rows(odd, empty):
    rows = [(r[0], r[1]) for r in odd_rows()]
    check_words(odd, rows, 50, 3000)
    check_bytes(odd, rows, 50, 3000)
    out = sd.remove_repeated(odd)
    assert out.columns == odd.columns and out.count() == len(rows)
    expected = brute(rows, 50, words)
    by_id = {i: (t, expected[i, t]) for i, t in rows}
    for r in out.collect():
        t, (_, gone, _, kept) = by_id[r.doc_id]
        assert r.text == (b" ".join(kept).decode() if gone else t)
    assert sd.repeated(empty).count() == 0 and bw.repeated(empty).count() == 0


@pytest.mark.parametrize("size", [4, 7, 50])
def test_merged_shards_give_the_intervals(size):
    rng = random.Random(size)
    snippets = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(size, size + 30)))
                       for _ in range(200)})
    owners = np.array([rng.randrange(1000) for _ in snippets])
    first: dict = {}
    for s, o in zip(snippets, owners):
        for k in range(len(s) - size + 1):
            first[s[k:k + size]] = min(first.get(s[k:k + size], 10 ** 6), o)
    for shard_bytes in (64, 1000, 10 ** 6):
        for s, least in zip(snippets, bw.smallest_owner(snippets, owners, size, shard_bytes)):
            assert least.tolist() == [first[s[k:k + size]] for k in range(len(s) - size + 1)]


def test_more_blocks_than_buckets_allowed(spark, monkeypatch):
    """Over 100,000 blocks in few files; half of the rows without a doc_id and
    many of one doc_id spread over them."""
    from marketgrid.llm import blocks
    monkeypatch.setattr(blocks, "FILES", 8)
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(None if k % 2 else 7 if k % 4 else k, f"own{k} " * 30 + (passage if k % 3 else "") + f" tail{k}" * 20)
            for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    size = sum(len(t) for _, t in rows)
    each = max(1, size // 120_000)
    far = 10 ** 12
    check = {(i, t): v for (i, t), v in brute([(far if i is None else i, t) for i, t in rows], 50, words).items()}
    made = blocks.Blocks(df, each)
    assert made.count > 100_000
    dealt = made.table.groupBy("_block").count().collect()
    assert max(r["count"] for r in dealt) <= 4 and len(dealt) > 120
    got = sd.repeated(df, 50, each).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, _, kept = check[far if r.doc_id is None else r.doc_id, r.text]
        assert (r._n_words, r._n_removed, r._kept.encode()) == (n, gone, b" ".join(kept))


def test_release_drops_the_catalog_entry(spark):
    from marketgrid.llm.blocks import Blocks
    from marketgrid.operators import lineage
    made = Blocks(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), 100)
    assert spark.catalog.tableExists(made.name)
    written, lineage._written[:] = list(lineage._written), []
    lineage.release(spark)
    assert not spark.catalog.tableExists(made.name)
    lineage._written[:] = written


def test_keys_of_128_bits():
    from marketgrid.llm.blocks import KeySet, grouped
    keys = np.array([5, 5, 9, 5, 9, 9], np.uint64)
    second = np.array([1, 2, 1, 1, 1, 3], np.uint64)
    found = KeySet(keys, 4, second)
    pairs = list(zip(found.keys[found.of].tolist(), found.second[found.of].tolist()))
    assert pairs == list(zip(keys.tolist(), second.tolist())) and len(found.keys) == 4
    assert found.first[found.of].tolist() == [0, 1, 2, 0, 2, 5]
    order, begin = grouped(keys, second)
    assert np.diff(np.append(begin, 6)).tolist() == [2, 1, 2, 1]


def test_levels_double_up_to_the_size():
    assert sd.lengths(50) == [13, 25, 50] and sd.lengths(50, 3) == [7, 13, 25, 50]
    assert sd.lengths(2) == [1, 2] and sd.lengths(3, 1) == [2, 3]


@pytest.mark.parametrize("doublings", [0, 1, 2, 3, 5])
def test_any_number_of_levels_gives_the_same(spark, monkeypatch, doublings):
    """Passages that end at every length below and above the levels'."""
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for k, n in enumerate([80, 50, 49, 51, 26, 25, 24, 13, 12, 7, 6, 3, 79]):
        own = [f"own{k}x{j}" for j in range(30)]
        rows.append((k, " ".join(own + passage[:n] + [f"t{k}"] * 3)))
        rows.append((100 + k, " ".join(passage[-n:] + own[:12] + passage[:n])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(sd, "DOUBLINGS", doublings)
    monkeypatch.setattr(sd, "lengths", lambda size, d=doublings: sorted({-(-size // 2 ** k) for k in range(d + 1)}))
    check_words(df, rows, 50, 700)


def test_survivors_shrink_level_by_level():
    """A level only asks about windows that survived the one below."""
    import pyarrow as pa
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join([f"a{j}" for j in range(200)] + shared), " ".join(shared + [f"b{j}" for j in range(200)])]
    w = sd._Words(pa.table({"doc_id": pa.array([1, 2]), "text": pa.array(texts)}), 50)
    first = w.level(13)
    keys = sd.KeySet(first.key, 1)
    many = np.bincount(keys.of)[keys.of] > 1
    w.keep(first, many)
    alive = w.alive.copy()
    second = w.level(25)
    assert 22 <= alive.sum() < 150 and len(second.start) < len(first.start)
    assert all(alive[s:s + m].any() for s, m in zip(second.start.tolist(), second.many.tolist()))
