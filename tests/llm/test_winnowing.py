import hashlib

from helpers import SF_SMALL
from pyspark.sql import functions as F

from marketgrid.llm import winnowing as wn

from .conftest import odd_rows


def chosen(hashes, w):
    """Positions by the definition: rightmost smallest of every window."""
    out = set()
    for a in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[a:a + w]
        least = min(window)
        out.add(a + max(k for k, h in enumerate(window) if h == least))
    return sorted(out)


def test_selection_is_winnowing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    every = wn.winnow(F.col("text"), wn.K, 1)  # window 1 chooses every k-gram
    rows = docs.select(wn.as_string(every).alias("all"),
                       wn.as_string(wn.winnow(F.col("text"))).alias("fp")).collect()
    for r in rows:
        hashes = [int(t.split("@")[0], 16) for t in r["all"].split()]
        positions = [int(t.split("@")[1]) for t in r.fp.split()]
        assert positions == chosen(hashes, wn.W)
        assert [int(t.split("@")[0], 16) for t in r.fp.split()] == [hashes[p] for p in positions]


def test_edited_and_next(odd, empty):
    rows = {r[0]: (r[1] or "") for r in odd_rows()}
    ids = sorted(rows)
    got = wn.edited_and_next(odd).withColumn("fp", wn.as_string(F.col("chosen"))).collect()
    assert len(got) == len(odd_rows())
    fingerprints = {}
    for r in got:
        text, following = rows[r.doc_id], rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        assert r.n_chars == len(text) and r.edited == text[:len(text) - cut] + following[:cut]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert fingerprints.setdefault(text, r.fp) == r.fp
        if text == following:
            assert r.near_next == 1
    assert fingerprints[""] == "" and fingerprints["word"].endswith("@0")
    assert wn.edited_and_next(empty).count() == 0


def test_order_over_partitions_and_one_document(spark):
    df = spark.createDataFrame([(k * 17 % 1009, f"text number {k}") for k in range(1009)],
                               "doc_id bigint, text string").repartition(7)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in wn.edited_and_next(df).collect():
        t, nxt = text[r.doc_id], text[(r.doc_id + 1) % 1009]
        cut = len(t) // 4
        assert r.edited == t[:len(t) - cut] + nxt[:cut]
    alone = wn.edited_and_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string"))
    assert [r.edited for r in alone.collect()] == ["abcdefab"]


def test_plan_has_no_python(odd):
    plan = wn.edited_and_next(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_digest(spark):
    from marketgrid.llm.queries import QUERIES
    rows = QUERIES["op2_winnowing"](spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    for r in rows:
        t, nxt = docs[r.doc_id], docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()
