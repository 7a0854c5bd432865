"""Sinks and views: partitioned master, serving CSV round trip, SQL view."""

import os

import pytest
from helpers import SF_SMALL
from pyspark.sql import functions as F

from marketgrid.config import STANDIN
from marketgrid.sources.published import current_version, publish, read_published, versions
from marketgrid.sources.sinks import read_serving_csv, write_master, write_serving_csv
from marketgrid.sources.standin import standin_master
from marketgrid.sources.views import MASTER_VIEW, register_views


def test_master_partitioned_by_quarter_prunes(spark, tmpdir_fresh):
    m = standin_master(spark, SF_SMALL, STANDIN)
    path = os.path.join(tmpdir_fresh, "master")
    write_master(m, path)
    assert any(d.startswith("quarter=") for d in os.listdir(path))
    back = spark.read.parquet(path).filter(F.col("quarter") == STANDIN.quarters[0])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "quarter" in plan
    assert back.count() == m.filter(F.col("quarter") == STANDIN.quarters[0]).count()


def test_serving_csv_round_trip(spark, tmpdir_fresh):
    df = spark.createDataFrame([("강남구", 1.5, 3), ("중구", None, 4)],
                               "district string, amt double, n bigint")
    path = os.path.join(tmpdir_fresh, "tab1")
    write_serving_csv(df, path, single_file=True)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    back = read_serving_csv(spark, path, "district string, amt double, n bigint")
    assert sorted(back.collect()) == sorted(df.collect())


def test_master_view_sql(spark):
    m = standin_master(spark, SF_SMALL, STANDIN)
    register_views(m)
    n = spark.sql(f"SELECT COUNT(DISTINCT quarter) AS nq FROM {MASTER_VIEW}").first().nq
    assert n == len(STANDIN.quarters)


def test_release_empties_the_scratch_folder(spark, tmpdir_fresh, monkeypatch):
    import os

    from marketgrid.operators import lineage
    monkeypatch.setattr(lineage, "_written", [])
    monkeypatch.setattr(lineage, "ensure_checkpoint_dir", lambda s: tmpdir_fresh)
    for _ in range(3):
        assert lineage.materialize(spark.range(5)).count() == 5
    root = os.path.join(tmpdir_fresh, "marketgrid-tables")
    assert len(os.listdir(root)) == 3 and lineage.release(spark) == 3 and os.listdir(root) == []


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def test_a_quarter_is_replaced_alone(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "master")
    rows = [(q, a, q * a) for q in (20241, 20242, 20243) for a in range(20)]
    write_master(spark.createDataFrame(rows, "quarter int, area_id int, v int").repartition(4), path)
    before = _files(path)
    fresh = [(20242, a, -a) for a in range(5)] + [(20244, 1, 1)]
    write_master(spark.createDataFrame(fresh, "quarter int, area_id int, v int"), path)
    after = _files(path)
    old = {f: t for f, t in before.items() if "quarter=20241" in f or "quarter=20243" in f}
    assert old and all(after.get(f) == t for f, t in old.items())
    assert not any("quarter=20242" in f for f in set(before) & set(after))
    back = {(r.quarter, r.area_id, r.v) for r in spark.read.parquet(path).collect()}
    assert back == {r for r in rows if r[0] != 20242} | set(fresh)
    write_master(spark.createDataFrame(fresh[:1], "quarter int, area_id int, v int").filter("false"), path)
    assert spark.read.parquet(path).count() == len(back)
    write_master(spark.createDataFrame(fresh, "quarter int, area_id int, v int"), path, whole=True)
    assert {r.quarter for r in spark.read.parquet(path).collect()} == {20242, 20244}


@pytest.mark.parametrize("keep", [1, 2, 3])
def test_publish_replaces_and_keeps_former_versions(spark, tmpdir_fresh, keep):
    path = os.path.join(tmpdir_fresh, "table name")
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    names = []
    for n in range(1, 6):
        names.append(publish(spark.range(n), path, keep))
        assert read_published(spark, path).count() == n and current_version(spark, path) == names[-1]
        assert versions(spark, path) == sorted(names)[-keep:]


def test_a_reader_keeps_its_version(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "t")
    publish(spark.range(3), path)
    reader = read_published(spark, path)
    publish(spark.range(7), path)
    assert reader.count() == 3 and read_published(spark, path).count() == 7


def test_a_write_that_fails_changes_nothing(spark, tmpdir_fresh):
    from pyspark.sql import functions as F
    path = os.path.join(tmpdir_fresh, "t")
    first = publish(spark.range(3), path)
    broken = spark.range(0, 1000, 1, 4).withColumn(
        "x", F.when(F.col("id") == 999, F.raise_error(F.lit("midway"))).otherwise(F.lit("v")))
    with pytest.raises(Exception, match="midway"):
        publish(broken, path)
    assert current_version(spark, path) == first and read_published(spark, path).count() == 3
    assert len(versions(spark, path)) == 2               # the remains
    # a version that was written but never pointed to is no former version
    spark.range(9).write.parquet(f"{path}/version-00000002-{'0' * 32}")
    publish(spark.range(4), path)
    assert read_published(spark, path).count() == 4
    assert len(versions(spark, path)) == 2 and first in versions(spark, path)


def test_sql_texts_equal_the_dataframe_form(spark):
    from marketgrid.plans import hotspots
    from marketgrid.sources.views import mega_by_sql, rising_by_sql
    m = standin_master(spark, SF_SMALL, STANDIN)
    register_views(m)
    for p in (STANDIN, STANDIN.with_(mega_min_stores=1.0, mega_min_h1=0.0, rising_min_up=0, rising_min_growth=-1.0,
                                     min_quarters=7, top_k=25)):
        assert mega_by_sql(spark, p).collect() == hotspots.mega(m, p).collect()
        assert rising_by_sql(spark, p).collect() == hotspots.rising(m, p).collect()
