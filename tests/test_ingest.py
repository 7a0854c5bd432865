"""Raw CSV ingest: header dialects, re-ordered columns, BOM, CP949, bad numbers."""

import os

import pytest

from marketgrid.config import REFERENCE
from marketgrid.plans.master import clean_sales
from marketgrid.sources.csv_sources import dialects, read_raw_csv, read_sources, text_lines, typed
from marketgrid.sources.sinks import file_heads, write_samples

KO = "기준_년분기_코드,상권_코드,서비스_업종_코드_명,당월_매출_금액,당월_매출_건수,연령대_20_매출_금액,연령대_30_매출_금액"
EN_REORDERED = "thsmon_selng_co,trdar_cd,agrde_30_selng_amt,stdr_yyqu_cd,svc_induty_cd_nm,thsmon_selng_amt,agrde_20_selng_amt"


def _write(path, text, enc="utf-8", bom=False):
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + text.encode(enc))


def test_mixed_headers_and_encodings(spark, tmpdir_fresh):
    d = tmpdir_fresh
    _write(f"{d}/sales_2024.csv", KO + "\n20241,A1,한식음식점,1000,4,100,200\n", bom=True)
    _write(f"{d}/sales_2025.csv", EN_REORDERED + "\n7,A2,300,20251,커피-음료,2000,abc\n")
    _write(f"{d}/sales_2026.csv", KO + "\n20252,똠1,제과점,,1,1,1\n", enc="cp949")
    found = {r.file.rsplit("/", 1)[1]: r for r in dialects(text_lines(spark, f"{d}/sales_*.csv")).collect()}
    assert {f: r.utf8 for f, r in found.items()} == {
        "sales_2024.csv": True, "sales_2025.csv": True, "sales_2026.csv": False}
    assert found["sales_2024.csv"].names == found["sales_2026.csv"].names
    assert found["sales_2025.csv"].names[:2] == ["sales_cnt", "area_id"]
    df = typed(read_raw_csv(spark, f"{d}/sales_*.csv"), "sales")
    rows = {r.area_id: r for r in df.collect()}
    assert rows["A1"].quarter == 20241 and rows["A1"].sales_amt == 1000 and rows["A1"].amt_30s == 200
    a2 = rows["A2"]
    assert (a2.quarter, a2.industry, a2.sales_amt, a2.sales_cnt, a2.amt_30s) == (20251, "커피-음료", 2000, 7, 300)
    assert a2.amt_20s is None  # 'abc' -> null
    assert rows["똠1"].industry == "제과점" and rows["똠1"].sales_amt is None
    cleaned = {r.area_id: r for r in clean_sales(df, REFERENCE).collect()}
    assert set(cleaned) == {"A1", "A2"} and cleaned["A2"].amt_20s == 0


def test_read_sources_and_samples(spark, tmpdir_fresh):
    d = tmpdir_fresh
    _write(f"{d}/sales_2024.csv", KO + "\n20241,A1,한식음식점,1000,4,100,200\n")
    _write(f"{d}/stores_2024.csv", "stdr_yyqu_cd,trdar_cd,svc_induty_cd_nm,stor_co,opbiz_stor_co,clsbiz_stor_co\n20241,A1,한식음식점,3,1,0\n")
    _write(f"{d}/foot_traffic.csv", "기준_년분기_코드,상권_코드,총_유동인구_수\n20241,A1,5000\n")
    _write(f"{d}/area.csv", "상권_코드,상권_구분_코드_명,상권_코드_명,엑스좌표_값,와이좌표_값,자치구_코드_명,행정동_코드_명\n"
                            "A1,골목상권,똠얌 골목,201642,452260,마포구,서교동\n", enc="cp949")
    sales, stores, foot, area = read_sources(spark, d)
    a = area.first()
    assert a.area_name == "똠얌 골목" and a.x == 201642.0
    assert stores.first().stores == 3 and foot.first().foot == 5000
    out = os.path.join(d, "samples")
    written = write_samples(spark, f"{d}/*.csv", out, n=1)
    assert written.count() == 8
    back = spark.read.option("header", True).csv(os.path.join(out, "sample=area.csv")).first()
    assert back["상권_코드_명"] == "똠얌 골목"


@pytest.mark.parametrize("folder", ["with space", "per%20cent", "한글 폴더", "plus+&=#"])
def test_names_of_folders(spark, tmpdir_fresh, folder):
    d = f"{tmpdir_fresh}/{folder}"
    os.makedirs(d)
    _write(f"{d}/sales_a 1.csv", KO + "\n20241,A1,제과점,1000,4,100,200\n", enc="cp949")
    _write(f"{d}/sales_b%1.csv", KO + "\n20241,A2,커피-음료,7,4,1,2\n", bom=True)
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    rows = {r.area_id: r for r in typed(read_raw_csv(spark, f"{d}/sales_*.csv"), "sales").collect()}
    assert rows["A1"].industry == "제과점" and rows["A1"].sales_amt == 1000
    assert rows["A2"].industry == "커피-음료"
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_decimal_text_and_missing_column(spark, tmpdir_fresh):
    d = tmpdir_fresh
    _write(f"{d}/sales_1.csv", KO + "\n20241.0,A1,제과점,123.0,4.9,-7.,x\n")
    r = typed(read_raw_csv(spark, f"{d}/sales_1.csv"), "sales").first()
    assert (r.quarter, r.sales_amt, r.sales_cnt, r.amt_20s, r.amt_30s) == (20241, 123, 4, -7, None)
    _write(f"{d}/foot.csv", "기준_년분기_코드,상권_코드\n20241,A1\n")
    with pytest.raises(ValueError, match="foot"):
        typed(read_raw_csv(spark, f"{d}/foot.csv"), "foot")


def test_many_part_files(spark, tmpdir_fresh):
    d = tmpdir_fresh
    for k in range(40):
        head, body = (KO, f"20241,P{k},제과점,{k + 1},1,0,0") if k % 2 else (
            EN_REORDERED, f"1,P{k},0,20241,제과점,{k + 1},0")
        _write(f"{d}/sales_{k}.csv", f"{head}\n{body}\n", enc="cp949" if k % 4 == 1 else "utf-8")
    rows = typed(read_raw_csv(spark, f"{d}/sales_*.csv"), "sales").collect()
    assert {(r.area_id, r.sales_amt, r.industry) for r in rows} == {
        (f"P{k}", k + 1, "제과점") for k in range(40)}


def test_one_scan_and_one_join_for_any_mixture(spark, tmpdir_fresh):
    d = tmpdir_fresh
    for k in range(6):
        head = [KO, EN_REORDERED, KO + ",extra" + str(k)][k % 3]
        body = ["20241,A,제과점,5,1,0,0", "1,A,0,20241,제과점,5,0", "20241,A,제과점,5,1,0,0,x"][k % 3]
        _write(f"{d}/sales_{k}.csv", f"{head}\n{body}\n", enc="cp949" if k % 2 else "utf-8")
    df = read_raw_csv(spark, f"{d}/sales_*.csv")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and plan.count("Join") == 1
    rows = typed(df, "sales").collect()
    assert len(rows) == 6 and {(r.area_id, r.industry, r.sales_amt) for r in rows} == {("A", "제과점", 5)}


def test_lines_that_are_no_rows(spark, tmpdir_fresh):
    d = tmpdir_fresh
    _write(f"{d}/sales_0.csv", "")
    _write(f"{d}/sales_1.csv", KO)
    _write(f"{d}/sales_2.csv", KO.replace(",", '","').join('""') + '\r\n\r\n20241,"A,1","say ""x""",1,,3\r\n  \n20242,B\n')
    rows = {r.area_id: r for r in typed(read_raw_csv(spark, f"{d}/sales_*.csv"), "sales").collect()}
    assert set(rows) == {"A,1", "B"}
    a = rows["A,1"]
    assert (a.quarter, a.sales_amt, a.sales_cnt, a.amt_20s, a.amt_30s) == (20241, 1, None, 3, None)
    assert rows["B"].industry is None and rows["B"].quarter == 20242
    with pytest.raises(FileNotFoundError):
        read_raw_csv(spark, f"{d}/nothing_*.csv")
    _write(f"{d}/broken.csv", KO + '\n20241,"A\n1",x,1,1,1,1\n')
    with pytest.raises(Exception, match="quoted line break"):
        read_raw_csv(spark, f"{d}/broken.csv").collect()


def test_heads_of_many_files_in_few_jobs(spark, tmpdir_fresh):
    d = tmpdir_fresh
    for k in range(1000):
        _write(f"{d}/f{k:04d}.csv", "\n".join([f"h{k}", *[f"{k}-{j}" for j in range(k % 7)]]) + "\n",
               enc="cp949" if k % 2 else "utf-8")
    sc = spark.sparkContext
    sc.setJobGroup("heads", "")
    rows = file_heads(spark, f"{d}/*.csv", 3).collect()
    sc.setJobGroup("", "")
    # listing, the table of files, the heads
    assert len(sc.statusTracker().getJobIdsForGroup("heads")) <= 8
    got = {}
    for r in rows:
        got.setdefault(r.file[-8:-4], []).append((r.line, r.text))
    assert {f: [t for _, t in sorted(x)] for f, x in got.items()} == {
        f"{k:04d}": [f"h{k}", *[f"{k}-{j}" for j in range(min(3, k % 7))]] for k in range(1000)}


def test_head_of_a_file_of_many_blocks(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/long.csv"
    _write(path, "\n".join(["head", *[f"row {k}" for k in range(50_000)]]))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200")
    try:
        rows = file_heads(spark, path, 60).collect()
    finally:
        spark.conf.set(name, before)
    assert [r.text for r in sorted(rows, key=lambda r: r.line)] == ["head", *[f"row {k}" for k in range(60)]]
