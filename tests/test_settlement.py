"""Q3 label and feature rules on hand-made masters."""

from pyspark.sql import functions as F
from helpers import master_df, row

from marketgrid.config import STANDIN
from marketgrid.plans import settlement

Q = STANDIN.quarters


def _label_rows(spark):
    rows = []
    for i, q in enumerate(Q):
        rows.append(row(1, q, amt=1000, stores=10, area_type="MIDDLE EAST"))
        if i < 4:
            rows.append(row(2, q, amt=1000, stores=10))          # no second year
        if 0 < i < 4:
            rows.append(row(3, q, amt=1000, stores=10))          # 3 first-year quarters
    rows.append(row(4, Q[0], amt=1000, stores=10))
    for q in Q[:4]:
        rows.append(row(5, q, amt=1000, stores=10))
    for q in Q[4:]:
        rows.append(row(5, q, amt=1000, stores=5))               # lost half its stores
    return master_df(spark, rows)


def test_label_cohort_and_conditions(spark):
    m = _label_rows(spark)
    lab = {r.area_id: r.target for r in settlement.settle_label(settlement.pair_stats(m, STANDIN),
                                                                STANDIN).collect()}
    assert lab == {1: 1, 2: 0, 5: 0}


def test_active_pairs_need_the_latest_quarter(spark):
    m = _label_rows(spark)
    act = {r.area_id for r in settlement.active_pairs(settlement.pair_stats(m, STANDIN)).collect()}
    assert act == {1, 5}


def test_cv_single_quarter_is_filled_with_median(spark):
    rows = [row(a, q, amt=1000 * (a + i), stores=2) for a in (1, 2, 3) for i, q in enumerate(Q)]
    rows += [row(9, Q[4], amt=5000, stores=2)]                     # one second-year quarter
    base = settlement.Q3Base.build(master_df(spark, rows), STANDIN)
    cur = {r.area_id: r for r in settlement.infer_features(base, STANDIN).collect()}
    cvs = sorted(cur[a].cv for a in (1, 2, 3))
    assert cur[9].cv == cvs[1]  # the median of the other three


def test_foot_percentile_from_pairs_equals_direct(spark):
    from helpers import SF_SMALL
    from marketgrid.sources.standin import standin_master
    m = standin_master(spark, SF_SMALL, STANDIN)
    direct = sorted(tuple(r) for r in settlement.foot_percentile(m).select(
        "area_id", "avg_foot", "foot_pct").collect())
    via = sorted(tuple(r) for r in settlement.area_foot_percentile(
        settlement.pair_stats(m, STANDIN), STANDIN).select("area_id", "avg_foot", "foot_pct").collect())
    assert direct == via and len(direct) > 0


def test_rules_bind_on_the_stand_in_tables(spark):
    """Every exclusion, floor and threshold of the registered queries changes
    rows; else their green rows would prove nothing."""
    from helpers import SF_CHECK
    from marketgrid.config import STANDIN as P
    from marketgrid.plans import settlement
    from marketgrid.registry import _tab3, prior_ranking  # noqa: F401
    from marketgrid.plans import serving
    from marketgrid.sources.standin import standin_area_raw, standin_master
    raw = standin_area_raw(spark, SF_CHECK)
    assert raw.filter(F.col("area_type") == P.excluded_area_type).count() > 0
    assert raw.filter(F.col("area_name").rlike(P.excluded_name_pattern)).count() > 0
    assert raw.filter(F.col("district").isNull()).count() > 0
    m = standin_master(spark, SF_CHECK, P)
    assert m.filter((F.col("area_type") == P.excluded_area_type)
                    | F.col("area_name").rlike(P.excluded_name_pattern)).count() == 0
    base = settlement.Q3Base.build(m, P)
    kept = settlement.candidates(base, P).count()
    assert kept < settlement.candidates(base, P.with_(min_sales_per_store=0.0)).count()
    fences = settlement.tukey_fences(base, P)[1]
    assert fences.filter(F.col("ticket_lower") == P.ticket_floor).count() > 0
    slices = serving.threshold_slices(serving.tab3_map(base.pairs, prior_ranking(base), P),
                                      P.fit_slices).collect()
    counts = [r.n_rows for r in sorted(slices, key=lambda r: r.threshold)]
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == 4 and counts[-1] > 0


def test_no_candidates_is_an_error(spark):
    import pytest
    from helpers import SF_SMALL
    from marketgrid.config import STANDIN as P
    from marketgrid.plans import settlement
    from marketgrid.sources.standin import standin_master
    base = settlement.Q3Base.build(standin_master(spark, SF_SMALL, P), P)
    with pytest.raises(ValueError, match="candidate"):
        settlement.require_candidates(settlement.candidates(base, P.with_(min_mz_share=2.0)))
