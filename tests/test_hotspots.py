"""Q2 semantics on hand-made masters."""

from helpers import master_df, row

from marketgrid.config import STANDIN
from marketgrid.plans import hotspots

Q = STANDIN.quarters
P = STANDIN.with_(min_quarters=4)


def test_missing_quarter_counts_zero_and_return_is_a_rise(spark):
    # pair present in 7 of 8 quarters: q3 missing -> 0 in the mean, q4 is a rise
    rows = [row(1, q, amt=3000 * (i + 1), stores=1) for i, q in enumerate(Q) if i != 2]
    g = hotspots.growth_metrics(master_df(spark, rows), P).first()
    per = [3000 * (i + 1) / 1 / 3.0 if i != 2 else 0.0 for i in range(8)]
    assert g.q3 == 0.0 and g.n_quarters == 7
    assert g.h1 == sum(per[:4]) / 4.0 and g.h2 == sum(per[4:]) / 4.0
    assert g.up_count == 6  # 7 steps, the drop into the gap is the only fall


def test_pairs_with_few_quarters_dropped(spark):
    rows = [row(1, q) for q in Q[:3]]
    assert hotspots.growth_metrics(master_df(spark, rows), P).count() == 0


def test_mega_flat_industry_scores_50_and_ties_by_key(spark):
    # two pairs with identical growth in one industry: flat min/max -> 50
    rows = []
    for area in (2, 1):
        rows += [row(area, q, amt=(300_000_000 if i < 4 else 600_000_000), stores=10)
                 for i, q in enumerate(Q)]
    p = P.with_(mega_min_stores=5.0, mega_min_h1=1.0, top_k=1)
    top = hotspots.mega(master_df(spark, rows), p).collect()
    assert len(top) == 1 and top[0].area_id == 1  # tie broken by area id
    assert top[0].mega_score == round(50 * 0.6 + 50 * 0.2 + (1 / 7 * 100) * 0.2, 2)


def test_unknown_district_kept_in_q2_dropped_in_q1(spark):
    from marketgrid.config import UNKNOWN
    from marketgrid.plans import district
    rows = [row(1, q, district=UNKNOWN) for q in Q] + [row(2, q) for q in Q]
    m = master_df(spark, rows)
    assert {r.district for r in district.district_scale(m).collect()} == {"D1"}
    assert {r.district for r in hotspots.growth_metrics(m, P).collect()} == {"D1", UNKNOWN}
