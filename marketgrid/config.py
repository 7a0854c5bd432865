"""Fixed values and tunable parameters.

Everything that has to equal the source project's values for the same results
lives in the FIXED VALUES block below, written out plainly.  Thresholds are
parameters: ``Params()`` holds the source project's defaults (money in won),
``STANDIN`` holds the values used on the driver's TPC-H-shaped test tables
(money in cents, quarters 1999Q1..2000Q4).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source project's values)
# ---------------------------------------------------------------------------

# Raw header names -> canonical column name.  Each raw file uses either the
# Korean header or the English API code; both spellings are listed per column.
HEADER_ALIASES: dict[str, tuple[str, str]] = {
    "quarter": ("기준_년분기_코드", "stdr_yyqu_cd"),
    "area_type_code": ("상권_구분_코드", "trdar_se_cd"),
    "area_type": ("상권_구분_코드_명", "trdar_se_cd_nm"),
    "area_id": ("상권_코드", "trdar_cd"),
    "area_name": ("상권_코드_명", "trdar_cd_nm"),
    "industry_code": ("서비스_업종_코드", "svc_induty_cd"),
    "industry": ("서비스_업종_코드_명", "svc_induty_cd_nm"),
    "sales_amt": ("당월_매출_금액", "thsmon_selng_amt"),
    "sales_cnt": ("당월_매출_건수", "thsmon_selng_co"),
    "amt_20s": ("연령대_20_매출_금액", "agrde_20_selng_amt"),
    "amt_30s": ("연령대_30_매출_금액", "agrde_30_selng_amt"),
    "stores": ("점포_수", "stor_co"),
    "opened": ("개업_점포_수", "opbiz_stor_co"),
    "closed": ("폐업_점포_수", "clsbiz_stor_co"),
    "foot": ("총_유동인구_수", "tot_flpop_co"),
    "x": ("엑스좌표_값", "xnts_vl"),
    "y": ("와이좌표_값", "ynts_vl"),
    "district": ("자치구_코드_명", "signgu_cd_nm"),
    "neighbourhood": ("행정동_코드_명", "adstrd_cd_nm"),
}

# Quarters and industries analysed by the source project.
REFERENCE_QUARTERS = (20241, 20242, 20243, 20244, 20251, 20252, 20253, 20254)
REFERENCE_INDUSTRIES = (
    "한식음식점", "중식음식점", "일식음식점", "양식음식점", "제과점",
    "패스트푸드점", "치킨전문점", "분식전문점", "호프-간이주점", "커피-음료",
)

# Text sentinel for a missing dimension value ("unknown").
UNKNOWN = "미상"
# Area type that is dropped from the master table ("traditional market").
EXCLUDED_AREA_TYPE = "전통시장"
# Area names dropped from the master table (underground, department store,
# mart, station, terminal, convention centre).
EXCLUDED_AREA_NAME_PATTERN = "지하|백화점|마트|역사|터미널|코엑스"
# Area type of the recommendation model ("alley market").
ALLEY_AREA_TYPE = "골목상권"
# Class tags of the hot-spot table ("mega hot place", "rising hot place").
MEGA_TAG = "메가 핫플"
RISING_TAG = "라이징 핫플"

# Weights of the composite scores.
LQ_REVENUE_WEIGHT, LQ_STORE_WEIGHT = 0.7, 0.3
MEGA_VOLUME_WEIGHT, MEGA_SPEED_WEIGHT, MEGA_COUNT_WEIGHT = 0.6, 0.2, 0.2
ENTRY_DENSITY_WEIGHT, ENTRY_FOOT_WEIGHT = 0.7, 0.3
ENTRY_FOOT_TARGET = 0.65
# Tukey fence multiplier and the fixed floor of the ticket fence.
TUKEY_K = 1.5
# Fit thresholds of the map slices.
FIT_SLICES = (0.0, 0.3, 0.5, 0.7)

# EPSG:5181 (Korea 2000 / Central Belt) on the GRS80 ellipsoid.
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101
TM_LAT0_DEG, TM_LON0_DEG = 38.0, 127.0
TM_K0 = 1.0
TM_FALSE_EASTING, TM_FALSE_NORTHING = 200000.0, 500000.0

# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    quarters: tuple[int, ...] = REFERENCE_QUARTERS
    industries: tuple[str, ...] = REFERENCE_INDUSTRIES
    # Q2 mega hot spots
    mega_min_stores: float = 30.0
    mega_min_h1: float = 40_000_000.0
    # Q2 rising hot spots: [lo, hi) bands
    rising_stores: tuple[float, float] = (15.0, 30.0)
    rising_h1: tuple[float, float] = (20_000_000.0, 40_000_000.0)
    rising_min_growth: float = 0.20
    rising_min_up: int = 3
    min_quarters: int = 4
    top_k: int = 10
    # Q3 label
    persist_ratio: float = 0.90
    revenue_ratio: float = 0.85
    # Q3 training / candidate filters
    alley_type: str = ALLEY_AREA_TYPE
    min_pair_stores: float = 3.0
    min_foot_pct: float = 0.20
    min_sales_per_store: float = 4_500_000.0
    ticket_floor: float = 3000.0
    min_mz_share: float = 0.30
    # boosted trees
    gbt_depth: int = 5
    gbt_step: float = 0.05
    gbt_iter: int = 200
    seed: int = 42
    folds: int = 5
    holdout: float = 0.25
    # master exclusions and map slices
    excluded_area_type: str = EXCLUDED_AREA_TYPE
    excluded_name_pattern: str = EXCLUDED_AREA_NAME_PATTERN
    fit_slices: tuple[float, ...] = FIT_SLICES

    @property
    def year1(self) -> int:
        return self.quarters[0] // 10

    @property
    def year2(self) -> int:
        return self.quarters[-1] // 10

    @property
    def year1_quarters(self) -> tuple[int, ...]:
        return tuple(q for q in self.quarters if q // 10 == self.year1)

    @property
    def year2_quarters(self) -> tuple[int, ...]:
        return tuple(q for q in self.quarters if q // 10 == self.year2)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


REFERENCE = Params()

# Values for the driver's TPC-H-shaped tables (see README "stand-in").
STANDIN_INDUSTRIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
STANDIN = Params(
    quarters=(19991, 19992, 19993, 19994, 20001, 20002, 20003, 20004),
    industries=STANDIN_INDUSTRIES,
    mega_min_stores=3.7,
    mega_min_h1=1_750_000.0,
    rising_stores=(2.0, 3.7),
    rising_h1=(1_000_000.0, 1_750_000.0),
    alley_type="MIDDLE EAST",
    ticket_floor=3_300_000.0,
    excluded_area_type="AMERICA",
    excluded_name_pattern="(13|47)$",
    fit_slices=(0.0, 0.2, 0.3, 0.4),
)
# A nation of the stand-in tables whose areas have no known district.
STANDIN_NO_DISTRICT = "NATION_7"
