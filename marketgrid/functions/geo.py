"""Inverse Transverse Mercator (EPSG:5181 -> lon/lat degrees) as Column math.

Series from Snyder, "Map Projections - A Working Manual" (USGS 1987),
equations 3-21, 7-19 and 8-17..8-25.  Korea 2000 uses the GRS80 ellipsoid,
whose datum coincides with WGS84 at this precision, so no datum shift.
Unparseable or null input gives null output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (GRS80_A, GRS80_INV_F, TM_FALSE_EASTING, TM_FALSE_NORTHING,
                      TM_K0, TM_LAT0_DEG, TM_LON0_DEG)


def _consts(a=GRS80_A, inv_f=GRS80_INV_F, lat0=TM_LAT0_DEG):
    f = 1.0 / inv_f
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    e4, e6 = e2 * e2, e2 * e2 * e2
    m1 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256
    m2 = 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024
    m3 = 15 * e4 / 256 + 45 * e6 / 1024
    m4 = 35 * e6 / 3072
    p0 = math.radians(lat0)
    m0 = a * (m1 * p0 - m2 * math.sin(2 * p0) + m3 * math.sin(4 * p0) - m4 * math.sin(6 * p0))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    return dict(a=a, e2=e2, ep2=ep2, m1=m1, m0=m0, e1=e1)


def tm_to_lonlat_py(x: float, y: float) -> tuple[float, float]:
    """Scalar version, used by tests as the brute-force reference."""
    c = _consts()
    a, e2, ep2, e1 = c["a"], c["e2"], c["ep2"], c["e1"]
    m = c["m0"] + (y - TM_FALSE_NORTHING) / TM_K0
    mu = m / (a * c["m1"])
    phi1 = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * math.sin(2 * mu)
            + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * math.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * math.sin(6 * mu)
            + (1097 * e1 ** 4 / 512) * math.sin(8 * mu))
    s, co, t = math.sin(phi1), math.cos(phi1), math.tan(phi1)
    c1, t1 = ep2 * co * co, t * t
    n1 = a / math.sqrt(1 - e2 * s * s)
    r1 = a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    d = (x - TM_FALSE_EASTING) / (n1 * TM_K0)
    lat = phi1 - (n1 * t / r1) * (d ** 2 / 2
                                  - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * ep2) * d ** 4 / 24
                                  + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * ep2 - 3 * c1 ** 2) * d ** 6 / 720)
    lon = (d - (1 + 2 * t1 + c1) * d ** 3 / 6
           + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * ep2 + 24 * t1 ** 2) * d ** 5 / 120) / co
    return TM_LON0_DEG + math.degrees(lon), math.degrees(lat)


def tm_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Column expressions (lon, lat) in degrees for EPSG:5181 x/y metres."""
    c = _consts()
    a, e2, ep2, e1 = c["a"], c["e2"], c["ep2"], c["e1"]
    mu = (F.lit(c["m0"]) + (y - F.lit(TM_FALSE_NORTHING)) / F.lit(TM_K0)) / F.lit(a * c["m1"])
    phi1 = (mu + F.lit(3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(mu * 2)
            + F.lit(21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(mu * 4)
            + F.lit(151 * e1 ** 3 / 96) * F.sin(mu * 6)
            + F.lit(1097 * e1 ** 4 / 512) * F.sin(mu * 8))
    s, co, t = F.sin(phi1), F.cos(phi1), F.tan(phi1)
    c1, t1 = F.lit(ep2) * co * co, t * t
    w = F.lit(1.0) - F.lit(e2) * s * s
    n1 = F.lit(a) / F.sqrt(w)
    r1 = F.lit(a * (1 - e2)) / F.pow(w, 1.5)
    d = (x - F.lit(TM_FALSE_EASTING)) / (n1 * F.lit(TM_K0))
    d2 = d * d
    lat = phi1 - (n1 * t / r1) * (
        d2 / 2
        - (F.lit(5.0) + t1 * 3 + c1 * 10 - c1 * c1 * 4 - F.lit(9 * ep2)) * d2 * d2 / 24
        + (F.lit(61.0) + t1 * 90 + c1 * 298 + t1 * t1 * 45 - F.lit(252 * ep2) - c1 * c1 * 3)
        * d2 * d2 * d2 / 720)
    lon = (d - (F.lit(1.0) + t1 * 2 + c1) * d2 * d / 6
           + (F.lit(5.0) - c1 * 2 + t1 * 28 - c1 * c1 * 3 + F.lit(8 * ep2) + t1 * t1 * 24)
           * d2 * d2 * d / 120) / co
    return F.lit(TM_LON0_DEG) + F.degrees(lon), F.degrees(lat)
