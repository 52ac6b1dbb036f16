"""Scalar column expressions (F1-F23). All are JVM-side Column builders.

Nothing here is a Python UDF: every function returns a ``Column`` that stays
inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EARTH_RADIUS_NM = 3440.065          # haversine radius, nautical miles
WEB_MERCATOR_R = 6378137.0          # EPSG:3857 sphere radius, metres
METRES_PER_NM = 1852.0              # nm -> m
DEGREES_PER_NM = 0.015              # nm -> degrees (planar approximation)
US_PER_HOUR = 3_600_000_000         # microseconds per hour
SEA_STATE_EDGES = [0.1, 0.5, 1.25, 2.5, 4.0, 6.0, 9.0, 14.0]  # right-closed, codes 0..8

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch for a TIMESTAMP_NTZ or TIMESTAMP column.

    NTZ values are read as UTC wall time; `timestampdiff` on NTZ does not
    depend on the session time zone.
    """
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts).cast("timestamp_ntz"))


def dms_to_dd(s) -> Column:
    """F1: '46°59\'00"N' -> 46.98333; negative for S/W; unparsable text -> NULL."""
    parts = F.split(F.trim(_c(s)), "[°'\"]+")
    deg = F.get(parts, 0).try_cast("double")
    mins = F.get(parts, 1).try_cast("double")
    secs = F.get(parts, 2).try_cast("double")
    hemi = F.trim(F.get(parts, 3))
    dd = deg + mins / 60.0 + secs / 3600.0
    return F.when(hemi.isin("S", "W"), -dd).when(hemi.isin("N", "E"), dd)


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance in nautical miles, argument clipped to [0, 1]."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlam = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlam / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(a))


def mercator_x(lon) -> Column:
    """EPSG:3857 x in metres."""
    return F.lit(WEB_MERCATOR_R) * (_c(lon) * math.pi / 180.0)


def mercator_y(lat) -> Column:
    """EPSG:3857 y in metres."""
    return F.lit(WEB_MERCATOR_R) * F.ln(F.tan(F.lit(math.pi / 4) + (_c(lat) * math.pi / 180.0) / 2.0))


def floor_hour(ts) -> Column:
    """floor to the hour (keeps the input timestamp type)."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def grid_1deg(x) -> Column:
    """F8: 1-degree cell, round half to even, never -0.0."""
    return F.rint(_c(x)) + F.lit(0.0)


def fraction_completed(remaining, total) -> Column:
    """1 - remaining/total, total 0 -> NULL, clipped to [0, 1]."""
    raw = F.lit(1.0) - _c(remaining) / F.nullif(_c(total), F.lit(0.0))
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def clip_at_zero(p) -> Column:
    """F10."""
    return F.greatest(_c(p), F.lit(0.0))


def headwind(cog, wind_dir, wind_speed) -> Column:
    """cos(radians((cog - wind_dir) mod 360)) * wind_speed."""
    return F.cos(F.radians(F.pmod(_c(cog) - _c(wind_dir), F.lit(360.0)))) * _c(wind_speed)


def sea_state(h) -> Column:
    """Beaufort-like code 0..8 from wave height, right-closed edges."""
    h = _c(h)
    expr = None
    for code, edge in enumerate(SEA_STATE_EDGES):
        expr = F.when(h <= edge, code) if expr is None else expr.when(h <= edge, code)
    return expr.when(h.isNotNull(), len(SEA_STATE_EDGES)).cast("int")


def flag(cond: Column) -> Column:
    """F13 helper: missing input counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def equal_width_bin(x, lo, width) -> Column:
    """right-closed equal-width bin number (1-based), minimum in bin 1; all
    values are in bin 1 when the width is 0."""
    b = F.greatest(F.ceil((_c(x) - _c(lo)) / F.nullif(_c(width), F.lit(0.0))), F.lit(1))
    return F.when(_c(x).isNotNull(), F.coalesce(b, F.lit(1))).cast("int")


def iso_timestamp(ts) -> Column:
    """ISO-8601 text; six fraction digits only when the microseconds are
    not zero (Python ``datetime.isoformat``)."""
    ts = _c(ts)
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def safe_key(name) -> Column:
    """'/' and ' ' -> '_'."""
    return F.translate(_c(name), "/ ", "__")


def to_int(text) -> Column:
    """text to int by way of a double (``70.0`` is 70), NULL if it is no number."""
    return _c(text).cast("string").try_cast("double").try_cast("int")
