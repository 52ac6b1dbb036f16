"""Vessel and weather fixtures derived from the driver tables.

The driver ships no vessel data, so pings and ports are derived from
``events``, ``nation`` and ``region`` by integer/arithmetic formulas that are
written identically in DuckDB (see ``tidewater.plans.oracle``). Every derived
row is a pure projection of one source row, so the derivation is a narrow
map stage that grows with the source tables and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us
from tidewater.operators.weather import MARINE_COLUMNS, PORT_RENAME
from tidewater.session import prepare

# Fixed values of the derivation (shared with the DuckDB oracle text).
N_NATION_PORTS = 25
HOURS_PER_PHASE = 36
ANCHORAGE_OFFSET_DEG = 0.04
ANCHORAGE_NUMBER_BASE = 100
ANCHORAGE_PREFIX = "ANCHORAGE "


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(k: str) -> str:
    return f"(25 + (7 * {k}) % 25)"


def _lon(k: str) -> str:
    return f"(-124 + 2 * ((11 * {k}) % 25))"


def _dms(arcsec: str, hemi: str) -> str:
    return (f"concat(cast(div({arcsec}, 3600) as string), '°', cast(div({arcsec} % 3600, 60) as string), "
            f"'\\'', cast({arcsec} % 60 as string), '\"{hemi}')")


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ports(port_number int, portName string, lat_dd, lon_dd double,
    latitude, longitude string [DMS text as in a port list CSV])."""
    prepare(spark)
    off = ANCHORAGE_OFFSET_DEG
    off_s = int(round(off * 3600))
    n = _read(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as int) as port_number", "n_name as portName",
        f"cast({_lat('n_nationkey')} as double) as lat_dd", f"cast({_lon('n_nationkey')} as double) as lon_dd",
        f"cast({_lat('n_nationkey')} * 3600 as bigint) as _lat_s", f"cast(-{_lon('n_nationkey')} * 3600 as bigint) as _lon_s")
    r = _read(spark, sf_dir, "region").selectExpr(
        f"cast(r_regionkey + {ANCHORAGE_NUMBER_BASE} as int) as port_number",
        f"concat('{ANCHORAGE_PREFIX}', r_name) as portName",
        f"cast({_lat('r_regionkey')} as double) + {off}D as lat_dd",
        f"cast({_lon('r_regionkey')} as double) + {off}D as lon_dd",
        f"cast({_lat('r_regionkey')} * 3600 + {off_s} as bigint) as _lat_s",
        f"cast(-{_lon('r_regionkey')} * 3600 - {off_s} as bigint) as _lon_s")
    return n.unionByName(r).selectExpr(
        "port_number", "portName", "lat_dd", "lon_dd",
        f"{_dms('_lat_s', 'N')} as latitude", f"{_dms('_lon_s', 'W')} as longitude")


EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIS pings, one per event row.

    Columns: ping_id long, mmsi long, base_date_time timestamp_ntz,
    latitude, longitude, sog, cog double, vessel_type int.

    ``ts`` is read as TIMESTAMP (the stored microseconds, UTC), so the hour
    number is a plain field read; the output column is TIMESTAMP_NTZ like
    the source.
    """
    prepare(spark)
    e = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    step = e.selectExpr(
        "event_id", "ts", "user_id", "value",
        f"div(unix_micros(ts), 3600000000) + 7 * user_id as _h")
    step = step.selectExpr(
        "*", f"div(_h, {HOURS_PER_PHASE}) as _phase",
        f"cast(_h % {HOURS_PER_PHASE} as double) / {HOURS_PER_PHASE}D as _frac")
    step = step.selectExpr(
        "*", f"(3 * div(_phase, 2) + user_id) % {N_NATION_PORTS} as _a",
        f"(3 * (div(_phase, 2) + 1) + user_id) % {N_NATION_PORTS} as _b", "_phase % 2 = 1 as _sea")
    step = step.selectExpr(
        "*", f"cast({_lat('_a')} as double) as _alat", f"cast({_lon('_a')} as double) as _alon",
        f"cast({_lat('_b')} as double) as _blat", f"cast({_lon('_b')} as double) as _blon")
    return step.selectExpr(
        "event_id as ping_id",
        "user_id as mmsi",
        "cast(ts as timestamp_ntz) as base_date_time",
        "CASE WHEN _sea THEN _alat + (_blat - _alat) * _frac "
        "ELSE _alat + cast((event_id % 7) - 3 as double) * 0.005D END as latitude",
        "CASE WHEN _sea THEN _alon + (_blon - _alon) * _frac "
        "ELSE _alon + cast((event_id % 5) - 2 as double) * 0.005D END as longitude",
        "CASE WHEN _sea THEN 6.0D + value % 14.0D ELSE (value - floor(value)) * 1.4D END as sog",
        "cast((event_id * 37) % 360 as double) as cog",
        "cast(60 + user_id % 25 as int) as vessel_type",
    )


def _hour_no(hour: str = "hour") -> Column:
    return (epoch_us(F.col(hour)) / US_PER_HOUR).cast("long")


def _marine_values(s: Column) -> list[Column]:
    inland = (s % 7) == 0
    vals = [
        (s % 50).cast("double") / 10.0,
        ((s * 7) % 360).cast("double"),
        (s % 13).cast("double") + 2.0,
        (s % 30).cast("double") / 10.0,
        (s % 20).cast("double") / 20.0,
        ((s * 11) % 360).cast("double"),
    ]
    return [F.when(~inland, v).alias(n) for v, n in zip(vals, MARINE_COLUMNS)]


def _wind_values(w: Column) -> list[Column]:
    speed = (w % 25).cast("double") / 2.0
    return [
        speed.alias("wind_speed_10m"),
        (speed + (w % 9).cast("double")).alias("wind_gusts_10m"),
        ((w * 13) % 360).cast("double").alias("wind_direction_10m"),
        F.when((w % 5) == 0, (w % 11).cast("double") / 4.0).otherwise(F.lit(0.0)).alias("precipitation"),
        ((w % 4) * 20).cast("int").alias("weather_code"),
        F.when((w % 7) != 0, ((w % 24) * 1000).cast("double")).alias("visibility"),
    ]


def cell_weather(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hourly marine and wind rows per (lat_bin, lon_bin, hour) seen. Some cells
    have no marine or no wind row, as in files that were not fetched."""
    cells = keyed.select("lat_bin", "lon_bin", "hour").distinct()
    li, lo = F.col("lat_bin").cast("long"), F.col("lon_bin").cast("long")
    s = F.lit(31) * li + F.lit(17) * lo + _hour_no()
    w = F.lit(13) * li + F.lit(29) * lo + F.lit(3) * _hour_no() + 5000
    marine = cells.where(s % 11 != 3).select("lat_bin", "lon_bin", "hour", *_marine_values(s))
    wind = cells.where(w % 13 != 5).select("lat_bin", "lon_bin", "hour", *_wind_values(w))
    return marine, wind


def port_weather(keyed: DataFrame, ports: DataFrame) -> DataFrame:
    """Hourly surface weather per (destination_port, hour) seen; some hours are missing."""
    keys = keyed.where(F.col("destination_port").isNotNull()) \
        .select("destination_port", "hour").distinct()
    pn = ports.select(F.col("portName").alias("destination_port"), "port_number")
    w = F.lit(41) * F.col("port_number") + F.lit(5) * _hour_no() + 7000
    return keys.join(pn, "destination_port").where(w % 17 != 4).select(
        "destination_port", "hour", *_wind_values(w)).withColumnsRenamed(PORT_RENAME)
