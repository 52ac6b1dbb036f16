"""Registered queries: one per operator of the inventory, with DuckDB oracles.

Every query reads the driver tables of ``sf_dir`` (through the derived
fixtures) and runs over whole tables. Names are ``<id>_<short name>``.
"""

from __future__ import annotations

import datetime
import math
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import geo
from tidewater.operators import features as feat
from tidewater.operators import boosting, polygons, portcalls, profile, sessions, spread, voyages, weather
from tidewater.operators.ordered import range_running_sum
from tidewater.operators.quantiles import exact_percentiles
from tidewater.plans import oracle, training
from tidewater.plans.daily import DailyVisits
from tidewater.plans.pipeline import MIN_TIME_IN_PORT_H, Stages
from tidewater.session import ensure_checkpoint_dir, input_mark, path_exists
from tidewater.sources import ais, fixtures
from tidewater.streaming import keyed
from tidewater.streaming import stream as S
from tidewater.streaming.registry import Registry

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), oracle.R6)


W = oracle.with_ctes
SAMPLE_N = 10000          # rows of the O4 sample
TOP_PORTS_N = 10
PREVIEW_N = 5
BUSY_PORTS_N = 15
TEST_SHARE = 0.2
WEATHER_BUCKETS = 16      # of stored cell weather; a cluster takes as many as fit its largest table
BUFFER_NM, BUFFER_SEGMENTS = 1.08, 3  # the coarse polygons of j2_buffer_polygons
SEED = 42
# The columns of the correlation and coverage tables.
CORR_FEATURES = ["wave_height", "wave_period", "swell_wave_height", "ocean_current_velocity",
                 "wind_speed_10m", "wind_gusts_10m", "headwind_component", "port_wind_speed",
                 "port_wind_gusts", "port_precipitation"]
CORR_TARGETS = ["sog", "remaining_travel_hours"]


# ---------------------------------------------------------------- L1 ------
@register("l1_voyages", W("voyages_full", "SELECT * FROM voyages_full"))
def l1_voyages(spark, d):
    """Flagship: voyages with ping counts."""
    return Stages(spark, d).voyages


@register("p1_cargo_filter", W("pings", "SELECT * FROM pings WHERE TRY_CAST(vessel_type AS INTEGER) BETWEEN 70 AND 79"))
def p1_cargo_filter(spark, d):
    return Stages(spark, d).pings.where(F.col("vessel_type").try_cast("int").between(70, 79))


@register("p2_slow_pings", W("pings", "SELECT * FROM pings WHERE sog <= CAST(1.5 AS DOUBLE)"))
def p2_slow_pings(spark, d):
    return Stages(spark, d).pings.where(F.col("sog") <= 1.5)


@register("j1_point_in_radius", W("cand", "SELECT ping_id, mmsi, base_date_time, portName FROM cand"))
def j1_point_in_radius(spark, d):
    return Stages(spark, d).candidates.select("ping_id", "mmsi", "base_date_time", "portName")


@register("w1_gap_hours", W("cand", """
SELECT ping_id, portName,
       CAST(epoch_us(base_date_time) - epoch_us(lag(base_date_time) OVER
            (PARTITION BY mmsi, portName ORDER BY base_date_time, ping_id)) AS DOUBLE) / CAST(3600000000 AS DOUBLE)
         AS gap_hours
FROM cand"""))
def w1_gap_hours(spark, d):
    return sessions.gap_hours(Stages(spark, d).candidates, order=["ping_id"]) \
        .select("ping_id", "portName", "gap_hours")


@register("w2_visit_sessions", W("cand_s", "SELECT ping_id, portName, CAST(visit_seq AS BIGINT) AS visit_seq FROM cand_s"))
def w2_visit_sessions(spark, d):
    return sessions.label_visit_seq(Stages(spark, d).candidates) \
        .select("ping_id", "portName", F.col("visit_seq").cast("long").alias("visit_seq"))


@register("a1_port_visits", W("visits", "SELECT * FROM visits"))
def a1_port_visits(spark, d):
    return Stages(spark, d).visits_plan


_MATCH_SQL = "SELECT DISTINCT mmsi, portName FROM visits WHERE duration_hours >= CAST(1 AS DOUBLE)"


@register("a3_distinct_pairs", W("visits", _MATCH_SQL))
def a3_distinct_pairs(spark, d):
    return sessions.match(Stages(spark, d).visits_plan, MIN_TIME_IN_PORT_H)


@register("a2_vessels_per_port", W("visits", f"""
SELECT portName, CAST(count(DISTINCT mmsi) AS BIGINT) AS n_vessels FROM ({_MATCH_SQL}) GROUP BY portName"""))
def a2_vessels_per_port(spark, d):
    m = sessions.match(Stages(spark, d).visits_plan, MIN_TIME_IN_PORT_H)
    return m.groupBy("portName").agg(F.count("mmsi").alias("n_vessels"))


@register("a2_vessels_from_sketches", W("cand", """
SELECT span, portName, CAST(count(DISTINCT mmsi) AS BIGINT) AS n_vessels, true AS within
FROM cand, (VALUES ('all days', 1, 31), ('days 5 to 20', 5, 20)) AS s(span, lo, hi)
WHERE day(base_date_time) BETWEEN lo AND hi GROUP BY span, portName"""))
def a2_vessels_from_sketches(spark, d):
    """A2 approximate: vessels per port over two ranges of days of a month, from the sketches kept per port and day,
    against the exact counts."""
    cand = Stages(spark, d).candidates
    at = f"{_scratch(spark, 'a2')}/sketches"
    spread.port_day_sketches(cand).write.partitionBy("day").parquet(at)
    kept = spark.read.schema("portName string, sketch binary, day date").parquet(at)
    whole = None
    for span, lo, hi in (("all days", 1, 31), ("days 5 to 20", 5, 20)):
        # every month's days of the range; a range in one month is one span of dates
        days = F.dayofmonth("day").between(lo, hi)
        near = spread.vessels_between(kept.where(days), F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
        exact = (cand.where(F.dayofmonth("base_date_time").between(lo, hi)).select("portName", "mmsi").distinct()
                 .groupBy("portName").agg(F.count("mmsi").alias("n_vessels")))
        rows = exact.join(near, "portName", "left").select(
            F.lit(span).alias("span"), "portName", "n_vessels",
            F.coalesce(F.abs(F.col("vessels") - F.col("n_vessels")) <= spread.tolerance(F.col("n_vessels")), F.lit(False)).alias("within"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


_J11_SQL = f"""
SELECT p.port_number, p.portName, CAST(coalesce(c.n, 0) AS BIGINT) AS port_call_count
FROM ports p LEFT JOIN (SELECT portName, count(DISTINCT mmsi) AS n FROM ({_MATCH_SQL}) GROUP BY portName) c
  USING (portName)"""


def _port_calls(spark, d):
    st = Stages(spark, d)
    m = sessions.match(st.visits_plan, MIN_TIME_IN_PORT_H)
    return sessions.port_call_counts(st.ports.select("port_number", "portName"), m) \
        .select("port_number", "portName", "port_call_count")


@register("j11_port_call_counts", W("visits", _J11_SQL))
def j11_port_call_counts(spark, d):
    return _port_calls(spark, d)


@register("o2_top_ports", W("visits", f"""
SELECT * FROM ({_J11_SQL}) ORDER BY port_call_count DESC, portName LIMIT {TOP_PORTS_N}"""))
def o2_top_ports(spark, d):
    return profile.top_n(_port_calls(spark, d), "port_call_count", TOP_PORTS_N, "portName")


# ---------------------------------------------------------------- labels --
@register("j3_current_port", W("labeled", "SELECT ping_id, mmsi, base_date_time, current_port FROM labeled"))
def j3_current_port(spark, d):
    return Stages(spark, d).labeled_plan.select("ping_id", "mmsi", "base_date_time", "current_port")


@register("j4_origin_port", W("labeled", "SELECT ping_id, origin_port FROM labeled"))
def j4_origin_port(spark, d):
    return Stages(spark, d).labeled_plan.select("ping_id", "origin_port")


@register("j5_destination_port", W("labeled", "SELECT ping_id, destination_port FROM labeled"))
def j5_destination_port(spark, d):
    return Stages(spark, d).labeled_plan.select("ping_id", "destination_port")


@register("j6_voyage_stamp", W("labeled", "SELECT ping_id, voyage_id FROM labeled"))
def j6_voyage_stamp(spark, d):
    return Stages(spark, d).labeled_plan.select("ping_id", "voyage_id")


@register("w3_visit_pairs", W("vpair", """
SELECT mmsi, portName AS departure_port, entry_time AS dep_entry_time, exit_time AS departure_time,
       arr_port AS arrival_port, arr_time AS arrival_time, arr_time > exit_time AS kept
FROM vpair WHERE arr_time IS NOT NULL"""))
def w3_visit_pairs(spark, d):
    return voyages.pair_visits(Stages(spark, d).visits_plan).select(
        "mmsi", "departure_port", "dep_entry_time", "departure_time", "arrival_port", "arrival_time", "kept")


@register("w10_voyage_numbering", W("voyages", "SELECT * FROM voyages"))
def w10_voyage_numbering(spark, d):
    return Stages(spark, d).voyages_base


@register("a4_routes", W("voyages_full", """
SELECT departure_port, arrival_port, CAST(count(*) AS BIGINT) AS n_voyages,
       round(avg(duration_hours), 6) AS mean_duration_hours,
       CAST(sum(ping_count) AS BIGINT) AS n_pings
FROM voyages_full GROUP BY departure_port, arrival_port"""))
def a4_routes(spark, d):
    return Stages(spark, d).voyages.groupBy("departure_port", "arrival_port").agg(
        F.count(F.lit(1)).alias("n_voyages"), r6(F.avg("duration_hours")).alias("mean_duration_hours"),
        F.sum("ping_count").cast("long").alias("n_pings"))


@register("p4_sea_pings", W("sea", "SELECT ping_id, mmsi, base_date_time, origin_port, destination_port, voyage_id FROM sea"))
def p4_sea_pings(spark, d):
    return feat.sea_pings(Stages(spark, d).labeled_plan).select(
        "ping_id", "mmsi", "base_date_time", "origin_port", "destination_port", "voyage_id")


@register("j8_voyage_attr", W("sea", "SELECT ping_id, voyage_id, arrival_time FROM sea"))
def j8_voyage_attr(spark, d):
    st = Stages(spark, d)
    return feat.attach_arrival(feat.sea_pings(st.labeled_plan), st.voyages_base).select("ping_id", "voyage_id", "arrival_time")


@register("w6_latest_per_vessel", W("labeled", """
SELECT mmsi, max(base_date_time) AS base_date_time,
       arg_max(current_port, (base_date_time, ping_id)) FILTER (WHERE current_port IS NOT NULL) AS current_port,
       arg_max(origin_port, (base_date_time, ping_id)) FILTER (WHERE origin_port IS NOT NULL) AS origin_port,
       arg_max(destination_port, (base_date_time, ping_id)) FILTER (WHERE destination_port IS NOT NULL) AS destination_port,
       arg_max(voyage_id, (base_date_time, ping_id)) FILTER (WHERE voyage_id IS NOT NULL) AS voyage_id,
       arg_max(sog, (base_date_time, ping_id)) FILTER (WHERE sog IS NOT NULL) AS sog
FROM labeled GROUP BY mmsi"""))
def w6_latest_per_vessel(spark, d):
    return feat.latest_per_vessel(Stages(spark, d).labeled_plan,
                                  ["current_port", "origin_port", "destination_port", "voyage_id", "sog"])


@register("u1_concat", W("pings", """
SELECT ping_id, mmsi, base_date_time, sog, CASE WHEN day(base_date_time) % 2 = 0 THEN cog END AS cog FROM pings"""))
def u1_concat(spark, d):
    """Frames with different column sets concatenated by name; the
    column missing from one part becomes NULL."""
    p = Stages(spark, d).pings.select("ping_id", "mmsi", "base_date_time", "sog", "cog")
    even = p.where(F.dayofmonth("base_date_time") % 2 == 0)
    odd = p.where(F.dayofmonth("base_date_time") % 2 == 1).drop("cog")
    return even.unionByName(odd, allowMissingColumns=True)


# ---------------------------------------------------------------- features
@register("j7_port_coords", W("sea", """
SELECT s.ping_id, d.lat_dd AS dest_lat, d.lon_dd AS dest_lon, o.lat_dd AS origin_lat, o.lon_dd AS origin_lon
FROM sea s LEFT JOIN ports d ON d.portName = s.destination_port LEFT JOIN ports o ON o.portName = s.origin_port"""))
def j7_port_coords(spark, d):
    st = Stages(spark, d)
    return feat.port_coordinates(feat.sea_pings(st.labeled_plan), st.ports) \
        .select("ping_id", "dest_lat", "dest_lon", "origin_lat", "origin_lon")


@register("f2_haversine", W("sea_dist", """
SELECT ping_id, round(remaining_dist_nm, 6) AS remaining_dist_nm, round(total_dist_nm, 6) AS total_dist_nm
FROM sea_dist"""))
def f2_haversine(spark, d):
    st = Stages(spark, d)
    f = feat.distance_features(st.sea_plan, st.ports)
    return f.select("ping_id", r6("remaining_dist_nm").alias("remaining_dist_nm"),
                    r6("total_dist_nm").alias("total_dist_nm"))


@register("f9_fraction_completed", W("sea_dist", "SELECT ping_id, round(fraction_completed, 6) AS fraction_completed FROM sea_dist"))
def f9_fraction_completed(spark, d):
    st = Stages(spark, d)
    return feat.distance_features(st.sea_plan, st.ports).select("ping_id", r6("fraction_completed").alias("fraction_completed"))


@register("f5_hours_between", W("features", "SELECT ping_id, remaining_travel_hours FROM features"))
def f5_hours_between(spark, d):
    return feat.remaining_travel(Stages(spark, d).sea_plan).select("ping_id", feat.LABEL)


@register("w4_rolling_sog", W("features", """
SELECT ping_id, round(sog_roll_6h, 6) AS sog_roll_6h, round(sog_roll_24h, 6) AS sog_roll_24h FROM features"""))
def w4_rolling_sog(spark, d):
    f = Stages(spark, d).features_plan
    return f.select("ping_id", r6("sog_roll_6h").alias("sog_roll_6h"), r6("sog_roll_24h").alias("sog_roll_24h"))


@register("w5_lane_deviation", W("features", """
SELECT ping_id, round(hist_avg_sog, 6) AS hist_avg_sog, round(sog_deviation, 6) AS sog_deviation FROM features"""))
def w5_lane_deviation(spark, d):
    f = Stages(spark, d).features_plan
    return f.select("ping_id", r6("hist_avg_sog").alias("hist_avg_sog"), r6("sog_deviation").alias("sog_deviation"))


_TRAIN_SQL_COLS = ", ".join(
    c if c in ("mmsi", "base_date_time", "origin_port", "destination_port", "voyage_id", "latitude",
               "longitude", "sog", "remaining_travel_hours")
    else f"round({c}, 6) AS {c}" for c in feat.FEATURE_COLUMNS)


def _rounded_training(f: DataFrame, more: list[str] = []) -> DataFrame:
    exact = {"mmsi", "base_date_time", "origin_port", "destination_port", "voyage_id", "latitude",
             "longitude", "sog", "remaining_travel_hours"}
    return f.select(*more, *[F.col(c) if c in exact else r6(c).alias(c) for c in feat.FEATURE_COLUMNS])


@register("p9_training_set", W("features", f"SELECT {_TRAIN_SQL_COLS} FROM features"))
def p9_training_set(spark, d):
    return _rounded_training(Stages(spark, d).features_plan)


@register("st5_latest_features", W("features", f"""
SELECT mmsi, max(base_date_time) AS base_date_time,
  {", ".join(f"arg_max({c}, (base_date_time, ping_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
             for c in feat.FEATURE_COLUMNS if c not in ("mmsi", "base_date_time"))}
FROM (SELECT ping_id, {_TRAIN_SQL_COLS} FROM features) GROUP BY mmsi"""))
def st5_latest_features(spark, d):
    """ST5 batch form up to the model input: latest non-null feature values
    per vessel (the rows the predictor scores)."""
    f = _rounded_training(Stages(spark, d).features_plan, ["ping_id"])
    return feat.latest_per_vessel(f, feat.FEATURE_COLUMNS)


@register("a6_describe_label", W("features", """
SELECT CAST(count(remaining_travel_hours) AS BIGINT) AS count, round(avg(remaining_travel_hours), 6) AS mean,
       round(stddev_samp(remaining_travel_hours), 6) AS std, min(remaining_travel_hours) AS min,
       round(quantile_cont(remaining_travel_hours, 0.25), 6) AS p25,
       round(quantile_cont(remaining_travel_hours, 0.5), 6) AS p50,
       round(quantile_cont(remaining_travel_hours, 0.75), 6) AS p75, max(remaining_travel_hours) AS max
FROM features"""))
def a6_describe_label(spark, d):
    t = profile.describe(Stages(spark, d).features, feat.LABEL)
    return t.select(F.col("count").cast("long"), r6("mean").alias("mean"), r6("std").alias("std"), "min",
                    r6("p25").alias("p25"), r6("p50").alias("p50"), r6("p75").alias("p75"), "max")


@register("a7_null_counts")
def a7_null_counts(spark, d):
    return profile.null_counts(feat.training_set(Stages(spark, d).features_plan), feat.FEATURE_COLUMNS) \
        .select("column_name", "nulls", r6("null_rate").alias("null_rate"))


ORACLE["a7_null_counts"] = W("features", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, "
    f"round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), 6) AS null_rate FROM features"
    for c in feat.FEATURE_COLUMNS))


@register("a7_observed_nulls")
def a7_observed_nulls(spark, d):
    """A7 + A9 counted while the training set is written: no scan of its own."""
    watched, found = profile.observed(feat.training_set(Stages(spark, d).features_plan), feat.FEATURE_COLUMNS)
    watched.write.parquet(f"{_scratch(spark, 'a7')}/training")
    return profile.observed_nulls(spark, found, feat.FEATURE_COLUMNS).select(
        "column_name", "nulls", r6("null_rate").alias("null_rate"), r6("coverage").alias("coverage"))


ORACLE["a7_observed_nulls"] = W("features", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, "
    f"round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), 6) AS null_rate, "
    f"round(CAST(count({c}) AS DOUBLE) / count(*), 6) AS coverage FROM features"
    for c in feat.FEATURE_COLUMNS))


@register("a8_dataset_counters", W("labeled", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT mmsi) AS BIGINT) AS n_vessels,
       CAST(count(DISTINCT voyage_id) AS BIGINT) AS n_voyages, CAST(count(DISTINCT current_port) AS BIGINT) AS n_ports,
       min(base_date_time) AS first_time, max(base_date_time) AS last_time,
       min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max,
       round(avg(CASE WHEN current_port IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share_in_port,
       round(avg(sog), 6) AS mean_sog, round(quantile_cont(sog, 0.5), 6) AS median_sog
FROM labeled"""))
def a8_dataset_counters(spark, d):
    st = Stages(spark, d)
    lab = st.stage(st.labeled_plan.select("mmsi", "voyage_id", "current_port", "base_date_time", "latitude",
                                          "longitude", "sog"), "counters")
    extra = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min("base_date_time").alias("first_time"), F.max("base_date_time").alias("last_time"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        r6(F.avg(F.col("current_port").isNotNull().cast("double"))).alias("share_in_port"),
        r6(F.avg("sog")).alias("mean_sog"),
    ]
    t = exact_percentiles(lab, "sog", [0.5], names=["median_sog"], extra_aggs=extra)
    # distinct counts over the distinct keys, each its own aggregation: one with all three would expand the table
    for c, key in (("n_vessels", "mmsi"), ("n_voyages", "voyage_id"), ("n_ports", "current_port")):
        t = t.withColumn(c, lab.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count(F.lit(1))).scalar())
    return t.select(*[F.col(c) for c in [
        "n_rows", "n_vessels", "n_voyages", "n_ports", "first_time", "last_time", "lat_min", "lat_max",
        "lon_min", "lon_max", "share_in_port", "mean_sog"]], r6("median_sog").alias("median_sog"))


@register("a5_vessel_type_counts", W("pings", "SELECT vessel_type, CAST(count(*) AS BIGINT) AS n FROM pings GROUP BY vessel_type"))
def a5_vessel_type_counts(spark, d):
    return profile.group_sizes(Stages(spark, d).pings, "vessel_type")


# ---------------------------------------------------------------- split ---
_SPLIT_SQL = f"""
SELECT voyage_id, CAST(rn <= CAST(ceil({TEST_SHARE} * n) AS BIGINT) AS BOOLEAN) AS is_test
FROM (SELECT voyage_id, row_number() OVER (ORDER BY ((voyage_id % 2147483648) * 1103515245 + {SEED}) % 2147483648, voyage_id) AS rn,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT voyage_id FROM features))"""


def voyage_split(features: DataFrame) -> DataFrame:
    """M3: distinct voyages; the first ceil(0.2 n) in seeded-hash order are
    the test set. The cut is an exact order statistic over distinct voyages,
    found from a range-partitioned running count, never by collecting ids."""
    v = features.select("voyage_id").distinct().withColumn("_h", profile.sample_hash(F.col("voyage_id"), SEED))
    n = v.count()
    k = int(math.ceil(TEST_SHARE * n))
    if k == 0:
        return v.select("voyage_id", F.lit(False).alias("is_test"))
    # The hash is a bijection on [0, 2^31) (odd multiplier), so the k-th
    # smallest hash is a unique cut; it is found as an exact order statistic.
    p = (k - 1) / max(n - 1, 1)
    cut = exact_percentiles(v, "_h", [p], names=["cut"], positions=[k - 1]).first()["cut"]
    return v.select("voyage_id", (F.col("_h") <= F.lit(cut)).alias("is_test"))


@register("m3_voyage_split", W("features", _SPLIT_SQL))
def m3_voyage_split(spark, d):
    return voyage_split(Stages(spark, d).features)


@register("j12_membership", W("features", f"""
SELECT f.ping_id, f.voyage_id FROM features f
WHERE f.voyage_id IN (SELECT voyage_id FROM ({_SPLIT_SQL}) WHERE is_test)"""))
def j12_membership(spark, d):
    f = Stages(spark, d).features
    test = voyage_split(f).where("is_test").select("voyage_id")
    return f.join(test, "voyage_id", "left_semi").select("ping_id", "voyage_id")


@register("o4_seeded_sample", W("features", f"""
SELECT ping_id, remaining_travel_hours FROM features
ORDER BY ((ping_id % 2147483648) * 1103515245 + {SEED}) % 2147483648, ping_id LIMIT {SAMPLE_N}"""))
def o4_seeded_sample(spark, d):
    return profile.seeded_sample(Stages(spark, d).features, "ping_id", SAMPLE_N, SEED) \
        .select("ping_id", feat.LABEL)


SMALL_SAMPLE_N = 100      # fewer than any table has


@register("o4_seeded_sample_bound", W("features", f"""
SELECT ping_id, remaining_travel_hours FROM features
ORDER BY ((ping_id % 2147483648) * 1103515245 + {SEED + 1}) % 2147483648, ping_id LIMIT {SMALL_SAMPLE_N}"""))
def o4_seeded_sample_bound(spark, d):
    """O4 where the limit binds, with another seed."""
    return profile.seeded_sample(Stages(spark, d).features, "ping_id", SMALL_SAMPLE_N, SEED + 1).select("ping_id", feat.LABEL)


# ---------------------------------------------------------------- fixtures/scalars
@register("f1_dms_to_dd", W("ports", """
SELECT portName,
  round(CASE WHEN trim(split_part(regexp_replace(latitude, '[°''"]+', '|', 'g'), '|', 4)) IN ('S', 'W') THEN -1 ELSE 1 END *
    (TRY_CAST(split_part(regexp_replace(latitude, '[°''"]+', '|', 'g'), '|', 1) AS DOUBLE)
     + TRY_CAST(split_part(regexp_replace(latitude, '[°''"]+', '|', 'g'), '|', 2) AS DOUBLE) / 60
     + TRY_CAST(split_part(regexp_replace(latitude, '[°''"]+', '|', 'g'), '|', 3) AS DOUBLE) / 3600), 6) AS lat_parsed,
  round(CASE WHEN trim(split_part(regexp_replace(longitude, '[°''"]+', '|', 'g'), '|', 4)) IN ('S', 'W') THEN -1 ELSE 1 END *
    (TRY_CAST(split_part(regexp_replace(longitude, '[°''"]+', '|', 'g'), '|', 1) AS DOUBLE)
     + TRY_CAST(split_part(regexp_replace(longitude, '[°''"]+', '|', 'g'), '|', 2) AS DOUBLE) / 60
     + TRY_CAST(split_part(regexp_replace(longitude, '[°''"]+', '|', 'g'), '|', 3) AS DOUBLE) / 3600), 6) AS lon_parsed
FROM (SELECT portName,
        CAST(lat_s // 3600 AS VARCHAR) || '°' || CAST((lat_s % 3600) // 60 AS VARCHAR) || '''' || CAST(lat_s % 60 AS VARCHAR) || '"N' AS latitude,
        CAST(lon_s // 3600 AS VARCHAR) || '°' || CAST((lon_s % 3600) // 60 AS VARCHAR) || '''' || CAST(lon_s % 60 AS VARCHAR) || '"W' AS longitude
      FROM ports)"""))
def f1_dms_to_dd(spark, d):
    p = Stages(spark, d).ports
    return p.select("portName", r6(geo.dms_to_dd("latitude")).alias("lat_parsed"),
                    r6(geo.dms_to_dd("longitude")).alias("lon_parsed"))


@register("f3_mercator", W("pings", """
SELECT ping_id, round(CAST(6378137 AS DOUBLE) * (longitude * pi() / 180), 3) AS x,
       round(CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + (latitude * pi() / 180) / 2)), 3) AS y FROM pings"""))
def f3_mercator(spark, d):
    p = Stages(spark, d).pings
    return p.select("ping_id", F.round(geo.mercator_x("longitude"), 3).alias("x"),
                    F.round(geo.mercator_y("latitude"), 3).alias("y"))


@register("f7_floor_hour", W("pings", "SELECT ping_id, date_trunc('hour', base_date_time) AS hour FROM pings"))
def f7_floor_hour(spark, d):
    return Stages(spark, d).pings.select("ping_id", geo.floor_hour("base_date_time").alias("hour"))


@register("f18_iso_text", W("pings", """
SELECT ping_id, CASE WHEN epoch_us(base_date_time) % 1000000 = 0 THEN strftime(base_date_time, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(base_date_time, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_text FROM pings"""))
def f18_iso_text(spark, d):
    return Stages(spark, d).pings.select("ping_id", geo.iso_timestamp("base_date_time").alias("ts_text"))


# ---------------------------------------------------------------- L5 ------
@register("j2_degree_buffer_left", W("porthours", "SELECT ping_id, mmsi, port_number, portName FROM pj"))
def j2_degree_buffer_left(spark, d):
    st = Stages(spark, d)
    return portcalls.ports_left_join(st.pings, st.ports).select("ping_id", "mmsi", "port_number", "portName")


@register("w8_in_port_runs", W("porthours", """
SELECT ping_id, port_number, in_port, CAST(port_group AS BIGINT) AS port_group FROM port_hours"""))
def w8_in_port_runs(spark, d):
    return Stages(spark, d).port_hours.select("ping_id", "port_number", "in_port",
                                              F.col("port_group").cast("long").alias("port_group"))


@register("w9_hours_in_port", W("porthours", """
SELECT ping_id, port_number, round(time_diff, 6) AS time_diff, round(hours_in_port, 6) AS hours_in_port
FROM port_hours"""))
def w9_hours_in_port(spark, d):
    return Stages(spark, d).port_hours.select("ping_id", "port_number", r6("time_diff").alias("time_diff"),
                                              r6("hours_in_port").alias("hours_in_port"))


@register("a17_candidates_per_port", W("porthours", """
SELECT portName, CAST(count(*) AS BIGINT) AS record_count FROM pcc GROUP BY portName"""))
def a17_candidates_per_port(spark, d):
    return portcalls.candidates_per_port(Stages(spark, d).port_call_candidates)


@register("a17_candidates_per_vessel", W("porthours", """
SELECT mmsi, CAST(count(*) AS BIGINT) AS record_count FROM pcc GROUP BY mmsi"""))
def a17_candidates_per_vessel(spark, d):
    return portcalls.candidates_per_vessel(Stages(spark, d).port_call_candidates)


@register("j1_buffer_polygons", W("cand", oracle.polygons(
    "(SELECT * FROM pings WHERE sog <= CAST(1.5 AS DOUBLE))", "mercator", 10.0 * geo.METRES_PER_NM, polygons.QUARTER_SEGMENTS) + """
SELECT ping_id, mmsi, base_date_time, portName FROM inside"""))
def j1_buffer_polygons(spark, d):
    """J1 within the buffers' polygons in place of circles."""
    st = Stages(spark, d)
    return polygons.find_candidates_in_buffers(st.pings, st.ports).select("ping_id", "mmsi", "base_date_time", "portName")


@register("j2_buffer_polygons", W("cand", oracle.polygons("pings", "degrees", BUFFER_NM * geo.DEGREES_PER_NM, BUFFER_SEGMENTS) + """
SELECT p.ping_id, i.port_number, i.portName FROM pings p LEFT JOIN inside i USING (ping_id)"""))
def j2_buffer_polygons(spark, d):
    """J2 within coarse polygons of a radius that pings lie on both sides of; some are in a circle
    and not in its polygon."""
    st = Stages(spark, d)
    return polygons.buffer_left_join(st.pings, st.ports, BUFFER_NM, BUFFER_SEGMENTS).select("ping_id", "port_number", "portName")


# ---------------------------------------------------------------- L4 weather
def _enriched(spark, d, *cols: str) -> DataFrame:
    """The enriched columns of an analysis that reads them several times."""
    return Stages(spark, d).enriched(*cols)


@register("f8_grid_cell", W("enriched", "SELECT ping_id, lat_bin, lon_bin FROM sea_k"))
def f8_grid_cell(spark, d):
    return Stages(spark, d).enriched_plan(()).select("ping_id", "lat_bin", "lon_bin")


@register("j9_cell_weather", W("enriched", """
SELECT ping_id, lat_bin, lon_bin, hour, wave_height, wave_direction, wave_period, swell_wave_height,
       ocean_current_velocity, ocean_current_direction, wind_speed_10m, wind_gusts_10m, wind_direction_10m,
       precipitation, weather_code, visibility
FROM enriched"""))
def j9_cell_weather(spark, d):
    return Stages(spark, d).enriched_plan(("marine", "wind")).select(
        "ping_id", "lat_bin", "lon_bin", "hour", "wave_height", "wave_direction", "wave_period",
        "swell_wave_height", "ocean_current_velocity", "ocean_current_direction", "wind_speed_10m",
        "wind_gusts_10m", "wind_direction_10m", "precipitation", "weather_code", "visibility")


@register("j10_port_weather", W("enriched", """
SELECT ping_id, destination_port, hour, port_wind_speed, port_wind_gusts, port_wind_direction,
       port_precipitation, port_weather_code, port_visibility FROM enriched"""))
def j10_port_weather(spark, d):
    return Stages(spark, d).enriched_plan(("port",)).select(
        "ping_id", "destination_port", "hour", "port_wind_speed", "port_wind_gusts", "port_wind_direction",
        "port_precipitation", "port_weather_code", "port_visibility")


def _stored(spark, d, part: str) -> tuple[DataFrame, DataFrame, str]:
    """Sea pings with cell keys, one part of their weather, and a folder to store it in."""
    st = Stages(spark, d)
    keyed = weather.add_cell_keys(feat.remaining_travel(st.sea))
    frames = dict(zip(weather.PARTS, (*fixtures.cell_weather(keyed), fixtures.port_weather(keyed, st.ports))))
    return keyed, frames[part], _scratch(spark, f"weather_{part}")


@register("j9_stored_weather", W("enriched", """
SELECT ping_id, lat_bin, lon_bin, hour, wind_speed_10m, wind_gusts_10m, wind_direction_10m, precipitation,
       weather_code, visibility, round(headwind_component, 6) AS headwind_component
FROM enriched"""))
def j9_stored_weather(spark, d):
    """J9 over stored weather: a table bucketed by (cell, hour), so that the join shuffles the pings alone."""
    keyed, wind, path = _stored(spark, d, "wind")
    table = f"wind_{uuid.uuid4().hex}"
    weather.store_cell_weather(wind, table, path, WEATHER_BUCKETS)
    stored = weather.open_cell_weather(spark, table, path, WEATHER_BUCKETS)
    e = weather.derived_weather(weather.join_stored_cell_weather(keyed, stored))
    return e.select("ping_id", *weather.CELL, *weather.WIND_COLUMNS, r6("headwind_component").alias("headwind_component"))


@register("j10_stored_weather", W("enriched", """
SELECT ping_id, destination_port, hour, port_wind_speed, port_wind_gusts, port_wind_direction,
       port_precipitation, port_weather_code, port_visibility, port_high_wind, port_precip_flag
FROM enriched"""))
def j10_stored_weather(spark, d):
    """J10 over stored weather: a folder a port, of which only those that pings head for are read."""
    keyed, port, path = _stored(spark, d, "port")
    weather.store_port_weather(port, path)
    e = weather.enrich(keyed, {"port": weather.stored_port_weather(keyed, path)})
    return e.select("ping_id", "destination_port", "hour", *weather.PORT_RENAME.values(), "port_high_wind", "port_precip_flag")


@register("f11_headwind", W("enriched", "SELECT ping_id, round(headwind_component, 6) AS headwind_component FROM enriched"))
def f11_headwind(spark, d):
    return Stages(spark, d).enriched_plan(("wind",)).select("ping_id", r6("headwind_component").alias("headwind_component"))


@register("f12_sea_state", W("enriched", "SELECT ping_id, wave_height, sea_state FROM enriched"))
def f12_sea_state(spark, d):
    return Stages(spark, d).enriched_plan(("marine",)).select("ping_id", "wave_height", "sea_state")


@register("f13_weather_flags", W("enriched", """
SELECT ping_id, adverse_sea_state, port_high_wind, port_precip_flag FROM enriched"""))
def f13_weather_flags(spark, d):
    return Stages(spark, d).enriched_plan().select("ping_id", "adverse_sea_state", "port_high_wind", "port_precip_flag")


_WEATHER_COV = ["wave_height", "wave_period", "swell_wave_height", "ocean_current_velocity",
                "wind_speed_10m", "wind_gusts_10m", "precipitation", "visibility", "port_wind_speed"]


@register("a9_coverage", W("enriched", "SELECT " + ", ".join(
    f"round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}_coverage" for c in _WEATHER_COV)
    + " FROM enriched"))
def a9_coverage(spark, d):
    t = profile.coverage(Stages(spark, d).enriched_plan(), _WEATHER_COV)
    return t.select(*[r6(f"{c}_coverage").alias(f"{c}_coverage") for c in _WEATHER_COV])


def _valid(e: DataFrame) -> DataFrame:
    """P10: rows with wave height, wind speed and sog present."""
    return e.na.drop("any", subset=["wave_height", "wind_speed_10m", "sog"])


def _qcut_sql(col: str, src: str) -> str:
    return f"""(SELECT len(list_filter(e[2:], lambda x: x < {col}))
       FROM (SELECT list_sort(list_distinct(quantile_cont({col}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM {src}))"""


_VALID_SQL = "valid AS (SELECT * FROM enriched WHERE wave_height IS NOT NULL AND wind_speed_10m IS NOT NULL AND sog IS NOT NULL)"


@register("f14_quintile_bins", W("enriched", f""", {_VALID_SQL}
SELECT ping_id, CAST({_qcut_sql('wave_height', 'valid')} AS INTEGER) AS wave_bin,
       CAST({_qcut_sql('wind_speed_10m', 'valid')} AS INTEGER) AS wind_bin
FROM valid""").replace("\n, valid AS", ",\nvalid AS"))
def f14_quintile_bins(spark, d):
    v = _valid(_enriched(spark, d, "ping_id", "wave_height", "wind_speed_10m", "sog"))
    v = profile.quantile_bins(v, "wave_height", "wave_bin")
    v = profile.quantile_bins(v, "wind_speed_10m", "wind_bin")
    return v.select("ping_id", "wave_bin", "wind_bin")


@register("a10_speed_by_quintile", W("enriched", f""", {_VALID_SQL},
binned AS (SELECT *, CAST({_qcut_sql('wave_height', 'valid')} AS INTEGER) AS wave_bin,
                  CAST({_qcut_sql('wind_speed_10m', 'valid')} AS INTEGER) AS wind_bin FROM valid)
SELECT 'wave_height' AS variable, wave_bin AS bin, round(quantile_cont(sog, 0.5), 6) AS median_sog,
       round(quantile_cont(sog, 0.25), 6) AS q1_sog, round(quantile_cont(sog, 0.75), 6) AS q3_sog,
       round(quantile_cont(wave_height, 0.5), 6) AS mid_value FROM binned GROUP BY wave_bin
UNION ALL
SELECT 'wind_speed_10m', wind_bin, round(quantile_cont(sog, 0.5), 6), round(quantile_cont(sog, 0.25), 6),
       round(quantile_cont(sog, 0.75), 6), round(quantile_cont(wind_speed_10m, 0.5), 6)
FROM binned GROUP BY wind_bin""").replace("\n, valid AS", ",\nvalid AS"))
def a10_speed_by_quintile(spark, d):
    v = _valid(_enriched(spark, d, "wave_height", "wind_speed_10m", "sog"))
    out = None
    for var, b in (("wave_height", "wave_bin"), ("wind_speed_10m", "wind_bin")):
        binned = profile.quantile_bins(v, var, "bin")
        s = exact_percentiles(binned, "sog", [0.5, 0.25, 0.75], ["median_sog", "q1_sog", "q3_sog"], ["bin"])
        m = exact_percentiles(binned, var, [0.5], ["mid_value"], ["bin"])
        t = s.join(m, "bin").select(F.lit(var).alias("variable"), "bin", *[
            r6(c).alias(c) for c in ["median_sog", "q1_sog", "q3_sog", "mid_value"]])
        out = t if out is None else out.unionByName(t)
    return out


@register("a11_busy_port_weather", W("enriched", f"""
, top AS (SELECT destination_port FROM enriched GROUP BY destination_port
          ORDER BY count(*) DESC, destination_port LIMIT {BUSY_PORTS_N})
SELECT destination_port, CAST(count(sog) AS BIGINT) AS ping_count, round(avg(port_wind_speed), 6) AS mean_port_wind,
       max(port_wind_gusts) AS max_port_gusts, round(sum(port_precipitation), 6) AS total_precip,
       round(avg(remaining_travel_hours), 6) AS mean_remaining_hrs
FROM enriched WHERE destination_port IN (SELECT destination_port FROM top) GROUP BY destination_port""")
    .replace("\n, top AS", ",\ntop AS"))
def a11_busy_port_weather(spark, d):
    e = _enriched(spark, d, "destination_port", "sog", "port_wind_speed", "port_wind_gusts", "port_precipitation",
                  feat.LABEL)
    top = profile.top_n(profile.group_sizes(e, "destination_port"), "n", BUSY_PORTS_N, "destination_port")
    return e.join(F.broadcast(top.select("destination_port")), "destination_port", "left_semi") \
        .groupBy("destination_port").agg(
            F.count("sog").alias("ping_count"), r6(F.avg("port_wind_speed")).alias("mean_port_wind"),
            F.max("port_wind_gusts").alias("max_port_gusts"), r6(F.sum("port_precipitation")).alias("total_precip"),
            r6(F.avg("remaining_travel_hours")).alias("mean_remaining_hrs"))


@register("a12_roughest_voyage", W("enriched", """
, med AS (SELECT voyage_id, quantile_cont(wave_height, 0.5) AS median_wave FROM enriched
          WHERE wave_height IS NOT NULL GROUP BY voyage_id),
pick AS (SELECT voyage_id, median_wave FROM med ORDER BY median_wave DESC, voyage_id LIMIT 1)
SELECT e.voyage_id, min(e.origin_port) AS origin_port, min(e.destination_port) AS destination_port,
       min(e.base_date_time) AS start_time, max(e.base_date_time) AS end_time,
       round(quantile_cont(e.wave_height, 0.5), 6) AS median_wave_height, CAST(count(*) AS BIGINT) AS n_pings
FROM enriched e JOIN pick USING (voyage_id) GROUP BY e.voyage_id""").replace("\n, med AS", ",\nmed AS"))
def a12_roughest_voyage(spark, d):
    """The voyage with the largest median wave height, and its track summary."""
    e = _enriched(spark, d, "voyage_id", "wave_height", "origin_port", "destination_port", "base_date_time")
    med = exact_percentiles(e, "wave_height", [0.5], ["median_wave"], ["voyage_id"])
    pick = med.orderBy(F.col("median_wave").desc(), "voyage_id").limit(1).select("voyage_id")
    track = e.join(F.broadcast(pick), "voyage_id", "left_semi")
    s = exact_percentiles(track, "wave_height", [0.5], ["median_wave_height"], ["voyage_id"], extra_aggs=[
        F.min("origin_port").alias("origin_port"), F.min("destination_port").alias("destination_port"),
        F.min("base_date_time").alias("start_time"), F.max("base_date_time").alias("end_time"),
        F.count(F.lit(1)).alias("n_pings")])
    return s.select("voyage_id", "origin_port", "destination_port", "start_time", "end_time",
                    r6("median_wave_height").alias("median_wave_height"), "n_pings")


@register("a13_speed_by_sea_state", W("enriched", """
SELECT sea_state, round(quantile_cont(sog, 0.5), 6) AS median_sog, CAST(count(*) AS BIGINT) AS n
FROM enriched WHERE sea_state IS NOT NULL AND sog IS NOT NULL GROUP BY sea_state"""))
def a13_speed_by_sea_state(spark, d):
    e = _enriched(spark, d, "sea_state", "sog").na.drop("any")
    t = exact_percentiles(e, "sog", [0.5], ["median_sog"], ["sea_state"], extra_aggs=[F.count(F.lit(1)).alias("n")])
    return t.select("sea_state", r6("median_sog").alias("median_sog"), "n")


_HW_SQL = """
, hw AS (SELECT * FROM enriched WHERE headwind_component IS NOT NULL AND sog IS NOT NULL),
hw_s AS (SELECT min(headwind_component) AS lo, (max(headwind_component) - min(headwind_component)) / 20 AS w FROM hw),
hw_b AS (SELECT hw.*, CASE WHEN w > 0 THEN CAST(greatest(ceil((headwind_component - lo) / w), 1) AS INTEGER) ELSE 1 END
           AS hw_bin, lo, w FROM hw, hw_s)"""


def _hw_binned(spark, d):
    """All rows with a head wind and a speed in 20 equal-width bins; the lower edge and the width."""
    e = _enriched(spark, d, "ping_id", "headwind_component", "sog").na.drop("any")
    st = e.agg(F.min("headwind_component").alias("lo"), F.max("headwind_component").alias("hi")).first()
    lo, w = (0.0, 0.0) if st["lo"] is None else (st["lo"], (st["hi"] - st["lo"]) / 20)
    return e.withColumn("hw_bin", geo.equal_width_bin("headwind_component", F.lit(lo), F.lit(w))), lo, w


@register("f15_equal_width_bins", W("enriched", _HW_SQL + "\nSELECT ping_id, hw_bin FROM hw_b")
          .replace("\n, hw AS", ",\nhw AS"))
def f15_equal_width_bins(spark, d):
    b, _, _ = _hw_binned(spark, d)
    return b.select("ping_id", "hw_bin")


@register("a14_headwind_binned_mean", W("enriched", _HW_SQL + """
SELECT hw_bin, round(min(lo) + (hw_bin - 0.5) * min(w), 6) AS bin_mid, round(avg(sog), 6) AS mean_sog,
       CAST(count(*) AS BIGINT) AS n FROM hw_b GROUP BY hw_bin""").replace("\n, hw AS", ",\nhw AS"))
def a14_headwind_binned_mean(spark, d):
    b, lo, w = _hw_binned(spark, d)
    return b.groupBy("hw_bin").agg(
        r6(F.lit(lo) + (F.col("hw_bin") - 0.5) * F.lit(w)).alias("bin_mid"),
        r6(F.avg("sog")).alias("mean_sog"), F.count(F.lit(1)).alias("n"))


def _hist_sql(col: str, split: str | None) -> str:
    keys = f"{split}, " if split else ""
    part = f"PARTITION BY {split}" if split else ""
    return f"""
, hs AS (SELECT min({col}) AS lo, max({col}) AS hi FROM enriched WHERE {col} IS NOT NULL),
hb AS (SELECT {keys}CAST(least(floor(({col} - lo) / CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 1 END), 39) AS INTEGER) AS bin,
              lo, CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 1 END AS w
       FROM enriched, hs WHERE {col} IS NOT NULL),
hc AS (SELECT {keys}bin, min(lo) AS lo, min(w) AS w, count(*) AS n FROM hb GROUP BY {keys}bin)
SELECT {keys}bin, round(lo + bin * w, 6) AS bin_lo, CAST(n AS BIGINT) AS count,
       round(n / (sum(n) OVER ({part}) * w), 6) AS density FROM hc"""


@register("a15_histogram", W("enriched", _hist_sql("wave_height", None).replace("\n, hs AS", ",\nhs AS")))
def a15_histogram(spark, d):
    h = profile.equal_width_hist(_enriched(spark, d, "wave_height"), "wave_height", 40)
    return h.select("bin", r6("bin_lo").alias("bin_lo"), "count", r6("density").alias("density"))


@register("a15_density_by_flag", W("enriched", _hist_sql("remaining_travel_hours", "port_high_wind")
                                   .replace("\n, hs AS", ",\nhs AS")))
def a15_density_by_flag(spark, d):
    e = _enriched(spark, d, "port_high_wind", feat.LABEL).where(F.col("port_high_wind").isNotNull())
    h = profile.equal_width_hist(e, "remaining_travel_hours", 40, split="port_high_wind")
    return h.select("port_high_wind", "bin", r6("bin_lo").alias("bin_lo"), "count", r6("density").alias("density"))


def _corr(spark, d):
    e = Stages(spark, d).enriched_plan().na.drop("all", subset=CORR_FEATURES + CORR_TARGETS)
    return profile.correlations(e, CORR_FEATURES, CORR_TARGETS)


_CORR_BODY = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, " + ", ".join(f"corr({f}, {t}) AS corr_{t}" for t in CORR_TARGETS)
    + " FROM enriched" for f in CORR_FEATURES)


@register("a16_correlations", W("enriched", f"""
SELECT feature, {", ".join(f"round(corr_{t}, 6) AS corr_{t}" for t in CORR_TARGETS)},
       CAST(row_number() OVER (ORDER BY abs(corr_{CORR_TARGETS[0]}) DESC NULLS LAST, feature) AS BIGINT) AS abs_rank
FROM ({_CORR_BODY})"""))
def a16_correlations(spark, d):
    c = _corr(spark, d)
    return c.select("feature", *[r6(f"corr_{t}").alias(f"corr_{t}") for t in CORR_TARGETS], "abs_rank")


@register("o3_abs_order", W("enriched", f"""
SELECT feature, CAST(row_number() OVER (ORDER BY abs(corr_{CORR_TARGETS[0]}) DESC NULLS LAST, feature) AS BIGINT) AS abs_rank
FROM ({_CORR_BODY})"""))
def o3_abs_order(spark, d):
    return _corr(spark, d).select("feature", "abs_rank")


# ---------------------------------------------------------------- sorted output, preview, keys
@register("o1_sorted_output", W("visits", """
SELECT mmsi, portName, entry_time, CAST(row_number() OVER (ORDER BY entry_time, mmsi, portName) AS BIGINT) AS pos FROM visits"""))
def o1_sorted_output(spark, d):
    """O1: visits in (entry_time, mmsi, portName) order with their place in it,
    from range partitions (no task sorts everything)."""
    return range_running_sum(Stages(spark, d).visits_plan.select("mmsi", "portName", "entry_time"), [],
                             ["entry_time", "mmsi", "portName"], F.lit(1), "pos").select(
        "mmsi", "portName", "entry_time", F.col("pos").cast("long").alias("pos"))


@register("o5_preview", W("pings", f"""
SELECT ping_id, mmsi, base_date_time, latitude, longitude, sog FROM pings ORDER BY base_date_time, ping_id LIMIT {PREVIEW_N}"""))
def o5_preview(spark, d):
    """The first rows in time order (a top-k, not a sort)."""
    return profile.preview(Stages(spark, d).pings.select("ping_id", "mmsi", "base_date_time", "latitude", "longitude", "sog"),
                           ["base_date_time", "ping_id"], PREVIEW_N)


@register("f21_numeric_coercion", W("pings", """
SELECT ping_id, TRY_CAST(trunc(TRY_CAST(txt AS DOUBLE)) AS INTEGER) AS vessel_type
FROM (SELECT ping_id, CASE ping_id % 4 WHEN 0 THEN vessel_type || '.0' WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || vessel_type
                           ELSE vessel_type || '' END AS txt FROM pings)"""))
def f21_numeric_coercion(spark, d):
    """numbers written as text in several ways; what is no number becomes NULL."""
    vt = F.col("vessel_type").cast("string")
    k = F.col("ping_id") % 4
    txt = F.when(k == 0, F.concat(vt, F.lit(".0"))).when(k == 1, F.lit("n/a")).when(k == 2, F.concat(F.lit(" "), vt)).otherwise(vt)
    return Stages(spark, d).pings.select("ping_id", geo.to_int(txt).alias("vessel_type"))


@register("f22_safe_key", W("ports", "SELECT portName, replace(replace(portName, '/', '_'), ' ', '_') AS port_key FROM ports"))
def f22_safe_key(spark, d):
    return Stages(spark, d).ports.select("portName", geo.safe_key("portName").alias("port_key"))


# ---------------------------------------------------------------- sources over files written from the tables
def _scratch(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewater/{tag}-{uuid.uuid4().hex}"


_AIS_COLS = ["mmsi", "base_date_time", "latitude", "longitude", "sog", "vessel_type"]


@register("s1_parquet_scan", W("pings", f"""
SELECT {", ".join(_AIS_COLS)}, CASE WHEN day(base_date_time) % 2 = 0 THEN cog END AS cog FROM pings"""))
def s1_parquet_scan(spark, d):
    """S1 + U1: two folders of daily files with different columns, read as one table."""
    p, base = Stages(spark, d).pings, _scratch(spark, "s1")
    day = F.dayofmonth("base_date_time") % 2
    dated = p.withColumn("date", F.to_date("base_date_time"))
    for k, cols in ((0, [*_AIS_COLS, "cog"]), (1, _AIS_COLS)):
        dated.where(day == k).select(*cols, "date").write.partitionBy("date").parquet(f"{base}/{k}")
    return ais.read_ais_parquet(spark, [f"{base}/0", f"{base}/1"]).select(*_AIS_COLS, "cog")


def _raw_csv(p: DataFrame, path: str, backwards: bool = False) -> None:
    """Daily raw CSV as providers write it: their column names, numbers as text, some broken; the
    columns in another order with ``backwards``."""
    k = F.col("ping_id") % 97
    vt = F.col("vessel_type").cast("string")
    cols = [F.col("mmsi").alias("MMSI"),
            F.when(k == 7, F.lit("not a time")).otherwise(geo.iso_timestamp("base_date_time")).alias("BaseDateTime"),
            F.col("latitude").alias("LAT"), F.col("longitude").alias("LON"), F.col("sog").alias("SOG"), F.col("cog").alias("COG"),
            F.when(k == 0, F.lit("n/a")).when(k % 2 == 1, F.concat(vt, F.lit(".0"))).otherwise(vt).alias("VesselType")]
    p.select(F.to_date("base_date_time").alias("day"), *(cols[::-1] if backwards else cols)) \
        .write.option("header", True).partitionBy("day").csv(path)


@register("s2_daily_csv_ingest", W("pings", """
SELECT mmsi, base_date_time, latitude, longitude, sog, vessel_type FROM pings
WHERE ping_id % 97 NOT IN (0, 7) AND vessel_type BETWEEN 70 AND 79"""))
def s2_daily_csv_ingest(spark, d):
    """Raw files of three deliveries, one with its columns in another order, ingested by two
    runs; the second one meets the first one's files again and reads the new ones."""
    p, base = Stages(spark, d).pings, _scratch(spark, "s2")
    day = F.dayofmonth("base_date_time")
    _raw_csv(p.where(day <= 10), f"{base}/csv/a")
    _raw_csv(p.where(day.between(11, 15)), f"{base}/csv/b", backwards=True)
    ais.ingest_daily_csv(spark, f"{base}/csv", f"{base}/pings")
    _raw_csv(p.where(day > 15), f"{base}/csv/c")
    return ais.ingest_daily_csv(spark, f"{base}/csv", f"{base}/pings").select(*_AIS_COLS)


@register("s3_port_csv", W("ports", "SELECT port_number, portName, round(lat_dd, 6) AS lat_dd, round(lon_dd, 6) AS lon_dd FROM ports"))
def s3_port_csv(spark, d):
    """S3: the port list through a CSV file with doubled quotes, DMS text to degrees."""
    base = _scratch(spark, "s3")
    Stages(spark, d).ports.select(F.col("port_number").alias("portNumber"), "portName", F.lit("US").alias("countryCode"),
                                  "longitude", "latitude", F.lit("x").alias("dodWaterBody")) \
        .write.option("header", True).option("escape", '"').option("quoteAll", True).csv(base)
    good, _ = ais.read_ports_csv(spark, base)
    return good.select("port_number", "portName", r6("lat_dd").alias("lat_dd"), r6("lon_dd").alias("lon_dd"))


@register("s4_stage_reuse", W("voyages_full", "SELECT * FROM voyages_full"))
def s4_stage_reuse(spark, d):
    """Voyages from the stage tables that an earlier run kept; the second run has no pings to read."""
    keep = _scratch(spark, "s4")
    first = Stages(spark, d, keep_dir=keep)
    first.labeled.count()
    again = Stages(spark, d, pings_df=first.pings.limit(0), keep_dir=keep)
    return voyages.count_voyage_pings(again.voyages_base, again.labeled)


@register("s4_daily_pipeline", W("voyages", """
SELECT 'visit' AS kind, mmsi, portName AS port, entry_time AS from_time, exit_time AS to_time, NULL AS to_port, round(duration_hours, 6) AS hours FROM visits
UNION ALL SELECT 'voyage', mmsi, departure_port, departure_time, arrival_time, arrival_port, round(duration_hours, 6) FROM voyages"""))
def s4_daily_pipeline(spark, d):
    """S4 + S2 day by day: visits and voyages kept up to date over four runs, the last two days by themselves;
    then the last run but one again."""
    st = Stages(spark, d)
    ends = st.pings.agg(F.min(F.to_date("base_date_time")).alias("lo"), F.max(F.to_date("base_date_time")).alias("hi")).first()
    daily = DailyVisits(spark, _scratch(spark, "s4d"), st.pings, st.ports)
    for back in (9, 1, 0, -1):
        daily.advance(ends["hi"] - datetime.timedelta(days=back))
    daily.redo(ends["hi"] - datetime.timedelta(days=1))
    v = daily.visits().select(F.lit("visit").alias("kind"), "mmsi", F.col("portName").alias("port"), F.col("entry_time").alias("from_time"),
                              F.col("exit_time").alias("to_time"), F.lit(None).cast("string").alias("to_port"), r6("duration_hours").alias("hours"))
    w = daily.voyages().select(F.lit("voyage").alias("kind"), "mmsi", F.col("departure_port").alias("port"), F.col("departure_time").alias("from_time"),
                               F.col("arrival_time").alias("to_time"), F.col("arrival_port").alias("to_port"), r6("duration_hours").alias("hours"))
    return v.unionByName(w)


@register("s5_weather_payloads", W("enriched", """
SELECT lat_bin, lon_bin, hour, wave_height, wave_direction, wave_period, swell_wave_height, ocean_current_velocity,
       ocean_current_direction FROM marine"""))
def s5_weather_payloads(spark, d):
    """Marine weather through JSON payload files with parallel hourly arrays."""
    st, base = Stages(spark, d), _scratch(spark, "s5")
    marine, _ = fixtures.cell_weather(weather.add_cell_keys(feat.remaining_travel(st.sea_plan)))
    key = ["lat_bin", "lon_bin"]
    ais.write_weather_payloads(marine.withColumnRenamed("hour", "time"), key, ais.MARINE_HOURLY, base)
    return ais.read_weather_payloads(spark, base, ais.MARINE_HOURLY, {k: T.DoubleType() for k in key}) \
        .select(*key, "hour", *ais.MARINE_HOURLY)


# ---------------------------------------------------------------- streaming
def _replayed_visits(spark, st: Stages, files_per_trigger: int) -> DataFrame:
    """The sink of the visit stream over a replay with a late ping: a copy of a slow ping 60
    days before the first one, which comes last and must not open a visit."""
    base = _scratch(spark, "st7")
    slow = st.pings.where("sog <= 1.5 and mmsi > 0")
    late = slow.where(F.col("base_date_time") == F.lit(slow.agg(F.min("base_date_time")).first()[0])) \
        .withColumn("base_date_time", F.col("base_date_time") - F.make_dt_interval(days=F.lit(60)))
    S.write_replay(st.pings, f"{base}/in", heartbeat_after_h=2 * 24.0, late=late)
    msgs = S.read_file_stream(spark, f"{base}/in", files_per_trigger)
    q = (S.stream_port_visits(msgs, st.ports).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("st7_stream_visits", W("visits", "SELECT * FROM visits WHERE mmsi <> 0"))
def st7_stream_visits(spark, d):
    """ST7 + ST8 (+S9, ST1, P7, ST4): visits computed by a Structured Streaming
    query over the time-ordered JSON replay of the pings (file source, several
    micro-batches, a late ping at the end), sessionized with a watermark and
    session_window, appended to parquet; returns the sink table. Vessel id 0 is
    dropped by P7."""
    return _replayed_visits(spark, Stages(spark, d), files_per_trigger=8)


@register("st9_restart", W("pings", """
SELECT mmsi, CAST(count(*) AS BIGINT) AS n, min(base_date_time) AS first_time FROM pings WHERE mmsi <> 0 GROUP BY mmsi"""))
def st9_restart(spark, d):
    """ST9: a stream that fails in the middle of its second batch, after the batch was
    written, and is started again: the replayed batch overwrites its folder, nothing is lost or doubled."""
    base = _scratch(spark, "st9")
    S.write_replay(Stages(spark, d).pings, f"{base}/in")
    failed = []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("planned failure")

    def run():
        S.read_file_stream(spark, f"{base}/in", 8).writeStream.foreachBatch(sink) \
            .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    try:
        run()
    except StreamingQueryException as e:
        if "planned failure" not in str(e):
            raise
    run()
    return spark.read.schema(S.BUFFER_SCHEMA).parquet(f"{base}/out").groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), F.min("base_date_time").alias("first_time"))


BUFFER_US = int(keyed.BUFFER_HOURS) * 3600000000
_TRACKS_SQL = f"""
SELECT mmsi, min(base_date_time) AS first_time, max(base_date_time) AS last_time, count(*) AS n_pings,
  round(avg(sog), 6) AS mean_sog, arg_max(latitude, base_date_time) AS latitude, arg_max(longitude, base_date_time) AS longitude
FROM (SELECT *, max(us) OVER (PARTITION BY mmsi, track) AS hi FROM (
  SELECT *, sum(brk) OVER (PARTITION BY mmsi ORDER BY us) AS track FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY mmsi ORDER BY us) > {BUFFER_US} THEN 1 ELSE 0 END AS brk
    FROM (SELECT *, epoch_us(base_date_time) AS us FROM {{src}} WHERE mmsi <> 0))))
WHERE us >= hi - {BUFFER_US} GROUP BY mmsi, track"""


def _arrivals(spark, base: str):
    """(a function that lets pings arrive as a replay folder, one that runs the keyed stream over what has come)."""
    def arrive(pings: DataFrame, name: str, **kw) -> None:
        S.write_replay(pings, f"{base}/in/part={name}", **kw)

    def run() -> list[dict]:
        return keyed.run_tracks(S.read_file_stream(spark, f"{base}/in", 8), f"{base}/out", f"{base}/checkpoint")
    return arrive, run


@register("st2_vessel_buffer", W("pings", _TRACKS_SQL.format(src="pings")))
def st2_vessel_buffer(spark, d):
    """ST2 + ST3 in scale mode: 48 h of pings per vessel in keyed state, evicted by event-time
    timers. The stream is stopped in the middle of the replay and started again; a heartbeat
    lets the timers of the last tracks fire."""
    st, base = Stages(spark, d), _scratch(spark, "st2")
    arrive, run = _arrivals(spark, base)
    mid = F.dayofmonth("base_date_time") <= 15
    month = F.date_trunc("month", "base_date_time") == F.lit(st.pings.agg(F.min(F.date_trunc("month", "base_date_time"))).first()[0])
    early = F.coalesce(month & mid, F.lit(False))
    arrive(st.pings.where(early), "a")
    run()
    arrive(st.pings.where(~early), "b", heartbeat_after_h=5 * keyed.BUFFER_HOURS)
    run()
    return spark.read.parquet(f"{base}/out").withColumn("mean_sog", r6("mean_sog"))


def _late(pings: DataFrame) -> DataFrame:
    """A ping more of every vessel, from its last one: at the cutoff (even ids) or a second before it (odd ids)."""
    cut = pings.agg((F.max("base_date_time") - F.expr(f"INTERVAL '{int(keyed.BUFFER_HOURS)}' HOUR")).alias("c")).first()[0]
    last = pings.where("mmsi > 0").groupBy("mmsi").agg(F.max_by(F.struct("ping_id", "latitude", "longitude", "sog", "cog", "vessel_type"),
                                                               F.struct("base_date_time", "ping_id")).alias("r"))
    at = F.lit(cut).cast("timestamp_ntz")
    return last.select("mmsi", "r.*").withColumn(
        "base_date_time", F.when(F.col("mmsi") % 2 == 0, at).otherwise(at - F.expr("INTERVAL '1' SECOND")))


_WITH_LATE = f"""(SELECT mmsi, base_date_time, sog, latitude, longitude FROM pings
  UNION ALL SELECT mmsi, (SELECT max(base_date_time) FROM pings) - INTERVAL {int(keyed.BUFFER_HOURS)} HOUR, 0, 0, 0
  FROM (SELECT DISTINCT mmsi FROM pings WHERE mmsi > 0 AND mmsi % 2 = 0))"""


@register("st8_late_pings", W("pings", f"""
SELECT mmsi, last_time, n_pings FROM ({_TRACKS_SQL.format(src=_WITH_LATE)})
UNION ALL SELECT 0, NULL, (SELECT count(DISTINCT mmsi) FROM pings WHERE mmsi % 2 = 1)"""))
def st8_late_pings(spark, d):
    """ST8: late pings of every vessel after all others, at the cutoff of the buffer (kept) and
    a second before it (rejected, counted by the stream's progress as vessel 0)."""
    st, base = Stages(spark, d), _scratch(spark, "st8")
    arrive, run = _arrivals(spark, base)
    arrive(st.pings, "a")
    run()
    late = _late(st.pings)
    arrive(late, "b")
    n = keyed.rejected(run())
    arrive(st.pings.limit(0).unionByName(late.orderBy("mmsi").limit(1), allowMissingColumns=True).withColumn(
        "base_date_time", F.col("base_date_time") + F.expr(f"INTERVAL '{int(5 * keyed.BUFFER_HOURS)}' HOUR"))
        .withColumn("mmsi", F.lit(S.HEARTBEAT_MMSI).cast("long")), "c")
    run()
    counted = spark.range(1).select(F.lit(0).cast("long").alias("mmsi"), F.lit(None).cast("timestamp_ntz").alias("last_time"),
                                    F.lit(n).cast("long").alias("n_pings"))
    return spark.read.parquet(f"{base}/out").select("mmsi", "last_time", "n_pings").unionByName(counted)


@register("f20_message_quality", W("pings", """
SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN ping_id % 50 = 1 THEN 'bad json' WHEN ping_id % 50 = 2 THEN 'bad time' WHEN mmsi = 0 THEN 'no vessel'
              ELSE 'ok' END AS status FROM pings) GROUP BY status"""))
def f20_message_quality(spark, d):
    """messages by what is wrong with them; none stops the reader."""
    p = Stages(spark, d).pings
    k = F.col("ping_id") % 50
    msgs = p.select("ping_id", F.to_json(S._message(p)).alias("value"))
    broken = F.when(k == 1, F.expr("left(value, length(value) - 9)")) \
        .when(k == 2, F.regexp_replace("value", '"base_date_time":"[^"]*"', '"base_date_time":"31 Foo"')).otherwise(F.col("value"))
    return S.message_quality(msgs.select(broken.alias("value")))


O6_BUFFER_H, O6_FILES = 48, 10
_O6_SQL = f"""WITH {oracle.cte("ports")}, {oracle.cte("pings").replace("pings AS (", "pings0 AS (", 1)},
units AS (SELECT *, epoch_us(base_date_time) AS us, dense_rank() OVER (ORDER BY epoch_us(base_date_time) // 86400000000) - 1 AS u FROM pings0),
passes AS (SELECT hi, row_number() OVER (ORDER BY hi) AS pass FROM (
  SELECT max(us) AS hi FROM units WHERE mmsi <> 0 GROUP BY u // {O6_FILES}, us // {O6_BUFFER_H * 1800000000})),
pings AS (SELECT pass * 1000000000000 + ping_id AS ping_id, pass * 100000000000 + mmsi AS mmsi, base_date_time, latitude, longitude, sog, cog, vessel_type
  FROM units JOIN passes ON us BETWEEN hi - {O6_BUFFER_H * 3600000000} AND hi WHERE mmsi <> 0),
{", ".join(oracle.cte(c) for c in ("cand", "cand_s", "visits", "vpair", "voyages", "lookups", "labeled", "sea", "sea_dist", "features"))},
latest AS (SELECT mmsi % 100000000000 AS mmsi, mmsi // 100000000000 AS pass, max(base_date_time) AS last_prediction_time,
  {", ".join(f"arg_max({c}, (base_date_time, ping_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
             for c in ("remaining_dist_nm", "sog_roll_6h", "origin_port", "destination_port", "latitude", "longitude"))}
  FROM features GROUP BY features.mmsi)
SELECT mmsi, last_prediction_time, round(CASE WHEN sog_roll_6h > 0 THEN greatest(remaining_dist_nm / sog_roll_6h, 0) ELSE 0 END, 6)
  AS predicted_remaining_hours, origin_port, destination_port, latitude, longitude
FROM latest QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY pass DESC) = 1"""


@register("o6_vessel_summary", _O6_SQL)
def o6_vessel_summary(spark, d):
    """O6 via ST1-ST6: the pings replayed as a message stream (S9, daily files,
    10 per micro-batch), scored by the foreachBatch predictor with a 48 h
    buffer, a pass for each 24 h of a batch; returns the vessel registry. The
    scorer is the model-free one, so that SQL can repeat every pass."""
    st = Stages(spark, d)
    base = _scratch(spark, "o6")
    S.write_replay(st.pings, f"{base}/in")
    pred = S.Predictor(spark, st.ports, training.speed_scorer, f"{base}/state", buffer_hours=O6_BUFFER_H, compact_every=2)
    pred.start(S.read_file_stream(spark, f"{base}/in", O6_FILES), f"{base}/checkpoint").awaitTermination()
    return pred.registry().withColumn("predicted_remaining_hours", r6("predicted_remaining_hours"))


ST4_EVERY, ST4_FILES = 300, 2


class _PassLog(S.Predictor):
    """Notes which batches pass, and over how many messages, in place of scoring them."""

    def _passes(self, rows, running, batch_id):
        waiting = [r for r in rows if not r[4]]
        self.log = getattr(self, "log", []) + [(batch_id, len(waiting), sum(r[3] for r in waiting))]


@register("st4_count_trigger", W("pings", f"""
, b AS (SELECT u // {ST4_FILES} AS batch, count(*) FILTER (WHERE mmsi <> 0) AS n FROM (
  SELECT mmsi, dense_rank() OVER (ORDER BY CAST(base_date_time AS DATE)) - 1 AS u FROM pings) GROUP BY 1),
r AS (SELECT batch, n, (n >= {ST4_EVERY}) AS fires, 1 AS waited, n AS total FROM b WHERE batch = 0
  UNION ALL SELECT b.batch, b.n, (CASE WHEN r.fires THEN 0 ELSE r.total END) + b.n >= {ST4_EVERY},
    (CASE WHEN r.fires THEN 0 ELSE r.waited END) + 1, (CASE WHEN r.fires THEN 0 ELSE r.total END) + b.n
  FROM r JOIN b ON b.batch = r.batch + 1)
SELECT CAST(CASE WHEN fires THEN batch ELSE batch + 1 END AS BIGINT) AS batch_id, CAST(waited AS BIGINT) AS n_batches, CAST(total AS BIGINT) AS n_messages
FROM r WHERE fires OR (batch = (SELECT max(batch) FROM b) AND total > 0)""").replace("WITH ", "WITH RECURSIVE ", 1))
def st4_count_trigger(spark, d):
    """ST4: a pass whenever enough messages wait, and one at the end of the stream: its batch, the batches and the messages it takes in."""
    st, base = Stages(spark, d), _scratch(spark, "st4")
    S.write_replay(st.pings, f"{base}/in")
    pred = _PassLog(spark, st.ports, None, f"{base}/state", buffer_hours=O6_BUFFER_H, pass_every=ST4_EVERY)
    pred.start(S.read_file_stream(spark, f"{base}/in", ST4_FILES), f"{base}/checkpoint").awaitTermination()
    pred.flush()
    return spark.createDataFrame(getattr(pred, "log", []), "batch_id long, n_batches long, n_messages long")


@register("st6_registry_deltas", W("pings", """
SELECT mmsi, max(base_date_time) AS last_time, arg_max(latitude, (base_date_time, ping_id)) AS latitude,
  arg_max(longitude, (base_date_time, ping_id)) AS longitude FROM pings GROUP BY mmsi"""))
def st6_registry_deltas(spark, d):
    """ST6: each vessel's last position from passes over three days of pings each: deltas, compactions
    between them, and the last batch twice, as after a failure (its first attempt wrote too little)."""
    p = Stages(spark, d).pings
    reg = Registry(spark, f"{_scratch(spark, 'st6')}/registry", "mmsi long, last_time timestamp_ntz, latitude double, longitude double",
                   compact_every=3)
    unit = F.floor(geo.epoch_us(F.col("base_date_time")) / (3 * 24 * geo.US_PER_HOUR))
    ends = p.agg(F.min(unit).alias("lo"), F.max(unit).alias("hi")).first()
    for batch, u in enumerate(range(ends["lo"], ends["hi"] + 1)):
        last = (p.where(unit == u).groupBy("mmsi").agg(F.max_by(F.struct("base_date_time", "latitude", "longitude"), F.struct("base_date_time", "ping_id")).alias("r"))
                .select("mmsi", F.col("r.base_date_time").alias("last_time"), "r.latitude", "r.longitude"))
        if u == ends["hi"]:
            reg.write(last.limit(1), batch)
        reg.write(last, batch)
    return reg.read()


# ---------------------------------------------------------------- model
_SPLIT_CTE = f"split AS ({_SPLIT_SQL}), test AS (SELECT f.* FROM features f JOIN split USING (voyage_id) WHERE is_test)"
_SCORE_SQL = "CASE WHEN {s} > 0 THEN greatest({d} / {s}, 0) ELSE 0 END"
_ERRORS_SQL = "1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(y))"


def _with(level: str, ctes: str, body: str) -> str:
    return W(level, f", {ctes}\n{body}").replace(f"\n, {ctes}", f",\n{ctes}")


def _split_frames(spark, d) -> tuple[DataFrame, DataFrame]:
    f = Stages(spark, d).features
    return training.split_frames(f, voyage_split(f))


@register("m1_category_index", W("features", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS category, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS INTEGER) AS idx "
    f"FROM features WHERE {c} IS NOT NULL GROUP BY {c}" for c in feat.CATEGORICAL_FEATURES)))
def m1_category_index(spark, d):
    return training.category_index(Stages(spark, d).features_plan)


@register("f16_log_round_trip", W("features", """
SELECT ping_id, round(ln(1 + remaining_travel_hours), 6) AS y_log,
       round(greatest(exp(ln(1 + remaining_travel_hours) - 1) - 1, 0), 6) AS y_back FROM features"""))
def f16_log_round_trip(spark, d):
    """F16 + F10: the target's log, and back from a smaller prediction, clipped at zero."""
    y = F.log1p(F.col(feat.LABEL))
    return feat.remaining_travel(Stages(spark, d).sea_plan).select(
        "ping_id", r6(y).alias("y_log"), r6(geo.clip_at_zero(F.expm1(y - 1))).alias("y_back"))


@register("m4_scorer_metrics", _with("features", _SPLIT_CTE, f"""
SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round({_ERRORS_SQL}, 6) AS r2,
       CAST(count(*) AS BIGINT) AS n_test
FROM (SELECT remaining_travel_hours AS y, {_SCORE_SQL.format(d='remaining_dist_nm', s='sog_roll_6h')} AS p FROM test)"""))
def m4_scorer_metrics(spark, d):
    """M3 + M4 over the model-free scorer."""
    _, test = _split_frames(spark, d)
    m = training.metrics_table(training.speed_scorer(test))
    return m.select(*[r6(c).alias(c) for c in ("mae", "rmse", "r2")], "n_test")


M5_REPEATS = 3


@register("m5_scorer_importance", _with("features", _SPLIT_CTE + f""",
placed AS (SELECT *, row_number() OVER (ORDER BY ping_id) AS place FROM test),
var AS (SELECT t.*, f, r, row_number() OVER (PARTITION BY f, r ORDER BY md5(ping_id || ':' || f || ':' || r), ping_id) AS pp
  FROM test t, (VALUES ('remaining_dist_nm'), ('sog_roll_6h')) x(f), range({M5_REPEATS}) y(r)),
mixed AS (SELECT v.f, v.r, v.remaining_travel_hours AS y,
    CASE WHEN v.f = 'remaining_dist_nm' THEN d.remaining_dist_nm ELSE v.remaining_dist_nm END AS dist,
    CASE WHEN v.f = 'sog_roll_6h' THEN d.sog_roll_6h ELSE v.sog_roll_6h END AS sp
  FROM var v JOIN placed d ON v.pp = d.place),
per AS (SELECT f, r, {_ERRORS_SQL} AS r2 FROM (SELECT *, {_SCORE_SQL.format(d='dist', s='sp')} AS p FROM mixed) GROUP BY f, r),
ref AS (SELECT {_ERRORS_SQL} AS r2 FROM (SELECT remaining_travel_hours AS y, {_SCORE_SQL.format(d='remaining_dist_nm', s='sog_roll_6h')} AS p FROM test))""",
    """SELECT f AS feature, round(avg(ref.r2 - per.r2), 6) AS importance_mean, round(stddev_pop(ref.r2 - per.r2), 6) AS importance_std
FROM per, ref GROUP BY f"""))
def m5_scorer_importance(spark, d):
    """M5 over the model-free scorer and all test rows."""
    _, test = _split_frames(spark, d)
    t = training.permutation_importance(training.speed_scorer, test, ["remaining_dist_nm", "sog_roll_6h"], M5_REPEATS)
    return t.select("feature", r6("importance_mean").alias("importance_mean"), r6("importance_std").alias("importance_std"))


def _trained(spark, d):
    """M3 split + M1/M2 fit on the training voyages. The model is saved under the session's
    shared folder for its input and loaded by the queries after the first (S10); other
    data files, by name, size or time, make another one."""
    st = Stages(spark, d)
    f = st.features
    train_df, test = training.split_frames(f, voyage_split(f))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewater/model-{spark.sparkContext.applicationId}-{_input_mark(spark, d)}"
    if not path_exists(spark, f"{path}/metadata"):
        training.save(training.fit(train_df), path)
    return st, f, test, training.load(path)


def _input_mark(spark, d: str) -> str:
    """A mark of the tables a model depends on."""
    return input_mark(spark, [f"{d}/{t}.parquet" for t in ("events", "nation", "region")])


@register("m2_test_predictions")
def m2_test_predictions(spark, d):
    """M2 + M6 + F16 + F10 on the test voyages."""
    _, _, test, model = _trained(spark, d)
    return training.predict(model, test).select("ping_id", "voyage_id", feat.LABEL, "predicted_remaining_hours")


@register("m4_metrics")
def m4_metrics(spark, d):
    """M4: MAE, RMSE and R^2 on the test voyages, one aggregation pass."""
    return training.metrics_table(m2_test_predictions(spark, d))


@register("m5_permutation_importance")
def m5_permutation_importance(spark, d):
    """M5 over all test rows."""
    _, _, test, model = _trained(spark, d)
    return training.permutation_importance(training.model_scorer(model), test)


@register("st5_predictions")
def st5_predictions(spark, d):
    """ST5 batch form: latest feature row per vessel -> predict -> clip, in
    the vessel-registry shape (O6 columns)."""
    _, f, _, model = _trained(spark, d)
    latest = feat.latest_per_vessel(f, feat.FEATURE_COLUMNS)
    return training.predict(model, latest).select(
        "mmsi", F.col("base_date_time").alias("last_prediction_time"), "predicted_remaining_hours",
        "origin_port", "destination_port", "latitude", "longitude")


# The reference's depth and bins; fewer and larger steps, as SQL repeats every tree.
BOOST = boosting.Params(rounds=8, max_depth=5, step=0.3)
_HOURS_SQL = "round(greatest(exp(pred::DOUBLE / 1000000) - 1, 0), 6)"
_BOOST_CTE = f"split AS ({_SPLIT_SQL}), fr AS (SELECT f.*, f.ping_id AS rid, is_test FROM features f JOIN split USING (voyage_id)),\n" + \
    oracle.boosting("fr", "NOT is_test", feat.LABEL, training.MODEL_NUMERIC, feat.CATEGORICAL_FEATURES, BOOST)


def _boosted(spark, d):
    """(features, test rows, boosted model): fitted once a session and input, saved and loaded."""
    f = Stages(spark, d).features
    train_df, test = training.split_frames(f, voyage_split(f))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewater/boosted-{spark.sparkContext.applicationId}-{_input_mark(spark, d)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        model = boosting.fit(train_df, F.log1p(feat.LABEL), training.MODEL_NUMERIC, feat.CATEGORICAL_FEATURES, BOOST)
        boosting.save(spark, model, path)
    return f, test, boosting.load(spark, path)


@register("m2_boosted_predictions", _with("features", _BOOST_CTE, f"""
SELECT ping_id, voyage_id, round(remaining_travel_hours, 6) AS remaining_travel_hours, {_HOURS_SQL} AS predicted_remaining_hours
FROM fr JOIN boosted USING (rid) WHERE is_test"""))
def m2_boosted_predictions(spark, d):
    """M2 + M6 + F16 + F10: histogram boosting with its own handling of missing values, on the test voyages."""
    _, test, model = _boosted(spark, d)
    return training.boosted_scorer(model)(test).select(
        "ping_id", "voyage_id", r6(feat.LABEL).alias(feat.LABEL), r6("predicted_remaining_hours").alias("predicted_remaining_hours"))


@register("m4_boosted_metrics", _with("features", _BOOST_CTE, f"""
SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round({_ERRORS_SQL}, 6) AS r2,
       CAST(count(*) AS BIGINT) AS n_test
FROM (SELECT remaining_travel_hours AS y, greatest(exp(pred::DOUBLE / 1000000) - 1, 0) AS p FROM fr JOIN boosted USING (rid) WHERE is_test)"""))
def m4_boosted_metrics(spark, d):
    """M4 of the boosted model."""
    _, test, model = _boosted(spark, d)
    m = training.metrics_table(training.boosted_scorer(model)(test))
    return m.select(*[r6(c).alias(c) for c in ("mae", "rmse", "r2")], "n_test")


_LATEST_SQL = f"""SELECT mmsi, max(base_date_time) AS last_prediction_time, {", ".join(
    f"arg_max({c}, (base_date_time, ping_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in [*training.MODEL_NUMERIC, *feat.CATEGORICAL_FEATURES, "latitude", "longitude"])} FROM features GROUP BY mmsi"""


@register("st5_boosted_predictions", _with("features", _BOOST_CTE.replace(
    "fr AS (SELECT f.*, f.ping_id AS rid, is_test FROM features f JOIN split USING (voyage_id))",
    f"latest AS ({_LATEST_SQL}), fr AS (SELECT f.*, f.ping_id AS rid, is_test FROM features f JOIN split USING (voyage_id)"
    " UNION ALL BY NAME SELECT *, -mmsi AS rid, true AS is_test FROM latest)"), f"""
SELECT l.mmsi, l.last_prediction_time, {_HOURS_SQL} AS predicted_remaining_hours, l.origin_port, l.destination_port, l.latitude, l.longitude
FROM latest l JOIN boosted ON rid = -l.mmsi"""))
def st5_boosted_predictions(spark, d):
    """ST5 + M6 with a loaded model: latest feature row per vessel, scored and clipped, in the registry's shape."""
    f, _, model = _boosted(spark, d)
    latest = feat.latest_per_vessel(f, feat.FEATURE_COLUMNS)
    return training.boosted_scorer(model)(latest).select(
        "mmsi", F.col("base_date_time").alias("last_prediction_time"), r6("predicted_remaining_hours").alias("predicted_remaining_hours"),
        "origin_port", "destination_port", "latitude", "longitude")
