"""Port visits by gap sessionizing.

A visit is a maximal run of candidate pings of one (mmsi, portName) whose
consecutive gaps are at most ``gap_threshold_h``. Bucketing time into
buckets exactly ``gap_threshold_h`` wide means two pings in the same bucket
are always less than the threshold apart, so a visit can only break between
buckets. Visits are therefore found with an aggregation to one row per
(mmsi, port, bucket) (partial aggregation, map-side combine, immune to a hot
key), a window over that small table, and a second aggregation. No window
runs over the pings themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us
from tidewater.operators.ordered import DAY_US, bucketed_lag
from tidewater.operators.spatial import find_candidates

VISIT_COLUMNS = ["mmsi", "portName", "entry_time", "exit_time", "duration_hours"]


def _gap_us(gap_threshold_h: float) -> int:
    return int(round(gap_threshold_h * US_PER_HOUR))


def _bucket_sessions(candidates: DataFrame, gap_threshold_h: float, ts: str) -> DataFrame:
    """One row per (mmsi, portName, bucket) with its visit number."""
    g = _gap_us(gap_threshold_h)
    c = candidates.select("mmsi", "portName", F.col(ts).alias("_ts"))
    per_bucket = c.groupBy("mmsi", "portName", F.floor(epoch_us(F.col("_ts")) / g).alias("_b")).agg(
        F.min("_ts").alias("_ts_lo"), F.max("_ts").alias("_ts_hi"), F.count(F.lit(1)).alias("_n"))
    per_bucket = per_bucket.withColumn("_lo", epoch_us(F.col("_ts_lo"))).withColumn("_hi", epoch_us(F.col("_ts_hi")))
    w = Window.partitionBy("mmsi", "portName").orderBy("_b")
    new_visit = F.coalesce((F.col("_lo") - F.lag("_hi").over(w)) > F.lit(g), F.lit(True))
    return per_bucket.withColumn(
        "visit_seq", F.sum(new_visit.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def visits_from_candidates(candidates: DataFrame, gap_threshold_h: float = 24.0,
                           ts: str = "base_date_time") -> DataFrame:
    """A1: one row per visit: mmsi, portName, entry_time, exit_time, duration_hours."""
    b = _bucket_sessions(candidates, gap_threshold_h, ts)
    return (
        b.groupBy("mmsi", "portName", "visit_seq")
        .agg(F.min("_ts_lo").alias("entry_time"), F.max("_ts_hi").alias("exit_time"),
             F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .select("mmsi", "portName", "entry_time", "exit_time",
                ((F.col("_hi") - F.col("_lo")) / float(US_PER_HOUR)).alias("duration_hours"))
    )


def find_port_visits(pings: DataFrame, ports: DataFrame, radius_nm: float = 10.0,
                     max_speed_knots: float = 1.5, gap_threshold_h: float = 24.0,
                     ts: str = "base_date_time") -> DataFrame:
    """P2 -> J1 -> W2 -> A1. Empty input gives an empty frame with the schema."""
    cand = find_candidates(pings, ports, radius_nm, max_speed_knots)
    return visits_from_candidates(cand, gap_threshold_h, ts)


def label_visit_seq(candidates: DataFrame, gap_threshold_h: float = 24.0,
                    ts: str = "base_date_time") -> DataFrame:
    """W2 per ping: the 1-based visit number of each candidate within its
    (mmsi, portName), joined back from the per-bucket table."""
    g = _gap_us(gap_threshold_h)
    b = _bucket_sessions(candidates, gap_threshold_h, ts).select("mmsi", "portName", "_b", "visit_seq")
    return (
        candidates.withColumn("_b", F.floor(epoch_us(F.col(ts)) / g))
        .join(b, ["mmsi", "portName", "_b"])
        .drop("_b")
    )


def gap_hours(candidates: DataFrame, ts: str = "base_date_time",
              bucket_us: int = DAY_US, order: list[str] | None = None) -> DataFrame:
    """Hours since the previous candidate of the same (mmsi, portName);
    ``order`` breaks ties between equal timestamps."""
    c = candidates.withColumn("_t", epoch_us(F.col(ts)))
    out = bucketed_lag(c, ["mmsi", "portName"], "_t", bucket_us, "_prev", order=order or ())
    return out.withColumn("gap_hours", (F.col("_t") - F.col("_prev")) / float(US_PER_HOUR)) \
        .drop("_t", "_prev")


def min_stay(visits: DataFrame, min_time_in_port: float = 1.0) -> DataFrame:
    """duration_hours >= min_time_in_port (inclusive)."""
    return visits.where(F.col("duration_hours") >= F.lit(float(min_time_in_port)))


def match(visits: DataFrame, min_time_in_port: float = 1.0) -> DataFrame:
    """P3 + A3: distinct (mmsi, portName) pairs with a long enough stay."""
    return min_stay(visits, min_time_in_port).select("mmsi", "portName").distinct()


def port_call_counts(ports: DataFrame, matched: DataFrame) -> DataFrame:
    """A2 + J11: vessels per port of distinct (vessel, port) pairs (`match`), left
    from ports, missing -> 0.

    Pure: returns a new frame, never mutates the port table."""
    counts = matched.groupBy("portName").agg(F.count("mmsi").alias("_c"))
    return ports.join(counts, "portName", "left") \
        .withColumn("port_call_count", F.coalesce(F.col("_c"), F.lit(0)).cast("long")).drop("_c")
