"""A2 from stored sketches: distinct vessels per port over any range of days.

One HyperLogLog sketch per (port, day) is kept, merged map side while it is built. The
distinct vessels of a range of days are estimated from the union of its sketches: a range
costs days x ports rows, whatever the pings. With 2^``LG_K`` registers the relative
standard error is about 1.04 / 2^(LG_K / 2); `tolerance` is four of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def port_day_sketches(candidates: DataFrame, ts: str = "base_date_time") -> DataFrame:
    """(day, portName, sketch) of the vessels with a slow ping at a port (`spatial.find_candidates`).
    Days are added by writing them to a table partitioned by ``day``."""
    return candidates.groupBy(F.to_date(ts).alias("day"), "portName").agg(F.hll_sketch_agg("mmsi", F.lit(LG_K)).alias("sketch"))


def vessels_between(sketches: DataFrame, first: Column, last: Column) -> DataFrame:
    """(portName, vessels): the estimated distinct vessels of the days ``first`` to ``last``, both included."""
    return (sketches.where(F.col("day").between(first, last)).groupBy("portName")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("vessels")))


def tolerance(exact: Column) -> Column:
    """How far an estimate may lie from the exact count: four standard errors, and one for rounding."""
    return exact * F.lit(4 * 1.04 / 2 ** (LG_K / 2)) + F.lit(1.0)
