"""Second port-call method.

Degree buffers (5 nm = 0.075 deg), a left spatial join that keeps every
ping, cumulative hours inside each in-port run, and a 3-hour candidate
filter. No window holds more than one (vessel, day) of rows: all running values
come from one pass over the buckets and one summary row of each.

Row order inside a vessel is (ts, ping_id, port_number): a ping inside two
buffers appears twice and its second copy has a 0 h time difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us
from tidewater.operators.ordered import DAY_US, HOT_BUCKET_ROWS, bucket_of, hot_key_widths, with_key_width
from tidewater.session import checked_count
from tidewater.operators.spatial import degree_buffer_left_join

PORT_RADIUS_NM = 5.0
MIN_PORT_DURATION_HOURS = 3.0
_ORDER = ["ping_id", "_pn"]
_NONE = -(1 << 63)  # stands for a missing vessel id or time


def ports_left_join(pings: DataFrame, ports: DataFrame, radius_nm: float = PORT_RADIUS_NM) -> DataFrame:
    """J2."""
    return degree_buffer_left_join(pings, ports, radius_nm)


def hours_in_port(joined: DataFrame, ts: str = "base_date_time", bucket_us: int = DAY_US,
                  hot_bucket_rows: int = HOT_BUCKET_ROWS, n_rows: int | None = None) -> DataFrame:
    """W7 time_diff, W8 port_group (in-port run id), W9 hours_in_port.

    The times within a run add up to the time since the row before it, in whole
    microseconds and divided once, so the hours do not depend on how the rows are
    cut into buckets. ``n_rows`` (the number of
    pings, if known) saves the count that decides whether a vessel id can be
    hot at all; widths change the partitioning only."""
    d = joined.withColumn("_t", epoch_us(F.col(ts))) \
        .withColumn("_pn", F.coalesce(F.col("port_number"), F.lit(-1))) \
        .withColumn("in_port", F.col("port_number").isNotNull().cast("int"))
    n = checked_count(joined) if n_rows is None else n_rows
    widths = hot_key_widths(d, "mmsi", "_t", bucket_us, hot_bucket_rows) if n > hot_bucket_rows else None
    d = with_key_width(d, "mmsi", widths, bucket_us)
    # keys without nulls, so that windows and join share one partitioning
    d = d.withColumn("_m", F.coalesce(F.col("mmsi").cast("long"), F.lit(_NONE))) \
        .withColumn("_b", F.coalesce(bucket_of(F.col("_t"), "_w"), F.lit(_NONE)))
    rows = _within_buckets(d)
    d = rows.join(_bucket_heads(rows), ["_m", "_b"])
    # what the bucket cannot know of itself: whether its first row begins a run, and what came before
    us = F.col("_t") - F.coalesce("_lt", "_before.t")
    start = F.coalesce("_ls", F.when(F.col("_enters"), F.coalesce("_before.t", "_first.t")), F.col("_start"))
    group = F.col("_ln") + F.col("_enters").cast("long") + F.coalesce("_groups", F.lit(0))
    hours = (F.col("_t") - start) / float(US_PER_HOUR)
    return d.withColumn("time_diff", us / float(US_PER_HOUR)).withColumn("port_group", group) \
        .withColumn("hours_in_port", F.when(F.col("in_port") == 1, hours).otherwise(F.lit(0.0))) \
        .drop("_t", "_pn", "_w", "_m", "_b", "_lt", "_ln", "_ls", "_before", "_first", "_enters", "_groups", "_start")


def _within_buckets(d: DataFrame) -> DataFrame:
    """W7-W9 as far as a bucket's own rows tell: the time before (``_lt``), the changes between port and sea so far
    (``_ln``), and where the run began (``_ls``): at the row before its first one. Hours in a run are the time since."""
    w = Window.partitionBy("_m", "_b").orderBy("_t", *_ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.coalesce(F.lag("in_port").over(w) != F.col("in_port"), F.lit(False))
    d = d.withColumn("_lt", F.lag("_t").over(w)).withColumn("_c", change)
    return d.withColumn("_ln", F.sum(F.col("_c").cast("long")).over(so_far)) \
        .withColumn("_ls", F.last(F.when(F.col("_c"), F.col("_lt")), ignorenulls=True).over(so_far)).drop("_c")


def _bucket_heads(rows: DataFrame) -> DataFrame:
    """Per (vessel, bucket): the last row before it, its own first row, whether that begins a run, the
    runs begun before it and where the one that reaches into it began."""
    place, row = F.struct("_t", *_ORDER), F.struct(F.col("_t").alias("t"), F.col("in_port").alias("ip"))
    own = rows.groupBy("_m", "_b").agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"),
                                       F.max("_ln").alias("_n"), F.max_by("_ls", place).alias("_ls"))
    w = Window.partitionBy("_m").orderBy("_b")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_before", F.lag("_last").over(w))
    own = own.withColumn("_enters", F.coalesce(F.col("_before.ip") != F.col("_first.ip"), F.lit(True)))
    reach = F.coalesce("_ls", F.when(F.col("_enters"), F.coalesce("_before.t", "_first.t")))
    return own.withColumn("_reach", reach).select(
        "_m", "_b", "_before", "_first", "_enters",
        F.sum(F.col("_n") + F.col("_enters").cast("long")).over(before).alias("_groups"),
        F.last("_reach", ignorenulls=True).over(before).alias("_start"))


def port_call_candidates(with_hours: DataFrame,
                         min_hours: float = MIN_PORT_DURATION_HOURS) -> DataFrame:
    """In a port and hours_in_port >= 3 (the declared speed limit is not
    applied, as in the reference)."""
    return with_hours.where(F.col("port_number").isNotNull()
                            & (F.col("hours_in_port") >= F.lit(float(min_hours))))


def candidates_per_port(cands: DataFrame) -> DataFrame:
    """record_count per portName."""
    return cands.groupBy("portName").agg(F.count(F.lit(1)).alias("record_count"))


def candidates_per_vessel(cands: DataFrame) -> DataFrame:
    """record_count per mmsi."""
    return cands.groupBy("mmsi").agg(F.count(F.lit(1)).alias("record_count"))
