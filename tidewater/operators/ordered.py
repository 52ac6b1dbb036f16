"""Skew-safe ordered operations over per-key time series.

A window partitioned by a key alone puts every row of that key into one task.
One key (a vessel id, a bogus transceiver id) may carry a third of all rows,
so ping-level windows here are partitioned by ``(key, time bucket)`` instead.
What a bucket needs from earlier or later buckets (the previous value, the
next value, a running offset) is computed on a per-(key, bucket) summary
table, which has at most one row per key per bucket, and is carried into the
bucket as one extra head/tail row. The only exchange over the big input is
on ``(key, bucket)``. Where no key has more than ``LIGHT_ROWS`` rows (`has_heavy_key`), buckets would
hold a few rows each and as many heads and tails: there a bucket width of None means one window a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import checked_count, write_stage

DAY_US = 86_400_000_000

# Target rows per (key, bucket) partition for adaptive bucket widths.
HOT_BUCKET_ROWS = 2_000_000
# Rows of a key that one window may hold.
LIGHT_ROWS = 500_000
# A hot-key table has at most (rows / HOT_BUCKET_ROWS) entries; it is
# broadcast only below this many rows.
BROADCAST_MAX_HOT_KEYS = 200_000


def bucket_of(t_us: Column, bucket_us) -> Column:
    """Bucket number; ``bucket_us`` is an int, a per-row width Column, or the
    name of a per-row width column."""
    if isinstance(bucket_us, Column):
        w = bucket_us
    elif isinstance(bucket_us, str):
        w = F.col(bucket_us)
    else:
        w = F.lit(bucket_us)
    return F.floor(t_us / w).cast("long")


def _width(bucket_us) -> Column:
    """A fixed width (int) or the name of a per-row width column (str)."""
    return F.col(bucket_us) if isinstance(bucket_us, str) else F.lit(bucket_us)


def _width_aggs(bucket_us) -> list[Column]:
    return [F.first(bucket_us).alias(bucket_us)] if isinstance(bucket_us, str) else []


def hot_key_widths(df: DataFrame, key: str, t_col: str, base_us: int,
                   target_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """Per-key bucket width for keys whose busiest base bucket holds more
    than ``target_rows`` rows: ``base_us / 2^k`` with the smallest k that
    brings that bucket under the target (assuming rows spread over the
    bucket). Two aggregations (map-side combined); one row per hot key only.
    """
    per = df.groupBy(key, bucket_of(F.col(t_col), base_us).alias("_hb")).agg(F.count(F.lit(1)).alias("_n"))
    hot = per.groupBy(key).agg(F.max("_n").alias("_m")).where(F.col("_m") > target_rows)
    k = F.least(F.ceil(F.log2(F.col("_m") / F.lit(float(target_rows)))), F.lit(30)).cast("int")
    return hot.select(key, F.floor(F.lit(base_us) / F.pow(F.lit(2.0), k)).cast("long").alias("_w"))


def has_heavy_key(df: DataFrame, key: str, rows: int = LIGHT_ROWS) -> bool:
    """Whether some key, NULL among them, has more than ``rows`` rows: one aggregation, combined map side."""
    if checked_count(df) <= rows:
        return False
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).isEmpty()


def with_key_width(df: DataFrame, key: str, widths: DataFrame | None, base_us: int) -> DataFrame:
    """Attach ``_w`` (bucket width) to every row: the hot-key width, else
    ``base_us``. The hot-key table is broadcast after a size check."""
    if widths is None:
        return df.withColumn("_w", F.lit(base_us).cast("long"))
    w = F.broadcast(widths) if checked_count(widths) <= BROADCAST_MAX_HOT_KEYS else widths
    return df.join(w, key, "left").withColumn("_w", F.coalesce(F.col("_w"), F.lit(base_us).cast("long")))


def bucketed_lag(df: DataFrame, keys: Sequence[str], t_col: str, bucket_us: int,
                 out_col: str, payload: Column | None = None,
                 order: Sequence[str] = ()) -> DataFrame:
    """Add ``out_col`` = ``payload`` (default: ``t_col``) of the previous row
    of the same key in the order ``(t_col, *order)``; NULL for a key's first
    row. ``t_col`` is a long (epoch microseconds)."""
    keys, order = list(keys), list(order)
    payload = F.col(t_col) if payload is None else payload
    rows = df.withColumn("_b", bucket_of(F.col(t_col), bucket_us)) \
        .withColumn("_k", F.lit(1)).withColumn("_v", payload)
    summary = rows.groupBy(*keys, "_b").agg(
        F.max_by("_v", F.struct(*[F.col(c) for c in [t_col, *order]])).alias("_last"), *_width_aggs(bucket_us))
    wb = Window.partitionBy(*keys).orderBy("_b")
    heads = summary.select(
        *keys, "_b",
        (F.col("_b") * _width(bucket_us) - 1).alias(t_col),
        F.lit(0).alias("_k"),
        F.lag("_last").over(wb).alias("_v"),
    )
    u = rows.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(t_col, "_k", *order)
    return (
        u.withColumn(out_col, F.lag("_v").over(w))
        .where(F.col("_k") == 1)
        .drop("_b", "_k", "_v")
    )


def bucketed_cumsum(df: DataFrame, keys: Sequence[str], t_col: str, bucket_us: int,
                    value: Column | dict, out_col: str | None = None,
                    order: Sequence[str] = ()) -> DataFrame:
    """Running sum per key in the order ``(t_col, *order)``, current row
    included: ``out_col`` = running sum of ``value``, or, with ``value`` a
    dict ``{out_col: Column}``, several running sums in one pass. Earlier
    buckets enter as one head row holding their totals."""
    keys, order = list(keys), list(order)
    values = value if isinstance(value, dict) else {out_col: value}
    tmp = {o: f"_v{i}" for i, o in enumerate(values)}
    rows = df.withColumn("_b", bucket_of(F.col(t_col), bucket_us)).withColumn("_k", F.lit(1))
    for o, c in values.items():
        rows = rows.withColumn(tmp[o], c)
    summary = rows.groupBy(*keys, "_b").agg(*[F.sum(tmp[o]).alias(f"_s{tmp[o]}") for o in values],
                                            *_width_aggs(bucket_us))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = summary.select(
        *keys, "_b",
        (F.col("_b") * _width(bucket_us) - 1).alias(t_col),
        F.lit(0).alias("_k"),
        *[F.sum(f"_s{tmp[o]}").over(wb).alias(tmp[o]) for o in values],
    )
    u = rows.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(t_col, "_k", *order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for o in values:
        u = u.withColumn(o, F.sum(tmp[o]).over(w))
    return u.where(F.col("_k") == 1).drop("_b", "_k", *tmp.values())


def bucketed_next(df: DataFrame, keys: Sequence[str], t_col: str, order: Sequence[str],
                  bucket_us: int | None, payload: Column, out_col: str) -> DataFrame:
    """Add ``out_col`` = ``payload`` of the next row of the same key in the
    total order ``(t_col, *order)``; NULL for the last row of a key."""
    keys = list(keys)
    order = [t_col, *order]
    if bucket_us is None:
        return df.withColumn(out_col, F.lead(payload).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("_b", bucket_of(F.col(t_col), bucket_us)) \
        .withColumn("_k", F.lit(1)).withColumn("_p", payload)
    summary = rows.groupBy(*keys, "_b").agg(
        F.min_by("_p", F.struct(*[F.col(c) for c in order])).alias("_first"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    tails = summary.select(
        *keys, "_b",
        ((F.col("_b") + 1) * bucket_us).alias(t_col),
        F.lit(2).alias("_k"),
        F.lead("_first").over(wb).alias("_p"),
    )
    u = rows.unionByName(tails, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(t_col, "_k", *order[1:])
    return (
        u.withColumn(out_col, F.lead("_p").over(w))
        .where(F.col("_k") == 1)
        .drop("_b", "_k", "_p")
    )


def global_index(df: DataFrame, key: str, t_col: str, order: Sequence[str], bucket_us: int | None,
                 out_col: str) -> DataFrame:
    """0-based row number over the total order ``(key, t_col, *order)``.

    Rows are counted per (key, bucket); a range-partitioned running sum over
    these counts gives each bucket its offset, and ``row_number`` within
    (key, bucket) the rest. No window holds more than one bucket of one key or
    one range of counts, whatever the keys are."""
    rows = df.withColumn("_b", F.lit(0).cast("long") if bucket_us is None else bucket_of(F.col(t_col), bucket_us))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = range_running_sum(counts, [], [key, "_b"], F.col("_n"), "_cum") \
        .select(key, "_b", (F.col("_cum") - F.col("_n")).alias("_off"))
    w = Window.partitionBy(key, "_b").orderBy(t_col, *order)
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .join(offs, [key, "_b"])
        .withColumn(out_col, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_b", "_rn", "_off")
    )


def rolling_range_mean(df: DataFrame, keys: Sequence[str], t_col: str, value: str,
                       windows: dict[str, int], bucket_us) -> DataFrame:
    """Time-range rolling means over (t - w, t] per key, exact, with no
    lower bound on the bucket width (so hot keys can use narrow buckets).

    Every distinct (key, t) enters a window with its sum and count of non-null
    values at t (peers share one value, as in a RANGE frame) and leaves it at
    t + w, before what enters then. The window's sum at t is the running sum of
    what has entered and left, all windows in one pass. Sums are DECIMAL, so
    leaving takes off exactly what entering added. Results are joined back on
    (key, t); without buckets (None) the rows themselves enter, with all their columns."""
    keys = list(keys)
    dec = "decimal(38,12)"
    if bucket_us is None:
        return _rolling_by_key(df, keys, t_col, value, windows, dec)
    wcol = [bucket_us] if isinstance(bucket_us, str) else []
    pts = df.groupBy(*keys, t_col).agg(
        F.coalesce(F.sum(F.col(value).cast(dec)), F.lit(0)).cast(dec).alias("_s"), F.count(value).alias("_c"),
        *[F.first(c).alias(c) for c in wcol])

    def event(at, sign, enters, window):
        return F.struct(at.alias("t"), (F.col("_s") * sign).cast(dec).alias("s"), (F.col("_c") * sign).alias("c"),
                        F.lit(enters).alias("_e"), F.lit(window).alias("w"))
    events = [event(F.col(t_col), 1, 1, -1)] + [event(F.col(t_col) + w, -1, 0, i) for i, w in enumerate(windows.values())]
    e = pts.select(*keys, *wcol, F.explode(F.array(*events)).alias("_x")) \
        .select(*keys, *wcol, F.col("_x.t").alias(t_col), F.col("_x.s").alias("_s"), F.col("_x.c").alias("_c"),
                F.col("_x._e").alias("_e"), F.col("_x.w").alias("_win"))
    sums = {}
    for i in range(len(windows)):
        mine = (F.col("_e") == 1) | (F.col("_win") == i)
        sums[f"_S{i}"] = F.when(mine, F.col("_s")).otherwise(F.lit(0).cast(dec))
        sums[f"_N{i}"] = F.when(mine, F.col("_c")).otherwise(F.lit(0).cast("long"))
    run = bucketed_cumsum(e, keys, t_col, bucket_us, sums, order=["_e"]).where("_e = 1")
    means = [F.when(F.col(f"_N{i}") > 0, (F.col(f"_S{i}") / F.col(f"_N{i}")).cast("double")).alias(name)
             for i, name in enumerate(windows)]
    return df.join(run.select(*keys, t_col, *means), keys + [t_col], "left")


def _rolling_by_key(df: DataFrame, keys: list[str], t_col: str, value: str, windows: dict[str, int], dec: str) -> DataFrame:
    """`rolling_range_mean` in one window a key: a row enters with its columns and leaves each window as a
    narrow row. The RANGE frame shows a row all its peers, and a row with a NULL key or time gets no mean."""
    s, c = F.coalesce(F.col(value).cast(dec), F.lit(0).cast(dec)), F.col(value).isNotNull().cast("long")
    row = F.struct(*[F.col(x) for x in df.columns])

    def event(at, sign, enters, window, row):
        return F.struct(at.alias("t"), (s * sign).cast(dec).alias("s"), (c * sign).alias("c"), F.lit(enters).alias("e"),
                        F.lit(window).alias("w"), row.alias("row"))
    events = [event(F.col(t_col), 1, 1, -1, row)] + [
        event(F.col(t_col) + w, -1, 0, i, F.when(F.lit(False), row)) for i, w in enumerate(windows.values())]
    e = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.array(*events)).alias("_x")).select("*", "_x.*").drop("_x")
    own = [f"_k{i}" for i in range(len(keys))]
    over = Window.partitionBy(*own).orderBy("t", "e").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for i in range(len(windows)):
        mine = (F.col("e") == 1) | (F.col("w") == i)
        e = e.withColumn(f"_S{i}", F.sum(F.when(mine, F.col("s")).otherwise(F.lit(0).cast(dec))).over(over)) \
            .withColumn(f"_N{i}", F.sum(F.when(mine, F.col("c")).otherwise(F.lit(0).cast("long"))).over(over))
    known = F.col("t").isNotNull()
    for k in own:
        known = known & F.col(k).isNotNull()
    means = [F.when(known & (F.col(f"_N{i}") > 0), (F.col(f"_S{i}") / F.col(f"_N{i}")).cast("double")).alias(name)
             for i, name in enumerate(windows)]
    # the key columns stay the partitioned ones, so that windows over more than the key need no exchange
    cols = [F.col(f"_k{keys.index(x)}").alias(x) if x in keys else F.col(f"row.{x}").alias(x) for x in df.columns]
    return e.where("e = 1").select(*cols, *means)


def range_running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: Column, out_col: str) -> DataFrame:
    """Running sum of ``value`` (current row included) per group in the order
    ``order``, for groups of any size.

    Rows are range-partitioned by (groups, order), so a large group is spread
    over many tasks; the sums of a group's earlier partitions come from one
    row per (group, partition). The partitioned rows are written once, since a
    range partition's number must not change between its two uses."""
    groups, order = list(groups), list(order)
    t = df.withColumn("_v", value).repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    t = write_stage(t, "ranges")
    key = groups + ["_part"]
    sums = t.groupBy(*key).agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy()
    before = sums.select(*key, F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("_before"))
    here = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (t.withColumn("_run", F.sum("_v").over(here)).alias("l").join(before.alias("r"), cond)
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_before") + F.col("_run")).alias(out_col)))
