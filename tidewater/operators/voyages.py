"""Ping labels and voyages.

All four per-ping lookups run in one pass: visit and voyage *events* are
unioned with the pings, the union is partitioned by (mmsi, time bucket) and
sorted once by (t, kind, entry, exit, port); each lookup is a
``last``/``first`` with ``ignorenulls`` over that order.

  * current port (J3): last entry event with entry <= ts (kind 0 sorts before
    pings at equal t), kept only when ts <= that visit's exit.
  * origin (J4): last exit event with exit <= ts (kind 0).
  * destination (J5): first entry event with entry >= ts (kind 2 sorts after
    pings at equal t).
  * voyage (J6): last voyage departure strictly before ts (kind 2), kept only
    when ts < arrival. A vessel's voyages never overlap, so this is exact.

Ties between visits resolve by (entry, exit, port): backward lookups take the
last, forward the first. Events from earlier/later buckets reach a bucket as
one head row and one tail row computed from a per-(mmsi, bucket) summary, so
a bucket never needs another bucket's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us
from tidewater.session import checked_count
from tidewater.operators.ordered import (DAY_US, HOT_BUCKET_ROWS, bucket_of, bucketed_next, global_index,
                                         has_heavy_key, hot_key_widths, with_key_width, LIGHT_ROWS)

VOYAGE_COLUMNS = ["voyage_id", "mmsi", "departure_port", "departure_time", "arrival_port",
                  "arrival_time", "duration_hours", "ping_count"]

_ORDER = ["_t", "_kind", "_o1", "_o2", "_o3"]


def _visit_us(visits: DataFrame) -> DataFrame:
    return visits.select("mmsi", "portName", "entry_time", "exit_time",
                         epoch_us(F.col("entry_time")).alias("_e"),
                         epoch_us(F.col("exit_time")).alias("_x"))


def pair_visits(visits: DataFrame, bucket_us: int | None = DAY_US) -> DataFrame:
    """Every visit with the next visit of the same vessel in
    (entry, exit, port) order. Columns: dep_* and arr_* plus ``kept``
    (False when the next visit starts at or before this one's exit)."""
    v = _visit_us(visits)
    nxt = F.struct(F.col("portName").alias("port"), F.col("entry_time").alias("entry_time"),
                   F.col("_e").alias("e"))
    paired = bucketed_next(v, ["mmsi"], "_e", ["_x", "portName"], bucket_us, nxt, "_next")
    return paired.where(F.col("_next").isNotNull()).select(
        "mmsi",
        F.col("portName").alias("departure_port"),
        F.col("entry_time").alias("dep_entry_time"),
        F.col("exit_time").alias("departure_time"),
        F.col("_next.port").alias("arrival_port"),
        F.col("_next.entry_time").alias("arrival_time"),
        F.col("_e").alias("_dep_e"), F.col("_x").alias("_dep_x"), F.col("_next.e").alias("_arr_e"),
        (F.col("_next.e") > F.col("_x")).alias("kept"),
    )


def voyages_from_visits(visits: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """W3 + W10: kept pairs, numbered 0.. by (mmsi, departure visit order).

    Columns: voyage_id, mmsi, departure_port, departure_time, arrival_port,
    arrival_time, duration_hours (no ping_count; see `count_voyage_pings`). Visits
    are cut into buckets where a vessel has very many."""
    if bucket_us is None and has_heavy_key(visits, "mmsi"):
        bucket_us = DAY_US
    kept = pair_visits(visits, bucket_us).where("kept")
    numbered = global_index(kept, "mmsi", "_dep_e", ["_dep_x", "departure_port"], bucket_us,
                            "voyage_id")
    return numbered.select(
        "voyage_id", "mmsi", "departure_port", "departure_time", "arrival_port", "arrival_time",
        ((F.col("_arr_e") - F.col("_dep_x")) / float(US_PER_HOUR)).alias("duration_hours"),
    )


def _label_events(v: DataFrame, voyages: DataFrame | None) -> DataFrame:
    """The visit and voyage events that pings look up (see above)."""
    def ev(t, kind, **payload):
        return v.select(
            "mmsi", t.alias("_t"), F.lit(kind).alias("_kind"),
            F.col("_e").alias("_o1"), F.col("_x").alias("_o2"), F.col("portName").alias("_o3"),
            *[c.alias(n) for n, c in payload.items()],
        )

    cur = F.struct(F.col("portName").alias("port"), F.col("_x").alias("x"))
    events = [
        ev(F.col("_e"), 0, _cur=cur),
        ev(F.col("_x"), 0, _org=F.col("portName")),
        ev(F.col("_e"), 2, _dst=F.col("portName")),
    ]
    if voyages is not None:
        events.append(voyages.select(
            "mmsi",
            epoch_us(F.col("departure_time")).alias("_t"), F.lit(2).alias("_kind"),
            epoch_us(F.col("departure_time")).alias("_o1"),
            epoch_us(F.col("arrival_time")).alias("_o2"),
            F.col("departure_port").alias("_o3"),
            F.struct(F.col("voyage_id").alias("id"),
                     epoch_us(F.col("arrival_time")).alias("arr")).alias("_voy"),
        ))
    ev_all = events[0]
    for e in events[1:]:
        ev_all = ev_all.unionByName(e, allowMissingColumns=True)
    if "_voy" not in ev_all.columns:
        ev_all = ev_all.withColumn("_voy", F.lit(None).cast("struct<id:bigint,arr:bigint>"))
    return ev_all


def _labels(u: DataFrame, columns: list[str]) -> DataFrame:
    """The lookups of the pings (kind 1) among the events of their (mmsi, bucket)."""
    w = Window.partitionBy("mmsi", "_b").orderBy(*_ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows a row, read backwards: a frame to the end of the window is added up anew for every row
    back = Window.partitionBy("mmsi", "_b").orderBy(*[F.col(c).desc() for c in _ORDER]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lab = (
        u.withColumn("_c", F.last("_cur", True).over(upto))
        .withColumn("_og", F.last("_org", True).over(upto))
        .withColumn("_vy", F.last("_voy", True).over(upto))
        .withColumn("_ds", F.last("_dst", True).over(back))
        .where(F.col("_kind") == 1)
    )
    current = F.when(F.col("_c.x") >= F.col("_t"), F.col("_c.port"))
    return (
        lab.withColumn("current_port", current)
        .withColumn("origin_port", F.when(F.col("current_port").isNull(), F.col("_og")))
        .withColumn("destination_port", F.when(F.col("current_port").isNull(), F.col("_ds")))
        .withColumn("voyage_id", F.when(F.col("_t") < F.col("_vy.arr"), F.col("_vy.id")).cast("long"))
        .select(*columns, "current_port", "origin_port", "destination_port", "voyage_id")
    )


def label_pings(pings: DataFrame, visits: DataFrame, voyages: DataFrame | None = None,
                ts: str = "base_date_time", bucket_us: int | None = None,
                split_hot_keys: bool = True, hot_bucket_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """J3 + J4 + J5 (+ J6 when ``voyages`` is given) + P11.

    Adds current_port, origin_port, destination_port (string) and voyage_id
    (long, NULL without ``voyages``) to every ping.

    Where no vessel id has more than ``ordered.LIGHT_ROWS`` pings (nor more than ``hot_bucket_rows``),
    a vessel is one window. Else, or with ``bucket_us`` given, buckets are ``bucket_us`` wide (a day); a vessel id whose busiest bucket holds
    more than ``ordered.HOT_BUCKET_ROWS`` pings (a shared or bogus id) gets
    narrower buckets, so no window partition exceeds that size.
    """
    v = _visit_us(visits)
    p = pings.withColumn("_t", epoch_us(F.col(ts))).withColumn("_kind", F.lit(1))
    if bucket_us is None and split_hot_keys and not has_heavy_key(pings.where("mmsi IS NOT NULL"), "mmsi", min(LIGHT_ROWS, hot_bucket_rows)):
        # pings without a vessel meet no event; they are spread by their time
        p = p.withColumn("_b", F.when(F.col("mmsi").isNull(), F.col("_t")))
        u = p.unionByName(_label_events(v, voyages).where("mmsi IS NOT NULL"), allowMissingColumns=True)
        return _labels(u, pings.columns)
    bucket_us = DAY_US if bucket_us is None else bucket_us
    # A key can only be hot if the whole input exceeds the target (the count
    # of a parquet-backed frame comes from file metadata).
    hot_possible = split_hot_keys and checked_count(pings) > hot_bucket_rows
    widths = hot_key_widths(p, "mmsi", "_t", bucket_us, hot_bucket_rows) if hot_possible else None
    p = with_key_width(p, "mmsi", widths, bucket_us)
    p = p.withColumn("_b", bucket_of(F.col("_t"), F.col("_w")))

    ev_all = _label_events(v, voyages)
    ev_all = with_key_width(ev_all, "mmsi", widths, bucket_us)
    ev_all = ev_all.withColumn("_b", bucket_of(F.col("_t"), F.col("_w")))

    # Per-(mmsi, bucket) summary of events, completed with every ping bucket.
    key = F.struct(*[F.col(c) for c in _ORDER])
    summ = ev_all.groupBy("mmsi", "_b").agg(
        F.max_by("_cur", F.when(F.col("_cur").isNotNull(), key)).alias("_cur_last"),
        F.max_by("_org", F.when(F.col("_org").isNotNull(), key)).alias("_org_last"),
        F.max_by("_voy", F.when(F.col("_voy").isNotNull(), key)).alias("_voy_last"),
        F.min_by("_dst", F.when(F.col("_dst").isNotNull(), key)).alias("_dst_first"),
    )
    ping_buckets = p.groupBy("mmsi", "_b").agg(F.lit(True).alias("_has_pings"), F.first("_w").alias("_w"))
    wb = Window.partitionBy("mmsi").orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    after = wb.rowsBetween(1, Window.unboundedFollowing)
    carry = (
        ping_buckets.join(summ, ["mmsi", "_b"], "full")
        .select(
            "mmsi", "_b", "_has_pings", "_w",
            F.last("_cur_last", True).over(before).alias("_cur"),
            F.last("_org_last", True).over(before).alias("_org"),
            F.last("_voy_last", True).over(before).alias("_voy"),
            F.first("_dst_first", True).over(after).alias("_dst"),
        )
        .where(F.col("_has_pings"))
        .drop("_has_pings")
    )
    heads = carry.select("mmsi", "_b", (F.col("_b") * F.col("_w") - 1).alias("_t"),
                         F.lit(-1).alias("_kind"), "_cur", "_org", "_voy")
    tails = carry.select("mmsi", "_b", ((F.col("_b") + 1) * F.col("_w")).alias("_t"),
                         F.lit(3).alias("_kind"), "_dst")

    # Only events in buckets that hold pings are needed in the main pass.
    ev_in = ev_all.join(ping_buckets.select("mmsi", "_b"), ["mmsi", "_b"], "left_semi").drop("_w")
    u = (p.drop("_w").unionByName(ev_in, allowMissingColumns=True)
         .unionByName(heads, allowMissingColumns=True)
         .unionByName(tails, allowMissingColumns=True))
    return _labels(u, pings.columns)


def count_voyage_pings(voyages: DataFrame, labeled: DataFrame) -> DataFrame:
    """Pings strictly inside each voyage window; voyages without pings get 0."""
    counts = labeled.where(F.col("voyage_id").isNotNull()) \
        .groupBy("voyage_id").agg(F.count(F.lit(1)).alias("_n"))
    return voyages.join(counts, "voyage_id", "left") \
        .withColumn("ping_count", F.coalesce(F.col("_n"), F.lit(0)).cast("long")) \
        .select(*VOYAGE_COLUMNS)


def build_voyages(pings: DataFrame, visits: DataFrame, ts: str = "base_date_time",
                  bucket_us: int = DAY_US) -> tuple[DataFrame, DataFrame]:
    """Labels with voyage ids, and voyages with ping counts."""
    voyages = voyages_from_visits(visits, bucket_us)
    labeled = label_pings(pings, visits, voyages, ts, bucket_us)
    return labeled, count_voyage_pings(voyages, labeled)
