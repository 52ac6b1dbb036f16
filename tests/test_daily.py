"""Day-by-day visits and voyages (S4 + S2) against a full rebuild."""

import datetime
import os
import random
import tempfile

from conftest import at, make_pings
from pyspark.sql import functions as F

from tidewater.operators import sessions, voyages
from tidewater.plans.daily import DailyVisits

NY, LA = (-74.0, 40.7), (-118.2, 33.7)


def pings_of(spark, rows):
    return make_pings(spark, [(i, m, at(h), *(where or (-90.0, 10.0)), 0.5) for i, (m, h, where) in enumerate(rows)])


def day(n):
    return datetime.date(2025, 1, 1) + datetime.timedelta(days=n)


def got(d):
    return (sorted(tuple(r) for r in d.visits().select("mmsi", "portName", "entry_time", "exit_time", "duration_hours").collect()),
            sorted(tuple(r) for r in d.voyages().collect()))


def want(pings, ports):
    v = sessions.find_port_visits(pings, ports)
    w = voyages.voyages_from_visits(v).drop("voyage_id")
    return (sorted(tuple(r) for r in v.select("mmsi", "portName", "entry_time", "exit_time", "duration_hours").collect()),
            sorted(tuple(r) for r in w.select("mmsi", "departure_port", "departure_time", "arrival_port", "arrival_time", "duration_hours").collect()))


def random_rows(seed):
    """Stays over midnight, gaps around a day, two ports whose buffers overlap (tied entries)."""
    rng, rows = random.Random(seed), []
    for m in range(1, 7):
        h = rng.random() * 10
        while h < 24 * 7:
            where = rng.choice([NY, LA, NY, None])
            for _ in range(rng.randrange(1, 6)):
                rows.append((m, h, where))
                h += rng.choice([0.5, 6, 20, 23.9, 24.0, 24.1, 30])
    return sorted(rows, key=lambda r: r[1])


def test_days_one_by_one_equal_a_rebuild(spark, ports):
    twin = spark.createDataFrame([(3, "Anchorage", 40.72, -74.01)], ports.schema)
    ports = ports.unionByName(twin)
    rows = random_rows(5)
    pings = pings_of(spark, rows)
    d = DailyVisits(spark, tempfile.mkdtemp(prefix="tw-daily-"), pings, ports)
    for n in (1, 2, 4, 5, 9):
        d.advance(day(n))
        assert got(d) == want(pings.where(F.col("base_date_time") < F.lit(at(24 * n))), ports), n
    assert d.days() == [day(n).isoformat() for n in (1, 2, 4, 5, 9)]


def files(root):
    return {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for p, _, names in os.walk(root) for f in names}


def test_a_new_day_touches_itself_alone_and_a_repeated_one_what_follows(spark, ports):
    rows = [(1, h, NY) for h in range(0, 30)] + [(1, h, LA) for h in range(60, 70)] + [(2, h, NY) for h in range(5, 90, 5)]
    pings = pings_of(spark, rows)
    root = tempfile.mkdtemp(prefix="tw-daily-")
    source = tempfile.mkdtemp(prefix="tw-dated-") + "/p"
    dated = pings.withColumn("date", F.to_date("base_date_time"))
    dated.where(F.col("base_date_time") < F.lit(at(72))).write.partitionBy("date").parquet(source)

    def read():
        return spark.read.parquet(source)
    d = DailyVisits(spark, root, read(), ports)
    for n in (1, 2, 3):
        d.advance(day(n))
    before = files(root)
    dated.where(F.col("base_date_time") >= F.lit(at(72))).write.mode("append").partitionBy("date").parquet(source)
    d = DailyVisits(spark, root, read(), ports)
    d.advance(day(4))
    after = files(root)
    assert {p: t for p, t in after.items() if f"until={day(4)}" not in p} == before
    plan = d._between(day(3).isoformat(), day(4).isoformat())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and str(day(3)) in plan
    assert got(d) == want(pings, ports)
    # a day that is delivered again, with other pings
    more = pings_of(spark, [(9, h, LA) for h in (25, 26, 27)]).withColumn("date", F.to_date("base_date_time"))
    more.write.mode("append").partitionBy("date").parquet(source)
    d = DailyVisits(spark, root, read(), ports)
    first = {p: t for p, t in files(root).items() if f"until={day(1)}" in p}
    d.redo(day(1))
    assert {p: t for p, t in files(root).items() if f"until={day(1)}" in p} == first
    assert got(d) == want(pings.unionByName(more.drop("date")), ports)


def test_no_days_and_empty_days(spark, ports):
    d = DailyVisits(spark, tempfile.mkdtemp(prefix="tw-daily-"), pings_of(spark, [(1, 1.0, NY)]).limit(0), ports)
    assert got(d) == ([], [])
    d.advance(day(1))
    d.advance(day(2))
    assert got(d) == ([], []) and len(d.days()) == 2
