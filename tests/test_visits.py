"""Port matching and visit detection."""

import random

from conftest import at, hourly, make_pings

from tidewater.operators import portcalls, sessions, spatial


def visits(pings, ports, gap=24.0):
    return sessions.find_port_visits(pings, ports, 10.0, 1.5, gap)


def test_vessel_at_port_is_matched(spark, ports):
    v = visits(make_pings(spark, hourly(111, -74.0, 40.7, 0.5)), ports)
    m = sessions.match(v, 1.0).collect()
    assert [(r.mmsi, r.portName) for r in m] == [(111, "NewYorkPort")]


def test_fast_vessel_is_excluded(spark, ports):
    assert visits(make_pings(spark, hourly(111, -74.0, 40.7, 10.0)), ports).count() == 0


def test_outside_radius_is_excluded(spark, ports):
    assert visits(make_pings(spark, hourly(111, -70.0, 40.7, 0.5)), ports).count() == 0


def test_short_stay_is_excluded(spark, ports):
    v = visits(make_pings(spark, hourly(111, -74.0, 40.7, 0.5)), ports)
    assert sessions.match(v, 5.0).count() == 0


def test_dedup_and_two_ports(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5) + hourly(111, -74.0, 40.7, 0.5, start=100, first_id=10) \
        + hourly(222, -118.2, 33.7, 0.5, first_id=20)
    m = sessions.match(visits(make_pings(spark, rows), ports), 1.0)
    assert sorted((r.mmsi, r.portName) for r in m.collect()) == [(111, "NewYorkPort"), (222, "LosAngelesPort")]


def test_empty_input_keeps_schema(spark, ports):
    v = visits(make_pings(spark, []), ports)
    assert v.columns == sessions.VISIT_COLUMNS and v.count() == 0


def test_entry_exit_duration(spark, ports):
    r = visits(make_pings(spark, hourly(111, -74.0, 40.7, 0.5)), ports).collect()
    assert len(r) == 1 and r[0].entry_time == at(0) and r[0].exit_time == at(2) and r[0].duration_hours == 2.0


def test_single_ping_zero_hours(spark, ports):
    r = visits(make_pings(spark, hourly(111, -74.0, 40.7, 0.5, n_hours=1)), ports).collect()
    assert r[0].duration_hours == 0.0


def test_gap_larger_than_threshold_splits(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5) + hourly(111, -74.0, 40.7, 0.5, start=2 + 48, first_id=10)
    assert visits(make_pings(spark, rows), ports).count() == 2


def test_gap_smaller_than_threshold_merges(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5) + hourly(111, -74.0, 40.7, 0.5, start=2 + 5, first_id=10)
    assert visits(make_pings(spark, rows), ports).count() == 1


def test_gap_of_exactly_threshold_stays_one_visit(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5, n_hours=1) + hourly(111, -74.0, 40.7, 0.5, n_hours=1, start=24, first_id=5)
    assert visits(make_pings(spark, rows), ports).count() == 1
    rows = hourly(111, -74.0, 40.7, 0.5, n_hours=1) + [(9, 111, at(24).replace(second=1), 40.7, -74.0, 0.5)]
    assert visits(make_pings(spark, rows), ports).count() == 2


def test_gap_split_across_many_buckets(spark, ports):
    # pings every 20 h for 10 days: one visit although it spans many 24 h buckets
    rows = [(i, 111, at(20 * i), 40.7, -74.0, 0.5) for i in range(12)]
    r = visits(make_pings(spark, rows), ports).collect()
    assert len(r) == 1 and r[0].duration_hours == 220.0


def test_visits_per_mmsi_and_port(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5) + hourly(222, -74.0, 40.7, 0.5, first_id=10) \
        + hourly(111, -118.2, 33.7, 0.5, start=50, first_id=20)
    assert visits(make_pings(spark, rows), ports).count() == 3


def test_null_sog_and_coordinates_are_not_candidates(spark, ports):
    rows = [(1, 111, at(0), 40.7, -74.0, None), (2, 111, at(1), None, None, 0.5)]
    assert spatial.find_candidates(make_pings(spark, rows), ports).count() == 0


def test_boundary_is_not_within(spark):
    # port at the origin of EPSG:3857; a ping exactly r metres east is outside
    from tidewater.functions.geo import WEB_MERCATOR_R
    import math
    ports = spark.createDataFrame([(1, "P", 0.0, 0.0)], "port_number int, portName string, lat_dd double, lon_dd double")
    lon_at_r = 18520.0 / WEB_MERCATOR_R * 180.0 / math.pi
    rows = [(1, 1, at(0), 0.0, lon_at_r * 1.000001, 0.0), (2, 1, at(1), 0.0, lon_at_r * 0.999, 0.0)]
    ids = [r.ping_id for r in spatial.find_candidates(make_pings(spark, rows), ports).collect()]
    assert ids == [2]


def test_port_call_counts(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5) + hourly(111, -74.0, 40.7, 0.5, start=100, first_id=10) \
        + hourly(222, -74.0, 40.7, 0.5, first_id=20)
    m = sessions.match(visits(make_pings(spark, rows), ports), 1.0)
    c = {r.portName: r.port_call_count for r in sessions.port_call_counts(ports, m).collect()}
    assert c == {"NewYorkPort": 2, "LosAngelesPort": 0}


def test_gap_hours(spark, ports):
    rows = hourly(111, -74.0, 40.7, 0.5, n_hours=2) + hourly(111, -74.0, 40.7, 0.5, n_hours=1, start=30, first_id=5)
    c = spatial.find_candidates(make_pings(spark, rows), ports)
    g = sorted((r.ping_id, r.gap_hours) for r in sessions.gap_hours(c).collect())
    assert g == [(0, None), (1, 1.0), (5, 29.0)]


def test_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    """Above the port-size limit the grid join shuffles on the cell key;
    results must not change."""
    from tidewater.plans.pipeline import Stages
    st = Stages(spark, "/root/testdata/sf0.001")
    a = spatial.find_candidates(st.pings, st.ports).select("ping_id", "portName")
    monkeypatch.setattr(spatial, "BROADCAST_MAX_PORT_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b_df = spatial.find_candidates(st.pings, st.ports.select("*"))
        plan = b_df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        b = b_df.select("ping_id", "portName")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 614
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hours_in_port_hot_key_split_is_identical(spark):
    from tidewater.operators import portcalls
    from tidewater.plans.pipeline import Stages
    st = Stages(spark, "/root/testdata/sf0.001")
    j = portcalls.ports_left_join(st.pings, st.ports)
    cols = ["ping_id", "port_number", "time_diff", "port_group", "hours_in_port"]
    a = portcalls.hours_in_port(j).select(*cols)
    b = portcalls.hours_in_port(j, hot_bucket_rows=1).select(*cols)
    ra = sorted((r.ping_id, r.port_number, r.port_group, round(r.hours_in_port, 9),
                 None if r.time_diff is None else round(r.time_diff, 9)) for r in a.collect())
    rb = sorted((r.ping_id, r.port_number, r.port_group, round(r.hours_in_port, 9),
                 None if r.time_diff is None else round(r.time_diff, 9)) for r in b.collect())
    assert ra == rb and len(ra) > 1000


def test_port_hours_against_plain_windows(spark, ports):
    """W7-W9 in one pass: equal to running values over whole vessels, whatever the bucket width."""
    rng = random.Random(11)
    rows = []
    for m in (1, 2, None):
        h = 0.0
        for _ in range(60):
            h += rng.choice([0, 0.25, 3, 30, 60])  # equal times, and gaps of several buckets
            rows.append((len(rows), m, at(h), *rng.choice([(-74.0, 40.7), (-118.2, 33.7), (0.0, 0.0)]), 0.1))
    joined = portcalls.ports_left_join(make_pings(spark, [(i, m, t, lon, lat, s) for i, m, t, lon, lat, s in rows]), ports)
    want, last = {}, {}
    for r in sorted(joined.collect(), key=lambda r: (r.base_date_time, r.ping_id)):
        ip = int(r.port_number is not None)
        old = last.get(r.mmsi)
        diff = None if old is None else (r.base_date_time - old[0]).total_seconds() / 3600
        if old is None or old[1] != ip:
            run, total = (old[2] if old else 0) + 1, diff or 0.0
        else:
            run, total = old[2], old[3] + diff
        last[r.mmsi] = (r.base_date_time, ip, run, total)
        want[r.ping_id] = (None if diff is None else round(diff, 6), run, round(total if ip else 0.0, 6))
    for kw in ({}, {"bucket_us": 3_600_000_000}, {"hot_bucket_rows": 1}):
        got = {r.ping_id: (None if r.time_diff is None else round(r.time_diff, 6), r.port_group, round(r.hours_in_port, 6))
               for r in portcalls.hours_in_port(joined, **kw).collect()}
        assert got == want, kw
