"""Labels and voyages."""

from conftest import at, make_pings

from tidewater.operators import voyages

VISIT_SCHEMA = "mmsi long, portName string, entry_time timestamp_ntz, exit_time timestamp_ntz, duration_hours double"


def visits_df(spark, rows):
    return spark.createDataFrame([(m, p, at(a), at(b), float(b - a)) for m, p, a, b in rows], VISIT_SCHEMA)


def pings_at(spark, mmsi, hours, first_id=0):
    return make_pings(spark, [(first_id + i, mmsi, at(h), 0.0, 0.0, 5.0) for i, h in enumerate(hours)])


def labels(spark, pings, visits, with_voyages=True):
    if with_voyages:
        lab, voy = voyages.build_voyages(pings, visits)
    else:
        lab, voy = voyages.label_pings(pings, visits), None
    return {r.ping_id: r for r in lab.collect()}, voy


def test_label_scenario(spark):
    # NY t0-t2, sea t3-t5, LA t6-t8
    v = visits_df(spark, [(111, "NY", 0, 2), (111, "LA", 6, 8)])
    lab, _ = labels(spark, pings_at(spark, 111, range(9)), v, with_voyages=False)
    assert [lab[i].current_port for i in range(9)] == ["NY"] * 3 + [None] * 3 + ["LA"] * 3
    for i in (3, 4, 5):
        assert lab[i].origin_port == "NY" and lab[i].destination_port == "LA"
    for i in (0, 1, 2, 6, 7, 8):
        assert lab[i].origin_port is None and lab[i].destination_port is None
    assert all(lab[i].voyage_id is None for i in range(9))


def test_voyage_scenario(spark):
    # NY 0-5 h, LA 10-15 h, sea pings at 6..9
    v = visits_df(spark, [(111, "NY", 0, 5), (111, "LA", 10, 15)])
    lab, voy = labels(spark, pings_at(spark, 111, list(range(0, 16))), v)
    rows = voy.collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.voyage_id, r.departure_port, r.arrival_port) == (0, "NY", "LA")
    assert r.departure_time == at(5) and r.arrival_time == at(10) and r.duration_hours == 5.0
    assert r.ping_count == 4
    assert [lab[i].voyage_id for i in range(16)] == [None] * 6 + [0] * 4 + [None] * 6


def test_single_visit_no_voyage(spark):
    v = visits_df(spark, [(111, "NY", 0, 5)])
    _, voy = labels(spark, pings_at(spark, 111, range(8)), v)
    assert voy.count() == 0 and voy.columns == voyages.VOYAGE_COLUMNS


def test_overlapping_visits_skipped(spark):
    v = visits_df(spark, [(111, "A", 0, 5), (111, "B", 3, 8)])
    _, voy = labels(spark, pings_at(spark, 111, range(10)), v)
    assert voy.count() == 0


def test_two_vessels_numbered_in_mmsi_order(spark):
    v = visits_df(spark, [(222, "NY", 0, 1), (222, "LA", 5, 6), (111, "LA", 0, 2), (111, "NY", 10, 12)])
    p = pings_at(spark, 111, [4, 5]).unionByName(pings_at(spark, 222, [3], first_id=10))
    lab, voy = labels(spark, p, v)
    got = sorted((r.voyage_id, r.mmsi, r.ping_count) for r in voy.collect())
    assert got == [(0, 111, 2), (1, 222, 1)]
    assert lab[0].voyage_id == 0 and lab[10].voyage_id == 1


def test_ping_at_departure_or_arrival_is_not_in_voyage(spark):
    v = visits_df(spark, [(1, "A", 0, 2), (1, "B", 5, 6)])
    lab, voy = labels(spark, pings_at(spark, 1, [2, 3, 5]), v)
    assert [lab[i].voyage_id for i in range(3)] == [None, 0, None]
    assert voy.collect()[0].ping_count == 1


def test_long_voyage_crosses_many_buckets(spark):
    # 10-day voyage: origin/destination/voyage reach pings through carry rows
    v = visits_df(spark, [(1, "A", 0, 1), (1, "B", 240, 241)])
    lab, _ = labels(spark, pings_at(spark, 1, [30, 100, 200]), v)
    for i in range(3):
        assert (lab[i].origin_port, lab[i].destination_port, lab[i].voyage_id) == ("A", "B", 0)


def test_older_open_visit_is_not_current(spark):
    # A 0-20 h; B 2-3 h: at t=5 the latest entry is B (closed) -> no current port
    v = visits_df(spark, [(1, "A", 0, 20), (1, "B", 2, 3)])
    lab, _ = labels(spark, pings_at(spark, 1, [5]), v, with_voyages=False)
    assert lab[0].current_port is None
    assert lab[0].origin_port == "B"


def test_tied_entry_backward_takes_last_forward_first(spark):
    v = visits_df(spark, [(1, "A", 10, 12), (1, "B", 10, 14)])
    lab, _ = labels(spark, pings_at(spark, 1, [5, 11]), v, with_voyages=False)
    assert lab[0].destination_port == "A"      # forward: first of (entry, exit, port)
    assert lab[1].current_port == "B"          # backward: last


def test_vessel_without_visits(spark):
    v = visits_df(spark, [(1, "A", 0, 1)])
    lab, _ = labels(spark, pings_at(spark, 2, [5]), v)
    r = lab[0]
    assert (r.current_port, r.origin_port, r.destination_port, r.voyage_id) == (None, None, None, None)


def test_pair_visits_matches_lead(spark):
    v = visits_df(spark, [(1, "A", 0, 1), (1, "B", 30, 31), (1, "C", 100, 101), (1, "D", 100, 102)])
    got = sorted((r.departure_port, r.arrival_port, r.kept) for r in voyages.pair_visits(v).collect())
    assert got == [("A", "B", True), ("B", "C", True), ("C", "D", False)]


def test_hot_key_split_gives_same_labels(spark):
    """A vessel whose busiest day exceeds the bucket target gets narrower
    buckets; labels must not change."""
    v = visits_df(spark, [(1, "A", 0, 2), (1, "B", 30, 33), (1, "C", 50, 51), (2, "A", 0, 1), (2, "B", 5, 6)])
    hours = [0, 1, 2, 3, 10, 20, 25, 29, 30, 31, 33, 34, 40, 49, 50, 51, 60]
    p = pings_at(spark, 1, hours).unionByName(pings_at(spark, 2, [0, 2, 3, 5, 7], first_id=100))
    cols = ["ping_id", "current_port", "origin_port", "destination_port", "voyage_id"]
    voy = voyages.voyages_from_visits(v)
    a = voyages.label_pings(p, v, voy, split_hot_keys=False).select(*cols)
    b = voyages.label_pings(p, v, voy, hot_bucket_rows=2).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    from tidewater.operators.ordered import hot_key_widths
    from tidewater.functions.geo import epoch_us
    from pyspark.sql import functions as F
    w = hot_key_widths(p.withColumn("_t", epoch_us(F.col("base_date_time"))), "mmsi", "_t", 86_400_000_000, 2)
    assert {r.mmsi for r in w.collect()} == {1, 2}
