"""Point-in-polygon joins against every edge, and weather read back from its stores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, make_pings
from tidewater.operators import polygons, spatial, weather

RINGS = {
    1: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)],                      # corners on cell borders
    2: [(2.3, 2.1), (17.4, 3.3), (9.1, 6.2), (15.2, 14.8), (3.9, 12.7), (6.6, 7.0)],  # concave
    3: [(-7.7, -3.1), (-1.2, -9.4), (31.5, 22.2)],                                # long thin edges
    4: [(5.0, 5.0), (6.0, 6.0)],                                                  # no inside
    5: [(4.1, 4.2), (4.3, 4.2), (4.2, 4.4)],                                      # smaller than a cell
}
RING = "array<struct<x:double,y:double>>"


def brute(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd and len(ring) >= 3


@pytest.mark.parametrize("cell", [0.37, 1.0, 2.5, 50.0])
@pytest.mark.parametrize("limit", [0, 10**9])  # cells shuffled, cells broadcast
def test_points_in_rings_against_every_edge(spark, monkeypatch, cell, limit):
    monkeypatch.setattr(polygons, "BROADCAST_MAX_PORT_ROWS", limit)
    rng = random.Random(5)
    pts = [(rng.uniform(-10, 34), rng.uniform(-11, 24)) for _ in range(1500)]
    pts += [(float(a), float(b)) for a in range(-2, 12) for b in range(-2, 12)]   # on borders and corners
    pts += [(x, y + d) for r in RINGS.values() for x, y in r for d in (-1e-9, 0.0, 1e-9)]
    rows = [(i, x, y) for i, (x, y) in enumerate(pts)] + [(-1, None, 1.0), (-2, 5.0, float("nan"))]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    shapes = spark.createDataFrame([(k, f"p{k}", r) for k, r in RINGS.items()], f"n int, name string, ring {RING}")
    got = polygons.join_polygons(points, shapes, F.col("x"), F.col("y"), "n", cell, cols=("n", "name"), how="left")
    found = sorted((r["id"], r["n"]) for r in got.collect() if r["n"] is not None)
    assert found == sorted((i, k) for i, (x, y) in enumerate(pts) for k, r in RINGS.items() if brute(x, y, r))
    assert {r["id"] for r in got.select("id").distinct().collect()} == {r[0] for r in rows}
    assert got.columns == ["id", "x", "y", "n", "name"]


def test_interior_cells_need_no_test(spark):
    shapes = spark.createDataFrame([(1, RINGS[1])], f"n int, ring {RING}")
    cells = {(r["_cx"], r["_cy"]): r["_edges"] for r in polygons.polygon_cells(shapes, "n", "ring", 1.0).collect()}
    assert all(cells[(x, y)] is None for x in range(1, 9) for y in range(1, 9))
    # no cell carries the whole ring, and none lies beyond the cells its edges touch
    assert all(e is None or len(e) < 4 for c, e in cells.items() if 1 < c[1] < 8)
    assert min(cells)[0] >= -1 and max(cells)[0] <= 10


def test_ping_between_polygon_and_circle(spark, ports):
    r = 10 * 1852.0
    x0, y0 = 6378137.0 * math.radians(-74.0), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(40.7) / 2))

    def spot(share, angle):
        x, y = x0 + share * r * math.cos(angle), y0 + share * r * math.sin(angle)
        return math.degrees(x / 6378137.0), math.degrees(2 * math.atan(math.exp(y / 6378137.0)) - math.pi / 2)
    mid = math.pi / 64  # half way between two vertices of 64
    places = [spot(0.9995, mid), spot(0.9995, 0.0), spot(0.99, mid), spot(1.0005, 0.0), (None, None)]
    pings = make_pings(spark, [(i, 7, at(i), lon, lat, 1.0) for i, (lon, lat) in enumerate(places)])
    pings = pings.select("ping_id", "mmsi", "base_date_time", F.col("latitude").alias("longitude"), F.col("longitude").alias("latitude"), "sog") \
        if pings.columns.index("latitude") < pings.columns.index("longitude") else pings
    ids = lambda df: sorted(x["ping_id"] for x in df.collect())
    assert ids(spatial.find_candidates(pings, ports)) == [0, 1, 2]
    assert ids(polygons.find_candidates_in_buffers(pings, ports)) == [1, 2]
    assert ids(polygons.find_candidates_in_buffers(pings.limit(0), ports)) == []
    assert ids(polygons.find_candidates_in_buffers(pings, ports.limit(0))) == []
    left = polygons.buffer_left_join(pings, ports)
    assert ids(left) == [0, 1, 2, 3, 4]


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_weather_is_not_shuffled(spark, tmp_path):
    hours = [(float(i % 7), float(i % 5), at(i % 50), float(i)) for i in range(350)]
    wind = spark.createDataFrame(hours, "lat_bin double, lon_bin double, hour timestamp_ntz, wind_speed_10m double") \
        .dropDuplicates(weather.CELL)
    weather.store_cell_weather(wind, "wind_here", str(tmp_path / "w"), 4)
    spark.sql("DROP TABLE wind_here")  # its files stay; another session takes them over
    stored = weather.open_cell_weather(spark, "wind_here", str(tmp_path / "w"), 4)
    cells = [h[:3] for h in hours] + [(99.0, 0.0, at(0)), (float("nan"), 0.0, at(0)), (None, 0.0, at(0))]
    keyed = spark.createDataFrame(cells, "lat_bin double, lon_bin double, hour timestamp_ntz")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a table too large for it
    try:
        joined = weather.join_stored_cell_weather(keyed, stored)
        plan = _executed(joined)
        assert plan.count("Exchange") == 1  # of the pings
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
        assert sorted(map(tuple, joined.na.drop().distinct().collect())) == sorted(map(tuple, wind.collect()))
        assert joined.count() == len(cells) and joined.where("wind_speed_10m is null").count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE wind_here")


def test_port_weather_reads_the_folders_of_bound_ports(spark, tmp_path):
    names = ["NEW YORK", "A/B", "LOS ANGELES", "NEW_YORK"]  # two share a path-safe key
    port = spark.createDataFrame([(n, at(h), float(10 * i + h)) for i, n in enumerate(names) for h in range(5)],
                                 "destination_port string, hour timestamp_ntz, port_wind_speed double")
    weather.store_port_weather(port, str(tmp_path / "p"))
    bound = spark.createDataFrame([(1, "NEW YORK", at(2)), (2, "A/B", at(9)), (3, None, at(1)), (4, "", at(1))],
                                  "ping_id long, destination_port string, hour timestamp_ntz")
    stored = weather.stored_port_weather(bound, str(tmp_path / "p"))
    assert "dynamicpruning" in _executed(stored)
    assert {r[0] for r in stored.select("destination_port").distinct().collect()} == {"NEW YORK", "NEW_YORK", "A/B"}
    got = {r["ping_id"]: r["port_wind_speed"] for r in weather.join_port_weather(bound, stored).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None}
