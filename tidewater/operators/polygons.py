"""Point-in-polygon joins (J1, J2 with buffer polygons) as grid-cell equi-joins.

A polygon is one ring. It is cut into square cells: an edge is spread over the rows of
cells it crosses and, in each, over the columns between its ends there, so a long edge
costs its length and not its box. Cells that an edge touches are *boundary* cells; the
cells between two of them in a row are wholly inside or wholly outside, and those inside
are *interior* cells. A point joins the cells it lies in. In an interior cell it matches
without a test; in a boundary cell it is tested by ray casting (a ray to the right)
against the edges of that row of cells that are not left of the cell, which are the
only ones the ray can meet. A polygon is never compared as a whole with a point.

An edge counts where exactly one of its ends is above the ray, so that a ray through a
vertex counts it once. A point on the ring itself is inside or outside by that rule. Points with
NULL or NaN coordinates match nothing; a ring with fewer than three vertices has no inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import DEGREES_PER_NM, METRES_PER_NM, mercator_x, mercator_y
from tidewater.operators.spatial import BROADCAST_MAX_PORT_ROWS
from tidewater.session import checked_count

#: Segments of a quarter circle in a buffer polygon (fixed value: what the reference's buffers have).
QUARTER_SEGMENTS = 16
#: Cells along a buffer's radius: more cells mean fewer points that need the ray, and more rows.
CELLS_PER_RADIUS = 4
# Edges are widened by this share of a cell when their columns are found; a cell too many
# among the boundary cells costs a test and changes nothing.
_SLACK = 1e-6


def buffer_ring(x, y, radius: float, quarter_segments: int = QUARTER_SEGMENTS) -> Column:
    """The buffer of a point as a ring: array of struct(x, y), its vertices on the circle."""
    turn = math.pi / 2 / quarter_segments
    return F.transform(F.sequence(F.lit(0), F.lit(4 * quarter_segments - 1)), lambda k: F.struct(
        (F.col(x) + F.lit(float(radius)) * F.cos(k * F.lit(turn))).alias("x"),
        (F.col(y) + F.lit(float(radius)) * F.sin(k * F.lit(turn))).alias("y")))


def _right_of(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """Whether the ray from (px, py) to the right meets the edge."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def _parity(edges: Column, px: Column, py: Column) -> Column:
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != _right_of(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))


def polygon_cells(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """(key, _cx, _cy, _edges): the cells of every polygon; ``_edges`` is NULL for interior
    cells. ``key`` is unique and not NULL."""
    n = F.size("_r")
    corners = polygons.select(F.col(key), F.col(ring).alias("_r")).where(n >= 3)
    edges = corners.select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get("_r", i)["x"].alias("x1"), F.get("_r", i)["y"].alias("y1"),
        F.get("_r", (i + 1) % n)["x"].alias("x2"), F.get("_r", (i + 1) % n)["y"].alias("y2")))).alias("e"))
    lo_y, hi_y = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    rows = edges.select(key, "e", F.explode(F.sequence(F.floor(lo_y / cell - _SLACK), F.floor(hi_y / cell + _SLACK))).alias("_cy"))

    def x_at(y):  # of the edge where it enters or leaves the row; level edges have both ends there
        y = F.greatest(lo_y, F.least(hi_y, y))
        return F.when(F.col("e.y1") == F.col("e.y2"), F.lit(None)).otherwise(
            F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * (y - F.col("e.y1")) / (F.col("e.y2") - F.col("e.y1")))
    low, high = x_at((F.col("_cy") - _SLACK) * cell), x_at((F.col("_cy") + (1 + _SLACK)) * cell)
    left = F.coalesce(F.least(low, high), F.least("e.x1", "e.x2"))
    right = F.coalesce(F.greatest(low, high), F.greatest("e.x1", "e.x2"))
    spans = rows.select(key, "_cy", "e", F.floor(left / cell - _SLACK).alias("_from"), F.floor(right / cell + _SLACK).alias("_to"))

    touched = spans.select(key, "_cy", F.explode(F.sequence("_from", "_to")).alias("_cx")).distinct()
    in_row = spans.select(key, "_cy", "_to", "e").alias("s")
    # of a row's edges, those that a ray from within the cell (or from the cell right of it) can meet
    boundary = (touched.alias("t").join(in_row, (F.col(f"t.{key}") == F.col(f"s.{key}")) & (F.col("t._cy") == F.col("s._cy"))
                                        & (F.col("s._to") >= F.col("t._cx")))
                .groupBy(f"t.{key}", "t._cy", "t._cx").agg(F.collect_list("s.e").alias("_edges")))
    after = F.lead("_cx").over(Window.partitionBy(key, "_cy").orderBy("_cx"))
    gaps = (boundary.withColumn("_next", after).where(F.col("_next") > F.col("_cx") + 1)
            .where(_parity(F.col("_edges"), (F.col("_cx") + 1.5) * cell, (F.col("_cy") + 0.5) * cell)))
    interior = gaps.select(key, "_cy", F.explode(F.sequence(F.col("_cx") + 1, F.col("_next") - 1)).alias("_cx"),
                           F.lit(None).cast(boundary.schema["_edges"].dataType).alias("_edges"))
    return boundary.select(key, "_cx", "_cy", "_edges").unionByName(interior.select(key, "_cx", "_cy", "_edges"))


def join_polygons(points: DataFrame, polygons: DataFrame, x: Column, y: Column, key: str, cell: float,
                  ring: str = "ring", cols: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """``points`` with ``cols`` of the polygons they lie in, a row a match (``how``: inner or
    left). The cells are broadcast only where their number is at most
    ``BROADCAST_MAX_PORT_ROWS``; beyond, both sides are shuffled by cell."""
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    cells = polygon_cells(polygons, key, ring, cell).join(polygons.select(key, *[c for c in cols if c != key]), key)
    if checked_count(cells) <= BROADCAST_MAX_PORT_ROWS:
        cells = F.broadcast(cells)
    p = points.select("*", x.alias("_x"), y.alias("_y")).select(
        "*", F.floor(F.col("_x") / cell).alias("_cx"), F.floor(F.col("_y") / cell).alias("_cy"))
    p, r = p.alias("l"), cells.alias("r")
    on = ((F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy"))
          & ~F.isnan("l._x") & ~F.isnan("l._y")
          & (F.col("r._edges").isNull() | _parity(F.col("r._edges"), F.col("l._x"), F.col("l._y"))))
    return p.join(r, on, how).select("l.*", *[F.col(f"r.{c}").alias(c) for c in cols]).drop("_x", "_y", "_cx", "_cy")


def find_candidates_in_buffers(pings: DataFrame, ports: DataFrame, radius_nm: float = 10.0, max_speed_knots: float = 1.5,
                               quarter_segments: int = QUARTER_SEGMENTS, key: str = "port_number") -> DataFrame:
    """J1 (+P2) with buffer polygons in EPSG:3857 in place of circles: slow pings within a
    port's polygon, one row per (ping, port)."""
    radius = float(radius_nm) * METRES_PER_NM
    rings = ports.select(key, "portName", mercator_x("lon_dd").alias("_px"), mercator_y("lat_dd").alias("_py")) \
        .select(key, "portName", buffer_ring("_px", "_py", radius, quarter_segments).alias("ring"))
    slow = pings.where(F.col("sog") <= F.lit(float(max_speed_knots)))
    return join_polygons(slow, rings, mercator_x("longitude"), mercator_y("latitude"), key,
                         radius / CELLS_PER_RADIUS, cols=("portName",))


def buffer_left_join(pings: DataFrame, ports: DataFrame, radius_nm: float = 5.0,
                     quarter_segments: int = QUARTER_SEGMENTS) -> DataFrame:
    """J2 with buffer polygons in degrees: every ping, with NULL port columns outside all of them."""
    radius = float(radius_nm) * DEGREES_PER_NM
    rings = ports.select("port_number", "portName", buffer_ring("lon_dd", "lat_dd", radius, quarter_segments).alias("ring"))
    return join_polygons(pings, rings, F.col("longitude"), F.col("latitude"), "port_number",
                         radius / CELLS_PER_RADIUS, cols=("port_number", "portName"), how="left")
