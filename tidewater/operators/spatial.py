"""Point-in-radius joins (J1, J2) as grid-cell equi-joins.

A ping can only be within radius r of a port whose grid cell (side r) is the
ping's own cell or one of its 8 neighbours. Ports are therefore exploded to
the 3x3 block of cells around them and joined on the cell key; the exact
distance test runs last, as the join condition. There is never a cross join.

The port side is broadcast only after its row count is checked against
``BROADCAST_MAX_PORT_ROWS``; above it the join is a shuffle join on the cell
key and AQE's skew-join splitting takes care of a busy cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.geo import DEGREES_PER_NM, METRES_PER_NM, mercator_x, mercator_y
from tidewater.session import checked_count

# A port list is a dimension table (thousands of rows); 9 cells of about 100
# bytes per port. Beyond this many rows the port side is not broadcast.
BROADCAST_MAX_PORT_ROWS = 200_000


def _offsets():
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in (-1, 0, 1) for dy in (-1, 0, 1)])


def _maybe_broadcast(cells: DataFrame, ports: DataFrame) -> DataFrame:
    n = checked_count(ports) * 9
    return F.broadcast(cells) if n <= BROADCAST_MAX_PORT_ROWS else cells


def _port_cells(ports: DataFrame, px, py, cell: float, keep: list[str]) -> DataFrame:
    base = ports.select(*keep, px.alias("_px"), py.alias("_py"))
    return (
        base.withColumn("_o", F.explode(_offsets()))
        .select(
            *keep, "_px", "_py",
            (F.floor(F.col("_px") / cell) + F.col("_o.dx")).alias("_cx"),
            (F.floor(F.col("_py") / cell) + F.col("_o.dy")).alias("_cy"),
        )
    )


def _grid_join(pings: DataFrame, ports: DataFrame, x, y, px, py, radius: float,
               port_cols: list[str], how: str) -> DataFrame:
    cells = _maybe_broadcast(_port_cells(ports, px, py, radius, port_cols), ports)
    p = pings.withColumn("_x", x).withColumn("_y", y) \
        .withColumn("_cx", F.floor(F.col("_x") / radius)) \
        .withColumn("_cy", F.floor(F.col("_y") / radius))
    l, r = p.alias("l"), cells.alias("r")
    dx = F.col("l._x") - F.col("r._px")
    dy = F.col("l._y") - F.col("r._py")
    cond = (
        (F.col("l._cx") == F.col("r._cx"))
        & (F.col("l._cy") == F.col("r._cy"))
        & (dx * dx + dy * dy < F.lit(radius * radius))   # boundary is not "within"
    )
    out = l.join(r, cond, how)
    return out.select("l.*", *[F.col(f"r.{c}") for c in port_cols]).drop("_x", "_y", "_cx", "_cy")


def find_candidates(pings: DataFrame, ports: DataFrame, radius_nm: float = 10.0,
                    max_speed_knots: float = 1.5, lat_col: str = "latitude",
                    lon_col: str = "longitude") -> DataFrame:
    """J1 (+P2): slow pings inside a port buffer, one row per (ping, port).

    Distance is planar in EPSG:3857 metres; radius = nm * 1852. The speed
    filter is a plain predicate, pushed into the parquet scan by Catalyst.
    """
    slow = pings.where(F.col("sog") <= F.lit(float(max_speed_knots)))
    return _grid_join(
        slow, ports,
        mercator_x(F.col(lon_col)), mercator_y(F.col(lat_col)),
        mercator_x(F.col("lon_dd")), mercator_y(F.col("lat_dd")),
        float(radius_nm) * METRES_PER_NM, ["portName"], "inner",
    )


def degree_buffer_left_join(pings: DataFrame, ports: DataFrame, radius_nm: float = 5.0,
                            lat_col: str = "latitude", lon_col: str = "longitude",
                            port_cols: tuple[str, ...] = ("port_number", "portName")) -> DataFrame:
    """Left spatial join with planar degree buffers (radius nm * 0.015).

    Pings outside every buffer stay with NULL port columns; a ping inside two
    buffers gives two rows; a ping with NULL coordinates stays unmatched.
    The broadcast hash join evaluates the distance test as its join condition,
    so the left join needs no second pass over the pings.
    """
    return _grid_join(
        pings, ports,
        F.col(lon_col), F.col(lat_col), F.col("lon_dd"), F.col("lat_dd"),
        float(radius_nm) * DEGREES_PER_NM, list(port_cols), "left",
    )
