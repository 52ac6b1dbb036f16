"""DuckDB oracle SQL for every registered query.

The oracle re-derives the fixtures from the raw driver tables and computes
each result with plain SQL (brute-force joins, ordinary windows), so it
shares no code path with the Spark plans. Doubles that come from trig,
division or floating sums are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import math

R6 = 6  # decimals for rounded doubles (both sides)

# Ordered CTE chain; a query includes the chain up to the level it needs.
_CTES: list[tuple[str, str]] = []


def _cte(name: str, body: str) -> None:
    _CTES.append((name, body.strip()))


_cte("ports", """
ports AS (
  SELECT CAST(n_nationkey AS INTEGER) AS port_number, n_name AS portName,
         CAST(25 + (7 * n_nationkey) % 25 AS DOUBLE) AS lat_dd,
         CAST(-124 + 2 * ((11 * n_nationkey) % 25) AS DOUBLE) AS lon_dd,
         CAST((25 + (7 * n_nationkey) % 25) * 3600 AS BIGINT) AS lat_s,
         CAST((124 - 2 * ((11 * n_nationkey) % 25)) * 3600 AS BIGINT) AS lon_s
  FROM nation
  UNION ALL
  SELECT CAST(100 + r_regionkey AS INTEGER), 'ANCHORAGE ' || r_name,
         CAST(25 + (7 * r_regionkey) % 25 AS DOUBLE) + CAST(0.04 AS DOUBLE),
         CAST(-124 + 2 * ((11 * r_regionkey) % 25) AS DOUBLE) + CAST(0.04 AS DOUBLE),
         CAST((25 + (7 * r_regionkey) % 25) * 3600 + 144 AS BIGINT),
         CAST((124 - 2 * ((11 * r_regionkey) % 25)) * 3600 - 144 AS BIGINT)
  FROM region
)""")

_cte("pings", """
pings AS (
  SELECT event_id AS ping_id, user_id AS mmsi, ts AS base_date_time,
    CASE WHEN sea = 1 THEN alat + (blat - alat) * frac
         ELSE alat + CAST((event_id % 7) - 3 AS DOUBLE) * CAST(0.005 AS DOUBLE) END AS latitude,
    CASE WHEN sea = 1 THEN alon + (blon - alon) * frac
         ELSE alon + CAST((event_id % 5) - 2 AS DOUBLE) * CAST(0.005 AS DOUBLE) END AS longitude,
    CASE WHEN sea = 1 THEN CAST(6 AS DOUBLE) + value % CAST(14 AS DOUBLE)
         ELSE (value - floor(value)) * CAST(1.4 AS DOUBLE) END AS sog,
    CAST((event_id * 37) % 360 AS DOUBLE) AS cog,
    CAST(60 + user_id % 25 AS INTEGER) AS vessel_type
  FROM (
    SELECT *, CAST(25 + (7 * a) % 25 AS DOUBLE) AS alat, CAST(-124 + 2 * ((11 * a) % 25) AS DOUBLE) AS alon,
              CAST(25 + (7 * b) % 25 AS DOUBLE) AS blat, CAST(-124 + 2 * ((11 * b) % 25) AS DOUBLE) AS blon
    FROM (
      SELECT *, (3 * leg + user_id) % 25 AS a, (3 * (leg + 1) + user_id) % 25 AS b
      FROM (
        SELECT *, phase // 2 AS leg, phase % 2 AS sea
        FROM (
          SELECT *, h // 36 AS phase, CAST(h % 36 AS DOUBLE) / 36 AS frac
          FROM (SELECT event_id, ts, user_id, value, epoch_us(ts) // 3600000000 + 7 * user_id AS h FROM events)))))
)""")

_cte("cand", """
cand AS (
  SELECT p.*, pt.portName
  FROM pings p JOIN ports pt
    ON p.sog <= CAST(1.5 AS DOUBLE)
   AND (CAST(6378137 AS DOUBLE) * (p.longitude * pi() / 180) - CAST(6378137 AS DOUBLE) * (pt.lon_dd * pi() / 180))
     * (CAST(6378137 AS DOUBLE) * (p.longitude * pi() / 180) - CAST(6378137 AS DOUBLE) * (pt.lon_dd * pi() / 180))
     + (CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + (p.latitude * pi() / 180) / 2))
        - CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + (pt.lat_dd * pi() / 180) / 2)))
     * (CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + (p.latitude * pi() / 180) / 2))
        - CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + (pt.lat_dd * pi() / 180) / 2)))
     < CAST(18520 AS DOUBLE) * CAST(18520 AS DOUBLE)
)""")

_cte("cand_s", """
cand_s AS (
  SELECT *, sum(new_visit) OVER (PARTITION BY mmsi, portName ORDER BY base_date_time
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit_seq
  FROM (
    SELECT *, CASE WHEN prev_ts IS NULL OR epoch_us(base_date_time) - epoch_us(prev_ts) > 86400000000
                   THEN 1 ELSE 0 END AS new_visit
    FROM (SELECT *, lag(base_date_time) OVER (PARTITION BY mmsi, portName ORDER BY base_date_time) AS prev_ts
          FROM cand))
)""")

_cte("visits", """
visits AS (
  SELECT mmsi, portName, min(base_date_time) AS entry_time, max(base_date_time) AS exit_time,
         CAST(epoch_us(max(base_date_time)) - epoch_us(min(base_date_time)) AS DOUBLE)
           / CAST(3600000000 AS DOUBLE) AS duration_hours
  FROM cand_s GROUP BY mmsi, portName, visit_seq
)""")

_cte("vpair", """
vpair AS (
  SELECT mmsi, portName, entry_time, exit_time,
         lead(portName) OVER w AS arr_port, lead(entry_time) OVER w AS arr_time
  FROM visits WINDOW w AS (PARTITION BY mmsi ORDER BY entry_time, exit_time, portName)
)""")

_cte("voyages", """
voyages AS (
  SELECT CAST(row_number() OVER (ORDER BY mmsi, entry_time, exit_time, portName) - 1 AS BIGINT) AS voyage_id,
         mmsi, portName AS departure_port, exit_time AS departure_time,
         arr_port AS arrival_port, arr_time AS arrival_time,
         CAST(epoch_us(arr_time) - epoch_us(exit_time) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS duration_hours
  FROM vpair WHERE arr_time > exit_time
)""")

_cte("lookups", """
cur AS (
  SELECT ping_id, portName AS c_port, exit_time AS c_exit FROM (
    SELECT p.ping_id, v.portName, v.exit_time,
           row_number() OVER (PARTITION BY p.ping_id ORDER BY v.entry_time DESC, v.exit_time DESC, v.portName DESC) AS rn
    FROM pings p JOIN visits v ON v.mmsi = p.mmsi AND v.entry_time <= p.base_date_time) WHERE rn = 1
),
org AS (
  SELECT ping_id, portName AS o_port FROM (
    SELECT p.ping_id, v.portName,
           row_number() OVER (PARTITION BY p.ping_id ORDER BY v.exit_time DESC, v.entry_time DESC, v.portName DESC) AS rn
    FROM pings p JOIN visits v ON v.mmsi = p.mmsi AND v.exit_time <= p.base_date_time) WHERE rn = 1
),
dst AS (
  SELECT ping_id, portName AS d_port FROM (
    SELECT p.ping_id, v.portName,
           row_number() OVER (PARTITION BY p.ping_id ORDER BY v.entry_time, v.exit_time, v.portName) AS rn
    FROM pings p JOIN visits v ON v.mmsi = p.mmsi AND v.entry_time >= p.base_date_time) WHERE rn = 1
),
vst AS (
  SELECT p.ping_id, y.voyage_id
  FROM pings p JOIN voyages y
    ON y.mmsi = p.mmsi AND y.departure_time < p.base_date_time AND p.base_date_time < y.arrival_time
)""")

_cte("labeled", """
labeled AS (
  SELECT p.*, c.current_port,
         CASE WHEN c.current_port IS NULL THEN o.o_port END AS origin_port,
         CASE WHEN c.current_port IS NULL THEN d.d_port END AS destination_port,
         s.voyage_id
  FROM pings p
  LEFT JOIN (SELECT cur.ping_id, CASE WHEN cur.c_exit >= pp.base_date_time THEN cur.c_port END AS current_port
             FROM cur JOIN pings pp USING (ping_id)) c ON c.ping_id = p.ping_id
  LEFT JOIN org o ON o.ping_id = p.ping_id
  LEFT JOIN dst d ON d.ping_id = p.ping_id
  LEFT JOIN vst s ON s.ping_id = p.ping_id
)""")

_cte("voyages_full", """
voyages_full AS (
  SELECT y.*, CAST(coalesce(n, 0) AS BIGINT) AS ping_count
  FROM voyages y LEFT JOIN (SELECT voyage_id, count(*) AS n FROM vst GROUP BY voyage_id) c USING (voyage_id)
)""")

_cte("sea", """
sea AS (
  SELECT l.*, y.arrival_time
  FROM labeled l LEFT JOIN voyages y USING (voyage_id)
  WHERE l.voyage_id IS NOT NULL AND l.destination_port IS NOT NULL
)""")

_cte("sea_dist", """
sea_dist AS (
  SELECT *, CASE WHEN (1 - remaining_dist_nm / nullif(total_dist_nm, 0)) IS NOT NULL
                 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 1 - remaining_dist_nm / nullif(total_dist_nm, 0)))
            END AS fraction_completed
  FROM (
    SELECT s.*,
      2 * CAST(3440.065 AS DOUBLE) * asin(sqrt(least(greatest(
        pow(sin(radians(d.lat_dd - s.latitude) / 2), 2)
        + cos(radians(s.latitude)) * cos(radians(d.lat_dd)) * pow(sin(radians(d.lon_dd - s.longitude) / 2), 2),
        CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)))) AS remaining_dist_nm,
      2 * CAST(3440.065 AS DOUBLE) * asin(sqrt(least(greatest(
        pow(sin(radians(d.lat_dd - o.lat_dd) / 2), 2)
        + cos(radians(o.lat_dd)) * cos(radians(d.lat_dd)) * pow(sin(radians(d.lon_dd - o.lon_dd) / 2), 2),
        CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)))) AS total_dist_nm
    FROM sea s
    LEFT JOIN ports d ON d.portName = s.destination_port
    LEFT JOIN ports o ON o.portName = s.origin_port)
)""")

_cte("features", """
features AS (
  SELECT *, sog - hist_avg_sog AS sog_deviation
  FROM (
    SELECT *,
      avg(sog) OVER (PARTITION BY mmsi ORDER BY epoch_us(base_date_time)
                     RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS sog_roll_6h,
      avg(sog) OVER (PARTITION BY mmsi ORDER BY epoch_us(base_date_time)
                     RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS sog_roll_24h,
      CASE WHEN origin_port IS NOT NULL AND destination_port IS NOT NULL THEN
        coalesce(avg(sog) OVER (PARTITION BY mmsi, origin_port, destination_port),
                 avg(sog) OVER (PARTITION BY origin_port, destination_port)) END AS hist_avg_sog,
      CAST(epoch_us(arrival_time) - epoch_us(base_date_time) AS DOUBLE) / CAST(3600000000 AS DOUBLE)
        AS remaining_travel_hours
    FROM sea_dist)
  WHERE remaining_travel_hours >= 0
)""")

_cte("enriched", """
sea_l AS (
  SELECT *, CAST(epoch_us(arrival_time) - epoch_us(base_date_time) AS DOUBLE) / CAST(3600000000 AS DOUBLE)
              AS remaining_travel_hours,
         round_even(latitude, 0) + CAST(0 AS DOUBLE) AS lat_bin,
         round_even(longitude, 0) + CAST(0 AS DOUBLE) AS lon_bin,
         date_trunc('hour', base_date_time) AS hour
  FROM sea
),
sea_k AS (SELECT * FROM sea_l WHERE remaining_travel_hours >= 0),
cells AS (
  SELECT DISTINCT lat_bin, lon_bin, hour,
         31 * CAST(lat_bin AS BIGINT) + 17 * CAST(lon_bin AS BIGINT) + epoch_us(hour) // 3600000000 AS s,
         13 * CAST(lat_bin AS BIGINT) + 29 * CAST(lon_bin AS BIGINT) + 3 * (epoch_us(hour) // 3600000000) + 5000 AS w
  FROM sea_k
),
marine AS (
  SELECT lat_bin, lon_bin, hour,
    CASE WHEN s % 7 <> 0 THEN CAST(s % 50 AS DOUBLE) / 10 END AS wave_height,
    CASE WHEN s % 7 <> 0 THEN CAST((s * 7) % 360 AS DOUBLE) END AS wave_direction,
    CASE WHEN s % 7 <> 0 THEN CAST(s % 13 AS DOUBLE) + 2 END AS wave_period,
    CASE WHEN s % 7 <> 0 THEN CAST(s % 30 AS DOUBLE) / 10 END AS swell_wave_height,
    CASE WHEN s % 7 <> 0 THEN CAST(s % 20 AS DOUBLE) / 20 END AS ocean_current_velocity,
    CASE WHEN s % 7 <> 0 THEN CAST((s * 11) % 360 AS DOUBLE) END AS ocean_current_direction
  FROM cells WHERE s % 11 <> 3
),
wind AS (
  SELECT lat_bin, lon_bin, hour,
    CAST(w % 25 AS DOUBLE) / 2 AS wind_speed_10m,
    CAST(w % 25 AS DOUBLE) / 2 + CAST(w % 9 AS DOUBLE) AS wind_gusts_10m,
    CAST((w * 13) % 360 AS DOUBLE) AS wind_direction_10m,
    CASE WHEN w % 5 = 0 THEN CAST(w % 11 AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END AS precipitation,
    CAST((w % 4) * 20 AS INTEGER) AS weather_code,
    CASE WHEN w % 7 <> 0 THEN CAST((w % 24) * 1000 AS DOUBLE) END AS visibility
  FROM cells WHERE w % 13 <> 5
),
port_w AS (
  SELECT destination_port, hour,
    CAST(q % 25 AS DOUBLE) / 2 AS port_wind_speed,
    CAST(q % 25 AS DOUBLE) / 2 + CAST(q % 9 AS DOUBLE) AS port_wind_gusts,
    CAST((q * 13) % 360 AS DOUBLE) AS port_wind_direction,
    CASE WHEN q % 5 = 0 THEN CAST(q % 11 AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END AS port_precipitation,
    CAST((q % 4) * 20 AS INTEGER) AS port_weather_code,
    CASE WHEN q % 7 <> 0 THEN CAST((q % 24) * 1000 AS DOUBLE) END AS port_visibility
  FROM (SELECT DISTINCT k.destination_port, k.hour,
               41 * pt.port_number + 5 * (epoch_us(k.hour) // 3600000000) + 7000 AS q
        FROM sea_k k JOIN ports pt ON pt.portName = k.destination_port)
  WHERE q % 17 <> 4
),
enriched0 AS (
  SELECT k.*,
    m.wave_height, m.wave_direction, m.wave_period, m.swell_wave_height, m.ocean_current_velocity,
    m.ocean_current_direction,
    w.wind_speed_10m, w.wind_gusts_10m, w.wind_direction_10m, w.precipitation, w.weather_code, w.visibility,
    pw.port_wind_speed, pw.port_wind_gusts, pw.port_wind_direction, pw.port_precipitation,
    pw.port_weather_code, pw.port_visibility
  FROM sea_k k
  LEFT JOIN marine m USING (lat_bin, lon_bin, hour)
  LEFT JOIN wind w USING (lat_bin, lon_bin, hour)
  LEFT JOIN port_w pw USING (destination_port, hour)
),
enriched AS (
  SELECT *,
    cos(radians(CASE WHEN (cog - wind_direction_10m) % 360 < 0 THEN ((cog - wind_direction_10m) % 360 + 360) % 360
                     ELSE (cog - wind_direction_10m) % 360 END)) * wind_speed_10m AS headwind_component,
    CASE WHEN wave_height <= 0.1 THEN 0 WHEN wave_height <= 0.5 THEN 1 WHEN wave_height <= 1.25 THEN 2
         WHEN wave_height <= 2.5 THEN 3 WHEN wave_height <= 4.0 THEN 4 WHEN wave_height <= 6.0 THEN 5
         WHEN wave_height <= 9.0 THEN 6 WHEN wave_height <= 14.0 THEN 7
         WHEN wave_height IS NOT NULL THEN 8 END AS sea_state,
    CAST(coalesce(wave_height >= 2.0 OR wind_speed_10m >= 10.0, false) AS INTEGER) AS adverse_sea_state,
    CAST(coalesce(port_wind_gusts >= 15.0, false) AS INTEGER) AS port_high_wind,
    CAST(coalesce(port_precipitation > 0, false) AS INTEGER) AS port_precip_flag
  FROM enriched0
)""")

_cte("porthours", """
pj AS (
  SELECT p.*, pt.port_number, pt.portName
  FROM pings p LEFT JOIN ports pt
    ON (p.longitude - pt.lon_dd) * (p.longitude - pt.lon_dd) + (p.latitude - pt.lat_dd) * (p.latitude - pt.lat_dd)
       < CAST(0.075 AS DOUBLE) * CAST(0.075 AS DOUBLE)
),
pj1 AS (
  SELECT *, epoch_us(base_date_time) - epoch_us(lag(base_date_time) OVER w) AS us_diff,
         CAST(epoch_us(base_date_time) - epoch_us(lag(base_date_time) OVER w) AS DOUBLE)
              / CAST(3600000000 AS DOUBLE) AS time_diff,
         CASE WHEN port_number IS NOT NULL THEN 1 ELSE 0 END AS in_port,
         CASE WHEN lag(port_number IS NOT NULL) OVER w IS NULL
                   OR lag(port_number IS NOT NULL) OVER w <> (port_number IS NOT NULL) THEN 1 ELSE 0 END AS chg
  FROM pj WINDOW w AS (PARTITION BY mmsi ORDER BY base_date_time, ping_id, coalesce(port_number, -1))
),
pj2 AS (
  SELECT *, sum(chg) OVER (PARTITION BY mmsi ORDER BY base_date_time, ping_id, coalesce(port_number, -1)
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS port_group
  FROM pj1
),
port_hours AS (
  SELECT *, CASE WHEN in_port = 1 THEN
              CAST(sum(coalesce(us_diff, 0)) OVER (PARTITION BY mmsi, port_group
                   ORDER BY base_date_time, ping_id, coalesce(port_number, -1)
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(3600000000 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS hours_in_port
  FROM pj2
),
pcc AS (SELECT * FROM port_hours WHERE port_number IS NOT NULL AND hours_in_port >= 3)""")

_LEVELS = [n for n, _ in _CTES]


def with_ctes(upto: str, body: str) -> str:
    """SQL with the CTE chain up to and including ``upto``."""
    idx = _LEVELS.index(upto)
    parts = []
    for name, text in _CTES[: idx + 1]:
        if name == "porthours" and upto != "porthours":
            continue
        if name == "enriched" and upto not in ("enriched",):
            continue
        parts.append(text)
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def cte(name: str) -> str:
    """One CTE of the chain, for queries that put another one in its input's place."""
    return _CTES[_LEVELS.index(name)][1]


def boosting(rows: str, train: str, target: str, numeric: list[str], categorical: list[str], p) -> str:
    """CTEs up to ``boosted`` (rid, pred): the trees of ``operators.boosting`` fitted on the rows of
    ``rows`` (rid, features, target) that fulfil ``train`` and applied to all of them; ``p`` are its Params."""
    k = len(numeric)
    lost, cell = f"(f < {k} AND bin = -1)", "PARTITION BY node, f"
    order = f"{cell} ORDER BY CASE WHEN f < {k} THEN bin::DOUBLE ELSE g::DOUBLE / n::DOUBLE END, bin"
    nums = " UNION ALL ".join(f"SELECT rid, {train} AS tr, {i} AS f, round({c}, 6) AS x FROM {rows}" for i, c in enumerate(numeric))
    cats = " UNION ALL ".join(f"SELECT rid, {train} AS tr, {k + i} AS f, {c} AS x FROM {rows}" for i, c in enumerate(categorical))
    parts = [f"""nums AS MATERIALIZED ({nums}), cats AS MATERIALIZED ({cats}),
cum AS (SELECT *, (sum(c) OVER (PARTITION BY f ORDER BY x))::BIGINT AS cum, (sum(c) OVER (PARTITION BY f))::BIGINT AS n
  FROM (SELECT f, x, count(*) AS c FROM nums WHERE tr AND x IS NOT NULL GROUP BY f, x)),
edges AS MATERIALIZED (SELECT f, x FROM cum WHERE (cum * {p.max_bins}) // n > ((cum - c) * {p.max_bins}) // n AND cum < n),
names AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS bin FROM (SELECT DISTINCT f, x FROM cats WHERE tr AND x IS NOT NULL)),
bins AS MATERIALIZED (SELECT rid, a.f, CASE WHEN a.x IS NULL THEN -1 ELSE count(e.x) END AS bin
    FROM nums a LEFT JOIN edges e ON e.f = a.f AND e.x < a.x GROUP BY rid, a.f, a.x
  UNION ALL SELECT rid, a.f, coalesce(bin, -1) FROM cats a LEFT JOIN names USING (f, x)),
ys AS (SELECT rid, {train} AS tr, floor(ln(1 + {target}) * 1000000 + 0.5)::BIGINT AS y FROM {rows}),
s0_0 AS MATERIALIZED (SELECT *, (SELECT floor(sum(y)::DOUBLE / count(*) + 0.5)::BIGINT FROM ys WHERE tr) AS pred, 1 AS node FROM ys)"""]
    for t in range(p.rounds):
        for d in range(p.max_depth):
            st, nx = f"s{t}_{d}", f"s{t}_{d + 1}"
            r, b = f"r{t}_{d}", f"b{t}_{d}"
            parts.append(f"""{r} AS MATERIALIZED (SELECT node, f, bin, all_n, all_g, nm, gm, row_number() OVER ({order}) AS rk,
    sum(n) OVER ({order} ROWS UNBOUNDED PRECEDING) AS cn, sum(g) OVER ({order} ROWS UNBOUNDED PRECEDING) AS cg
  FROM (SELECT *, sum(n) OVER ({cell}) AS all_n, sum(g) OVER ({cell}) AS all_g,
      sum(CASE WHEN {lost} THEN n ELSE 0 END) OVER ({cell}) AS nm, sum(CASE WHEN {lost} THEN g ELSE 0 END) OVER ({cell}) AS gm
    FROM (SELECT node, f, bin, count(*) AS n, sum(y - pred) AS g FROM {st} JOIN bins USING (rid) WHERE tr GROUP BY node, f, bin))
  WHERE NOT {lost}),
{b} AS MATERIALIZED (SELECT node, f, rk, ml, bin FROM (
    SELECT *, gl::DOUBLE * gl::DOUBLE / nl::DOUBLE + (all_g - gl)::DOUBLE * (all_g - gl)::DOUBLE / (all_n - nl)::DOUBLE AS gain FROM (
      SELECT *, cn + CASE WHEN ml THEN nm ELSE 0 END AS nl, cg + CASE WHEN ml THEN gm ELSE 0 END AS gl FROM (
        SELECT *, unnest(CASE WHEN nm > 0 THEN [true, false] ELSE [cn >= all_n - cn] END) AS ml FROM {r}))
    WHERE nl >= {max(p.min_leaf, 1)} AND all_n - nl >= {max(p.min_leaf, 1)})
  WHERE gain > all_g::DOUBLE * all_g::DOUBLE / all_n::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, rk, ml DESC) = 1),
{nx} AS MATERIALIZED (SELECT s.rid, s.tr, s.y, s.pred, CASE WHEN b.node IS NULL THEN s.node WHEN
    CASE WHEN b.f >= {k} THEN coalesce(r.rk <= b.rk, false) WHEN x.bin = -1 THEN b.ml ELSE x.bin <= b.bin END
    THEN 2 * s.node ELSE 2 * s.node + 1 END AS node
  FROM {st} s LEFT JOIN {b} b ON b.node = s.node LEFT JOIN bins x ON x.rid = s.rid AND x.f = b.f
  LEFT JOIN {r} r ON r.node = s.node AND r.f = b.f AND r.bin = x.bin)""")
        st = f"s{t}_{p.max_depth}"
        parts.append(f"""s{t + 1}_0 AS MATERIALIZED (SELECT rid, tr, y, pred + v AS pred, 1 AS node FROM {st} JOIN (
  SELECT node, floor({p.step}::DOUBLE * sum(y - pred)::DOUBLE / count(*)::DOUBLE + 0.5)::BIGINT AS v FROM {st} WHERE tr GROUP BY node) USING (node))""")
    parts.append(f"boosted AS (SELECT rid, pred FROM s{p.rounds}_0)")
    return ",\n".join(parts)


def polygons(points: str, plane: str, radius: float, quarter_segments: int) -> str:
    """CTEs up to ``inside`` (the columns of ``points``, port_number, portName): the points in the ports' buffer
    polygons, each point tested against every edge; ``plane`` is mercator or degrees. To follow a CTE chain."""
    x, y = "{t}.{lon}", "{t}.{lat}"
    if plane == "mercator":
        x = "CAST(6378137 AS DOUBLE) * ({t}.{lon} * pi() / 180)"
        y = "CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + ({t}.{lat} * pi() / 180) / 2))"
    p, q = {"t": "p", "lon": "longitude", "lat": "latitude"}, {"t": "q", "lon": "lon_dd", "lat": "lat_dd"}
    r, turn, n = f"CAST({radius!r} AS DOUBLE)", f"CAST({math.pi / 2 / quarter_segments!r} AS DOUBLE)", 4 * quarter_segments
    return f""", corners AS (
  SELECT port_number, portName, k, {x.format(**q)} + {r} * cos(k * {turn}) AS x, {y.format(**q)} + {r} * sin(k * {turn}) AS y
  FROM ports q, range({n}) ks(k)),
sides AS (SELECT a.port_number, a.portName, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM corners a JOIN corners b ON b.port_number = a.port_number AND b.k = (a.k + 1) % {n}),
spots AS (SELECT *, {x.format(**p)} AS px, {y.format(**p)} AS py FROM {points} p),
inside AS (SELECT s.* EXCLUDE (px, py), e.port_number, e.portName FROM spots s JOIN sides e
    ON (e.y1 > s.py) <> (e.y2 > s.py) AND s.px < (e.x2 - e.x1) * (s.py - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)
"""
