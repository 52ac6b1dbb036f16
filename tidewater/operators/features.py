"""Training features and label.

Per-vessel windows go through the bucketed helpers in `ordered`; lane means
are aggregations joined back (partial aggregation handles a hot lane; the
join back is an equi-join that AQE either broadcasts when the aggregate is
small or splits with skew-join when a key is hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us, fraction_completed, haversine_nm
from tidewater.operators.ordered import DAY_US, rolling_range_mean, with_key_width
from tidewater.operators.spatial import BROADCAST_MAX_PORT_ROWS
from tidewater.session import checked_count, write_stage

ROLLING_WINDOWS_H = {"sog_roll_6h": 6, "sog_roll_24h": 24}

# The columns of the training table.
FEATURE_COLUMNS = [
    "mmsi", "base_date_time", "latitude", "longitude", "sog",
    "origin_port", "destination_port", "voyage_id",
    "remaining_dist_nm", "total_dist_nm", "fraction_completed",
    "sog_roll_6h", "sog_roll_24h",
    "hist_avg_sog", "sog_deviation",
    "remaining_travel_hours",
]
CATEGORICAL_FEATURES = ["origin_port", "destination_port"]
LABEL = "remaining_travel_hours"


def sea_pings(labeled: DataFrame) -> DataFrame:
    """Pings inside a voyage with a known destination."""
    return labeled.where(F.col("voyage_id").isNotNull() & F.col("destination_port").isNotNull())


def attach_arrival(sea: DataFrame, voyages: DataFrame) -> DataFrame:
    """Left join of the voyage's arrival_time on voyage_id."""
    return sea.join(voyages.select("voyage_id", "arrival_time"), "voyage_id", "left")


def _port_loc(ports: DataFrame, prefix: str) -> DataFrame:
    loc = ports.select(F.col("portName").alias(f"{prefix}_port"),
                       F.col("lat_dd").alias(f"{prefix}_lat"), F.col("lon_dd").alias(f"{prefix}_lon"))
    return F.broadcast(loc) if checked_count(ports) <= BROADCAST_MAX_PORT_ROWS else loc


def port_coordinates(df: DataFrame, ports: DataFrame) -> DataFrame:
    """Destination and origin coordinates, two left lookups.

    A duplicated portName would multiply rows, as in the reference; the port
    loaders keep portName unique."""
    dest = _port_loc(ports, "destination").withColumnsRenamed(
        {"destination_lat": "dest_lat", "destination_lon": "dest_lon"})
    org = _port_loc(ports, "origin")
    return df.join(dest, "destination_port", "left").join(org, "origin_port", "left")


def distance_features(df: DataFrame, ports: DataFrame) -> DataFrame:
    """J7 + F2 + F9: remaining_dist_nm, total_dist_nm, fraction_completed."""
    d = port_coordinates(df, ports)
    d = d.withColumn("remaining_dist_nm", haversine_nm("latitude", "longitude", "dest_lat", "dest_lon")) \
        .withColumn("total_dist_nm", haversine_nm("origin_lat", "origin_lon", "dest_lat", "dest_lon"))
    d = d.withColumn("fraction_completed", fraction_completed("remaining_dist_nm", "total_dist_nm"))
    return d.drop("dest_lat", "dest_lon", "origin_lat", "origin_lon")


def rolling_sog(df: DataFrame, ts: str = "base_date_time", bucket_us: int | None = DAY_US,
                widths: DataFrame | None = None) -> DataFrame:
    """Mean sog over (t - 6 h, t] and (t - 24 h, t] per vessel.

    Equal-timestamp pings are peers and see each other (RANGE frame). Means
    are running sums of what enters and leaves the window (`rolling_range_mean`),
    exact, so they are linear in a vessel's rows and do not depend on how these
    are cut into buckets. ``widths`` (`hot_key_widths`) gives hot vessel ids
    narrower buckets; without buckets (None) no vessel may have more than ``ordered.LIGHT_ROWS`` rows."""
    if bucket_us is None:
        wins = {k: h * US_PER_HOUR for k, h in ROLLING_WINDOWS_H.items()}
        return rolling_range_mean(df.withColumn("_t", epoch_us(F.col(ts))), ["mmsi"], "_t", "sog", wins, None).drop("_t")
    t = with_key_width(df.withColumn("_t", epoch_us(F.col(ts))), "mmsi", widths, bucket_us)
    wins = {k: h * US_PER_HOUR for k, h in ROLLING_WINDOWS_H.items()}
    return rolling_range_mean(t, ["mmsi"], "_t", "sog", wins, "_w").drop("_t", "_w")


def sog_deviation(df: DataFrame, sea: DataFrame | None = None, by_key: bool = False) -> DataFrame:
    """hist_avg_sog = vessel-lane mean, else lane mean; deviation = sog - hist.

    Rows with a NULL lane key get NULL (pandas drops NaN group keys). ``sea`` is a stage table with the
    speeds and lanes of ``df``, from which the means are taken without what ``df`` adds to them. With
    ``by_key`` the vessel-lane mean is a window over ``df``, in place where that is partitioned by vessel."""
    lane = ["origin_port", "destination_port"]
    source = df if sea is None else sea
    ln = source.groupBy(*lane).agg(F.avg("sog").alias("_ln"))
    if sea is not None:
        ln = write_stage(ln, "lanes")
        ln = F.broadcast(ln) if checked_count(ln) <= BROADCAST_MAX_PORT_ROWS else ln
    keys_ok = F.col("origin_port").isNotNull() & F.col("destination_port").isNotNull()
    if by_key:
        mean = F.avg("sog").over(Window.partitionBy("mmsi", *lane))
        out = df.withColumn("_vl", F.when(F.col("mmsi").isNotNull(), mean)).join(ln, lane, "left")
    else:
        vl = source.groupBy("mmsi", *lane).agg(F.avg("sog").alias("_vl"))
        out = df.join(vl, ["mmsi", *lane], "left").join(ln, lane, "left")
    hist = F.when(keys_ok, F.coalesce(F.col("_vl"), F.col("_ln")))
    return out.withColumn("hist_avg_sog", hist) \
        .withColumn("sog_deviation", F.col("sog") - F.col("hist_avg_sog")).drop("_vl", "_ln")


def remaining_travel(df: DataFrame, ts: str = "base_date_time") -> DataFrame:
    """F5 + P5: remaining_travel_hours = arrival - ts; negative rows dropped."""
    h = (epoch_us(F.col("arrival_time")) - epoch_us(F.col(ts))) / float(US_PER_HOUR)
    return df.withColumn(LABEL, h).where(F.col(LABEL) >= 0)


def build_features(sea: DataFrame, ports: DataFrame, voyages: DataFrame | None = None,
                   widths: DataFrame | None = None, staged: bool = False, by_key: bool = False) -> DataFrame:
    """Distance, rolling, lane features and the label on sea pings.

    ``sea`` must carry ``arrival_time`` unless ``voyages`` is given (J8). ``staged``: it is a stage table;
    ``by_key``: no vessel has more than ``ordered.LIGHT_ROWS`` of its rows."""
    if voyages is not None:
        sea = attach_arrival(sea, voyages)
    f = distance_features(sea, ports)
    f = rolling_sog(f, bucket_us=None) if by_key else rolling_sog(f, widths=widths)
    f = sog_deviation(f, sea if staged else None, by_key)
    return remaining_travel(f)


def training_set(features: DataFrame) -> DataFrame:
    """The 16-column training table."""
    return features.select(*FEATURE_COLUMNS)


def latest_per_vessel(df: DataFrame, cols: list[str], ts: str = "base_date_time", tie: str = "ping_id") -> DataFrame:
    """Per vessel, the last non-null value of every column in (ts, tie)
    order (pandas ``groupby().last()`` semantics), as one aggregation."""
    order = F.struct(ts, tie)
    aggs = [F.max(ts).alias(ts)]
    for c in cols:
        if c in ("mmsi", ts):
            continue
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c))
    return df.groupBy("mmsi").agg(*aggs)
