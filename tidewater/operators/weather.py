"""Weather enrichment.

Weather comes as hourly frames per 1-degree cell (marine, wind) and per
destination port, loaded from payload files (`sources.ais`) or derived for the
tests (`sources.fixtures`). Joins are left equi-joins on the grid key and the
floored hour; a ping without a row keeps NULLs. AQE broadcasts the weather
side when it is small at run time and otherwise runs a sort-merge join with
skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.geo import flag, floor_hour, grid_1deg, headwind, safe_key, sea_state
from tidewater.operators.spatial import BROADCAST_MAX_PORT_ROWS
from tidewater.session import checked_count

# The three weather frames an enrichment can join.
PARTS = ("marine", "wind", "port")
# Key of the cell weather frames.
CELL = ["lat_bin", "lon_bin", "hour"]

# The weather variables.
MARINE_COLUMNS = ["wave_height", "wave_direction", "wave_period", "swell_wave_height",
                  "ocean_current_velocity", "ocean_current_direction"]
WIND_COLUMNS = ["wind_speed_10m", "wind_gusts_10m", "wind_direction_10m", "precipitation",
                "weather_code", "visibility"]
# Port weather columns are the wind columns renamed with a port_ prefix.
PORT_RENAME = {
    "wind_speed_10m": "port_wind_speed",
    "wind_gusts_10m": "port_wind_gusts",
    "wind_direction_10m": "port_wind_direction",
    "precipitation": "port_precipitation",
    "weather_code": "port_weather_code",
    "visibility": "port_visibility",
}


def add_cell_keys(df: DataFrame, ts: str = "base_date_time") -> DataFrame:
    """F8 + F7: lat_bin, lon_bin (half-even 1-degree cells) and hour."""
    return df.withColumn("lat_bin", grid_1deg("latitude")) \
        .withColumn("lon_bin", grid_1deg("longitude")) \
        .withColumn("hour", floor_hour(ts))


def store_port_weather(port_weather: DataFrame, path: str) -> None:
    """S5 store: port weather partitioned by a path-safe port key (F22); range
    partitions keep a busy port from being one task."""
    port_weather.withColumn("port_key", safe_key("destination_port")) \
        .repartitionByRange("port_key", "hour").write.mode("overwrite").partitionBy("port_key").parquet(path)


def whole_cells(df: DataFrame) -> DataFrame:
    """``df`` with its cell as integers, NULL where there is none."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in CELL[:2]})


def join_stored_cell_weather(df: DataFrame, stored: DataFrame) -> DataFrame:
    """J9 against a table of ``store_cell_weather``: the pings are shuffled into its buckets, the table stays."""
    keyed = df.withColumns({f"_{c}": F.col(c).try_cast("int") for c in CELL[:2]}).alias("l")
    on = [F.col("l._lat_bin") == F.col("r.lat_bin"), F.col("l._lon_bin") == F.col("r.lon_bin"), F.col("l.hour") == F.col("r.hour")]
    values = [F.col(f"r.{c}") for c in stored.columns if c not in CELL]
    return keyed.join(stored.alias("r"), on, "left").select("l.*", *values).drop("_lat_bin", "_lon_bin")


def stored_port_weather(pings: DataFrame, path: str) -> DataFrame:
    """The stored weather of the ports that ``pings`` head for. The semi-join on the
    partition key lets Spark list and read the folders of these ports alone (dynamic
    partition pruning). Ports without a name have no weather."""
    stored = pings.sparkSession.read.parquet(path).withColumn("port_key", F.col("port_key").cast("string"))
    heads = pings.where(F.col("destination_port") != "").select(safe_key("destination_port").alias("port_key")).distinct()
    if checked_count(heads) <= BROADCAST_MAX_PORT_ROWS:
        heads = F.broadcast(heads)
    return stored.join(heads, "port_key", "left_semi").drop("port_key")


def store_cell_weather(cell_weather: DataFrame, table: str, path: str, buckets: int) -> None:
    """S5 store: cell weather bucketed by the join key, one file a bucket, as table ``table``
    with its files in ``path``. The cells are stored as integers: Spark normalises floating
    keys before it joins them and cannot use buckets of such."""
    whole_cells(cell_weather).repartition(buckets, *CELL).write.mode("overwrite").bucketBy(buckets, *CELL).sortBy(*CELL) \
        .option("path", path).saveAsTable(table)


def open_cell_weather(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """A table of ``store_cell_weather``; a session that does not know it takes it over from its files."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        key = ", ".join(CELL)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def join_port_weather(df: DataFrame, port_weather: DataFrame) -> DataFrame:
    """Left join on (destination_port, hour)."""
    return df.join(port_weather, ["destination_port", "hour"], "left")


def derived_weather(df: DataFrame) -> DataFrame:
    """F11 headwind, F12 sea state, F13 flags (missing input counts as 0), as
    far as the joined columns allow."""
    have = set(df.columns)
    wave, wind, port = "wave_height" in have, "wind_speed_10m" in have, "port_wind_gusts" in have
    if wind:
        df = df.withColumn("headwind_component", headwind("cog", "wind_direction_10m", "wind_speed_10m"))
    if wave:
        df = df.withColumn("sea_state", sea_state("wave_height"))
    if wave and wind:
        df = df.withColumn("adverse_sea_state", flag((F.col("wave_height") >= 2.0) | (F.col("wind_speed_10m") >= 10.0)))
    if port:
        df = df.withColumn("port_high_wind", flag(F.col("port_wind_gusts") >= 15.0)) \
            .withColumn("port_precip_flag", flag(F.col("port_precipitation") > 0))
    return df


def enrich(keyed: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Pings with cell keys (`add_cell_keys`) joined with the given weather
    frames (keys of `PARTS`) and the columns derived from them."""
    for part in ("marine", "wind"):
        if part in frames:
            keyed = keyed.join(frames[part], CELL, "left")
    if "port" in frames:
        keyed = join_port_weather(keyed, frames["port"])
    return derived_weather(keyed)
