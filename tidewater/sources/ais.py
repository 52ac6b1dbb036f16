"""Sources and sinks for real AIS data.

* S1: many daily parquet files read as one table with a fixed schema
  (missing columns -> NULL), NaN -> NULL for doubles.
* S2: daily CSV (plain or .csv.zst) -> rename -> numeric coercion -> cargo
  filter -> parquet partitioned by date; every file is read by its own header, a
  run reads the files that no run before it has read (the checkpoint of a file
  stream is the ledger), rows without a usable time are kept apart.
* S3: port list CSV with DMS coordinates -> lat_dd / lon_dd (F1), bad text ->
  NULL and counted, duplicated port names dropped (J7 needs a unique name).
* S5: weather payloads (JSON objects with parallel hourly arrays) -> one row
  per hour with ``inline(arrays_zip(...))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.geo import dms_to_dd, to_int
from tidewater.operators.weather import MARINE_COLUMNS, WIND_COLUMNS
from tidewater.session import prepare

# Raw column names -> project column names.
COLUMN_RENAME = {
    "MMSI": "mmsi",
    "BaseDateTime": "base_date_time",
    "LAT": "latitude",
    "LON": "longitude",
    "SOG": "sog",
    "COG": "cog",
    "Heading": "heading",
    "VesselName": "vessel_name",
    "IMO": "imo",
    "CallSign": "call_sign",
    "VesselType": "vessel_type",
    "Status": "status",
    "Length": "length",
    "Width": "width",
    "Draft": "draft",
    "Cargo": "cargo",
    "TransceiverClass": "transceiver",
}
CARGO_TYPE_MIN = 70
CARGO_TYPE_MAX = 79

AIS_SCHEMA = T.StructType([
    T.StructField("mmsi", T.LongType()),
    T.StructField("base_date_time", T.TimestampNTZType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()),
    T.StructField("heading", T.DoubleType()),
    T.StructField("vessel_name", T.StringType()),
    T.StructField("imo", T.StringType()),
    T.StructField("call_sign", T.StringType()),
    T.StructField("vessel_type", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("draft", T.DoubleType()),
    T.StructField("cargo", T.IntegerType()),
    T.StructField("transceiver", T.StringType()),
])
REQUIRED = ["mmsi", "base_date_time", "latitude", "longitude", "sog"]

PORTS_SCHEMA = T.StructType([
    T.StructField("portNumber", T.IntegerType()),
    T.StructField("portName", T.StringType()),
    T.StructField("countryCode", T.StringType()),
    T.StructField("longitude", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("dodWaterBody", T.StringType()),
])


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast("double")).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _row_key() -> F.Column:
    """A stable key of a ping made from its content; equal rows share it."""
    return F.xxhash64(*[f.name for f in AIS_SCHEMA.fields]).alias("ping_id")


def read_ais_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S1 + U1: one scan over all daily files, fixed schema, NaN -> NULL, and
    ``ping_id``, the row key that the stay and port-call steps order ties by."""
    prepare(spark)
    paths = [paths] if isinstance(paths, str) else paths
    return _nan_to_null(spark.read.schema(AIS_SCHEMA).option("recursiveFileLookup", True).parquet(*paths)).select("*", _row_key())


def normalize_raw(df: DataFrame) -> DataFrame:
    """P8 + F21: raw names -> project names, typed by try_cast; columns that
    the file does not have are NULL, except those the filter and the key need."""
    known = {c.lower(): c for c in df.columns}
    names = {ours: raw for raw, ours in COLUMN_RENAME.items()}
    source = {f.name: known.get(names[f.name].lower(), known.get(f.name)) for f in AIS_SCHEMA.fields}
    missing = [c for c in [*REQUIRED, "vessel_type"] if source[c] is None]
    if missing:
        raise ValueError(f"raw AIS file without {', '.join(missing)}")
    cols = []
    for f in AIS_SCHEMA.fields:
        if source[f.name] is None:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.try_to_timestamp(F.col(source[f.name]).cast("string")).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegerType):
            c = to_int(F.col(source[f.name]))
        else:
            c = F.col(source[f.name]).cast("string").try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return _nan_to_null(df.select(*cols))


def cargo_filter(df: DataFrame) -> DataFrame:
    """vessel_type in [70, 79] after numeric coercion; non-numeric dropped."""
    vt = F.col("vessel_type").cast("string").try_cast("double")
    return df.where(vt.between(CARGO_TYPE_MIN, CARGO_TYPE_MAX))


def read_raw_csv(spark: SparkSession, headers: dict[str, list[str]]) -> DataFrame:
    """Raw CSV files as typed pings, by ``headers``: a header line to the files that begin with it.
    Columns are found by name, so files may order them differently or lack some."""
    frames = [normalize_raw(spark.read.option("header", True).csv(sorted(files))) for _, files in sorted(headers.items())]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def file_headers(lines: DataFrame) -> dict[str, list[str]]:
    """Header line to files, from ``lines(value, file, block_start)`` of text files. A file's
    first line is the least row of its first block; one row a file reaches the driver, and a run
    takes at most ``FILES_PER_BATCH`` files at a time."""
    first = (lines.where("block_start = 0").withColumn("_at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "_at").alias("header")))
    out: dict[str, list[str]] = {}
    for r in first.collect():
        out.setdefault(r["header"].strip("\ufeff\r"), []).append(r["file"])
    return out


def ingest_daily_csv(spark: SparkSession, csv_path: str, out_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw CSV files under ``csv_path`` -> cargo pings under ``out_dir``,
    partitioned by date; files ingested before are not read again. Returns all
    pings ingested so far."""
    ingest(spark, csv_path, out_dir, files_per_batch)
    return ingested(spark, out_dir)


def ingest(spark: SparkSession, csv_path: str, out_dir: str, files_per_batch: int | None = None) -> list[dict]:
    """One run of S2; returns the progress of its micro-batches.

    A file stream over the raw lines finds the new files; its checkpoint,
    ``out_dir/_ledger``, records them by path once their batch is written, so a
    file with a few rows of the next day does not stand in for that day's own
    file, and a run that fails is taken up by the next one at the batch that
    failed. A batch writes ``run=<batch>`` (and ``_rejects/run=<batch>``, the
    rows whose time does not parse) over what a failed attempt left there."""
    prepare(spark)
    lines = (spark.readStream.format("text").option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", files_per_batch or FILES_PER_BATCH)
             .option("maxFileAge", "36500d")  # a file delivered late is not too old
             .load(csv_path).select("value", F.col("_metadata.file_path").alias("file"),
                                    F.col("_metadata.file_block_start").alias("block_start")))

    def write(batch: DataFrame, batch_id: int) -> None:
        headers = file_headers(batch)
        if not headers:
            return
        pings = cargo_filter(read_raw_csv(batch.sparkSession, headers))
        timed = F.col("base_date_time").isNotNull()
        pings.where(~timed).write.mode("overwrite").parquet(f"{out_dir}/_rejects/run={batch_id}")
        # a day's rows spread over tasks; files are sorted by vessel and time
        pings.where(timed).withColumn("date", F.to_date("base_date_time")) \
            .repartitionByRange("date", "mmsi", "base_date_time").sortWithinPartitions("date", "mmsi", "base_date_time") \
            .write.mode("overwrite").partitionBy("date").parquet(f"{out_dir}/run={batch_id}")
    q = (lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{out_dir}/_ledger")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"]]


def ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """The pings of all batches that are complete."""
    prepare(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [st.getPath().toString() for st in (fs.listStatus(p) if fs.exists(p) else [])
            if st.getPath().getName().startswith("run=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    if not runs:
        return spark.createDataFrame([], AIS_SCHEMA).select("*", _row_key())
    return read_ais_parquet(spark, sorted(runs))


#: Files that one batch of an ingest takes at most.
FILES_PER_BATCH = 1000


def read_ports_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3 + F1: port list with decimal degrees and ``port_number``. Returns
    (ports, bad_rows): rows whose DMS text does not parse go to ``bad_rows``;
    of a duplicated portName the row with the least number is kept. Quotes
    inside a field are doubled, as CSV writers do."""
    prepare(spark)
    p = spark.read.schema(PORTS_SCHEMA).option("header", True).option("escape", '"').csv(path) \
        .withColumn("lat_dd", dms_to_dd("latitude")).withColumn("lon_dd", dms_to_dd("longitude")) \
        .withColumn("port_number", F.col("portNumber"))
    ok = F.col("lat_dd").isNotNull() & F.col("lon_dd").isNotNull()
    first = p.where(ok).groupBy("portName").agg(F.min(F.struct("port_number", *[c for c in p.columns if c != "port_number"])).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in p.columns]), p.where(~ok)


MARINE_HOURLY, SURFACE_HOURLY = MARINE_COLUMNS, WIND_COLUMNS


def read_weather_payloads(spark: SparkSession, path: str, variables: list[str],
                          key_cols: dict[str, T.DataType]) -> DataFrame:
    """JSON payloads ``{<keys>, "hourly": {"time": [...], <var>: [...]}}``
    -> one row per (key, hour), the hour named as the weather joins need it. A variable missing from a payload (e.g.
    ``visibility``) becomes NULL."""
    prepare(spark)
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] +
                          [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables])
    schema = T.StructType([T.StructField(k, t) for k, t in key_cols.items()] +
                          [T.StructField("hourly", hourly)])
    raw = spark.read.schema(schema).json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ["time", *variables]])
    rows = raw.select(*key_cols, F.inline(zipped))
    return rows.withColumn("time", F.try_to_timestamp("time").cast("timestamp_ntz")).withColumnRenamed("time", "hour")


def write_weather_payloads(weather: DataFrame, key_cols: list[str], variables: list[str], path: str) -> None:
    """Inverse of S5 (used to build payload files from weather rows): one JSON
    object per key with parallel hourly arrays, ordered by time."""
    s = weather.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("time"), *variables))).alias("_h"))
    s.select(*key_cols, F.struct(*[F.col(f"_h.{c}").alias(c) for c in ["time", *variables]]).alias("hourly")) \
        .write.mode("overwrite").json(path)
