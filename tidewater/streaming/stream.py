"""Structured Streaming (S6-S9, ST1-ST9).

* Messages are JSON objects, one per ping (S7); a Kafka topic (S6/S8) or a
  folder of JSON-lines files (S9 replay) carries them. The Kafka connector is
  not installed here, so tests use the file source with the same parser.
* ST7: port visits on the stream: watermark + ``session_window`` with the
  gap threshold, appended to a parquet sink.
* ST1-ST6: the predictor. Each micro-batch goes to ``foreachBatch``, which
  appends it to the retained ping buffer (append-only, one folder per batch),
  reads it back trimmed to ``max(ts) - buffer_hours`` over all vessels (P6/ST3,
  exact), runs the same batch functions as the batch pipeline (ST5) and
  upserts the vessel registry (ST6, ``registry.py``: deltas over a base). A micro-batch is scored in slices of
  half a buffer length, so every ping is scored. With
  ``pass_every`` a pass waits until that many messages have come (ST4; a Kafka
  source bounds its batches by ``maxOffsetsPerTrigger``). Buffer folders,
  buffer metadata and the registry are keyed by batch id, so a batch that is
  replayed after a failure overwrites only its own outputs (idempotent) and the
  query restarts from its checkpoint (ST9). Evicted batches and superseded
  versions are deleted.
* Messages that do not parse are counted with their reason (F20); they never
  stop the stream.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.geo import US_PER_HOUR, epoch_us, iso_timestamp
from tidewater.operators import features as feat
from tidewater.operators import sessions, spatial, voyages
from tidewater.session import path_exists, prepare
from tidewater.streaming.registry import Registry

MESSAGE_SCHEMA = T.StructType([
    T.StructField("ping_id", T.LongType()),
    T.StructField("mmsi", T.LongType()),
    T.StructField("base_date_time", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()),
    T.StructField("vessel_type", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),
])

HEARTBEAT_MMSI = -1

# The columns of a message and of the vessel registry.
REGISTRY_COLUMNS = ["mmsi", "last_prediction_time", "predicted_remaining_hours", "origin_port",
                    "destination_port", "latitude", "longitude"]
REGISTRY_SCHEMA = ("mmsi bigint, last_prediction_time timestamp_ntz, predicted_remaining_hours double, "
                   "origin_port string, destination_port string, latitude double, longitude double")


# ------------------------------------------------------------------ sinks/sources
def _message(pings: DataFrame):
    """The message of a ping as a struct, ISO-8601 time, NaN -> null."""
    cols = []
    for f in pings.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_timestamp(c)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.nanvl(c, F.lit(None).cast("double"))
        cols.append(c.alias(f.name))
    return F.struct(*cols)


def to_messages(pings: DataFrame) -> DataFrame:
    """One JSON text per ping, keyed by vessel id."""
    return pings.select(F.to_json(_message(pings), {"ignoreNullFields": "false"}).alias("value"),
                        F.col("mmsi").cast("string").alias("key"))


def write_replay(pings: DataFrame, path: str, unit_hours: float = 24.0,
                 heartbeat_after_h: float | None = None, late: DataFrame | None = None) -> int:
    """S9 (test support): replay folder of JSON-lines files in time order, one
    file per ``unit_hours``, written by one job; returns the number of files.

    Rows are range-partitioned by unit and each unit is one file. The file
    source takes files in modification-time order, so the files get increasing
    times (a list of file names is all that reaches the driver).

    ``late`` pings come in a file after all others. ``heartbeat_after_h``
    appends one heartbeat message in the last file, stamped that many hours
    plus one second after the last ping, so an event-time watermark can close
    the last open sessions. It carries the sentinel vessel id -1 (outside the
    9-digit MMSI range) at (0, 0) with sog 0: it passes every filter Catalyst
    pushes below the watermark and then matches no port in the spatial join,
    so it moves event time and adds no row."""
    unit = F.floor(epoch_us(F.col("base_date_time")) / int(unit_hours * US_PER_HOUR)).cast("long")

    def lines(df, unit):
        msg = F.to_json(_message(df), {"ignoreNullFields": "false"}).alias("value")
        return df.select(unit.alias("_u"), "base_date_time", "ping_id", msg)
    rows = lines(pings, unit)
    last = 1 << 40
    if late is not None:
        rows = rows.unionByName(lines(late, F.lit(last)))
    rows = rows.select("_u", "base_date_time", "ping_id", "value")
    (rows.repartitionByRange("_u").sortWithinPartitions("_u", "base_date_time", "ping_id")
     .select("_u", "value").write.mode("overwrite").partitionBy("_u").text(path))
    if heartbeat_after_h is not None:
        step = int(heartbeat_after_h * 3600) + 1
        hb = pings.agg(F.max("base_date_time").alias("m")).select(
            F.lit(last + 1).alias("_u"),
            F.to_json(F.struct(
                F.lit(HEARTBEAT_MMSI).cast("long").alias("mmsi"),
                iso_timestamp(F.col("m") + F.make_interval(secs=F.lit(step))).alias("base_date_time"),
                F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("sog"),
            )).alias("value")).where(F.col("m").isNotNull())
        hb.write.mode("append").partitionBy("_u").text(path)
    return _order_files(pings.sparkSession, path)


def _order_files(spark: SparkSession, path: str) -> int:
    """Give the files of ``path/_u=<unit>/`` increasing modification times, in unit order."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(int(st.getPath().getParent().getName().split("=", 1)[1]), st.getPath())
             for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(p, "_u=*/part-*"))]
    found.sort(key=lambda x: x[0])
    start = int(time.time() * 1000) - 1000 * len(found)
    for i, (_, file) in enumerate(found):
        fs.setTimes(file, start + 1000 * i, -1)
    return len(found)


def write_kafka(pings: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """value = JSON, key = mmsi text (one vessel stays in one partition)."""
    (to_messages(pings).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic).save())


def read_messages(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """ST1 + F20: JSON text -> the message columns and ``problem``: NULL for a
    good message, else ``bad json``, ``bad time`` or ``no vessel`` (P7). A bad
    message is data, never an error."""
    parsed = raw.select(F.from_json(F.col(value_col).cast("string"), MESSAGE_SCHEMA,
                                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    ts = F.try_to_timestamp("base_date_time").cast("timestamp_ntz")
    return parsed.select("m.*").withColumn("base_date_time", ts).withColumn(
        "problem", F.when(F.col("_corrupt_record").isNotNull(), "bad json")
        .when(F.col("base_date_time").isNull(), "bad time")
        .when(F.col("mmsi").isNull() | (F.col("mmsi") == 0), "no vessel")).drop("_corrupt_record")


def message_quality(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """number of messages per problem (``ok`` for good ones)."""
    return read_messages(raw, value_col).groupBy(F.coalesce("problem", F.lit("ok")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("n"))


def parse_messages(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """The good messages as typed pings."""
    return read_messages(raw, value_col).where(F.col("problem").isNull()).drop("problem")


def valid_keys(df: DataFrame) -> DataFrame:
    """Drop null / 0 vessel ids."""
    return df.where(F.col("mmsi").isNotNull() & (F.col("mmsi") != 0))


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """S9 + ST4: JSON-lines files, at most ``files_per_trigger`` per micro-batch."""
    r = spark.readStream.format("text")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return parse_messages(r.load(path))


def read_kafka_stream(spark: SparkSession, bootstrap_servers: str, topic: str,
                      max_offsets_per_trigger: int = 500) -> DataFrame:
    """S6 + ST4: Kafka source from the earliest offset, 500 messages per batch."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
           .option("subscribe", topic).option("startingOffsets", "earliest")
           .option("maxOffsetsPerTrigger", max_offsets_per_trigger).load())
    return parse_messages(raw)


# ------------------------------------------------------------------ ST7
def stream_port_visits(pings: DataFrame, ports: DataFrame, radius_nm: float = 10.0,
                       max_speed_knots: float = 1.5, gap_threshold_h: float = 24.0) -> DataFrame:
    """ST7: visits on a stream. Candidates come from the same grid join
    (stream-static, ports broadcast); sessions close when the watermark
    passes their end (append mode)."""
    # merge a vessel's sessions map side before they are shuffled by vessel
    pings.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    gap = f"{int(gap_threshold_h * 3600)} seconds"
    wm = pings.withColumn("_ts", F.col("base_date_time").cast("timestamp")).withWatermark("_ts", gap)
    cand = spatial.find_candidates(wm, ports, radius_nm, max_speed_knots)
    agg = (cand
           .groupBy("mmsi", "portName", F.session_window("_ts", gap).alias("_s"))
           .agg(F.min("base_date_time").alias("entry_time"), F.max("base_date_time").alias("exit_time")))
    return agg.select(
        "mmsi", "portName", "entry_time", "exit_time",
        ((epoch_us(F.col("exit_time")) - epoch_us(F.col("entry_time"))) / float(US_PER_HOUR)).alias("duration_hours"))


# ------------------------------------------------------------------ ST2-ST6
def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions ``v=<id>`` under a folder, ascending."""
    found = [(re.fullmatch(r"v=(\d+)", name), p) for name, p in _children(spark, path)]
    return sorted(int(m[1]) for m, p in found if m and path_exists(spark, f"{p}/_SUCCESS"))


def _latest_before(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    prior = [v for v in _versions(spark, path) if v < batch_id]
    if not prior:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={prior[-1]}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _children(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, path) of the entries of a folder; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(st.getPath().getName(), st.getPath().toString()) for st in fs.listStatus(p)] if fs.exists(p) else []


#: More than any vessel id (9 digits); a pass numbers its vessels slice * VESSEL_IDS + mmsi.
VESSEL_IDS = 100_000_000_000

BUFFER_SCHEMA = T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.name == "base_date_time" else f.dataType)
                              for f in MESSAGE_SCHEMA.fields if f.name != "_corrupt_record"])
META_SCHEMA = "batch_id bigint, batch_min bigint, batch_max bigint, n bigint, passed boolean, running_max bigint"


class Predictor:
    """Stateful scorer driven by ``foreachBatch``.

    ``score`` maps a frame of latest features to the same with
    ``predicted_remaining_hours`` (`training.model_scorer`, or any other).
    ``state_dir`` must be on shared storage (the cluster checkpoint folder).
    ``pass_every``: messages to wait for between passes."""

    def __init__(self, spark: SparkSession, ports: DataFrame, score, state_dir: str,
                 buffer_hours: float = 48.0, radius_nm: float = 10.0, max_speed_knots: float = 1.5,
                 gap_threshold_h: float = 24.0, pass_every: int = 1, compact_every: int = 8):
        self.spark = prepare(spark)
        self.ports = ports
        self.score = score
        self.state_dir = state_dir.rstrip("/")
        self.buffer_hours = buffer_hours
        self.pass_every = pass_every
        self.radius_nm, self.max_speed, self.gap = radius_nm, max_speed_knots, gap_threshold_h
        self.vessels = Registry(self.spark, f"{self.state_dir}/registry", REGISTRY_SCHEMA, compact_every=compact_every)

    @property
    def buffer_path(self) -> str:
        return f"{self.state_dir}/buffer"

    @property
    def meta_path(self) -> str:
        return f"{self.state_dir}/meta"

    def prediction_pass(self, buffer: DataFrame) -> DataFrame:
        """ST5: visits -> labels -> voyages -> sea pings -> features ->
        latest per vessel -> predict -> clip, for every ``slice`` of the buffer
        at once. Same stage plan as the batch pipeline, with the buffer in place
        of the pings and a vessel of each slice as a vessel of its own; its
        stage tables are deleted when the next pass begins. Returns the
        registry columns and ``slice``."""
        from tidewater.plans.pipeline import Stages
        pings = buffer.withColumn("mmsi", F.col("slice") * VESSEL_IDS + F.col("mmsi")).drop("slice")
        st = Stages(self.spark, pings_df=pings, ports_df=self.ports, radius_nm=self.radius_nm,
                    max_speed_knots=self.max_speed, gap_threshold_h=self.gap, keep_dir=f"{self.state_dir}/pass")
        _delete(self.spark, st.keep_dir)
        latest = feat.latest_per_vessel(st.features_plan, feat.FEATURE_COLUMNS)
        return self.score(latest).select(
            F.floor(F.col("mmsi") / VESSEL_IDS).alias("slice"), (F.col("mmsi") % VESSEL_IDS).alias("mmsi"),
            F.col("base_date_time").alias("last_prediction_time"), "predicted_remaining_hours",
            "origin_port", "destination_port", "latitude", "longitude")

    def _buffer(self, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(BUFFER_SCHEMA).parquet(*[f"{self.buffer_path}/batch={i}" for i in batches])

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """ST2/ST3/ST5/ST6 for one micro-batch.

        The buffer is append-only: the batch's rows go to ``batch=<id>`` and a
        meta version ``v=<id>`` lists the live batches (their max time is
        inside the buffer) and the running max time over all vessels. The
        batch's times, with those of batches that still wait for a pass, are
        cut into slices of half the buffer length. A slice is scored up to its
        last ping, over the pings with ``last - buffer_hours <= ts <= last``
        (P6, exact), so every ping is scored with at least half a buffer of
        what came before it; one pass does all slices, in which a ping occurs
        three times at most. Each batch writes O(batch) rows, and a replayed batch overwrites only its own
        folder and versions."""
        t = epoch_us(F.col("base_date_time"))
        batch.select(*BUFFER_SCHEMA.fieldNames()).write.mode("overwrite").parquet(f"{self.buffer_path}/batch={batch_id}")
        own = self.spark.read.schema(BUFFER_SCHEMA).parquet(f"{self.buffer_path}/batch={batch_id}")
        stats = own.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("n")).first()
        # live batches: a handful of rows of longs, read and written as scalars
        prev = _latest_before(self.spark, self.meta_path, batch_id, META_SCHEMA).collect()
        running = max([r["running_max"] for r in prev if r["running_max"] is not None], default=None)
        rows = [(r["batch_id"], r["batch_min"], r["batch_max"], r["n"], r["passed"])
                for r in prev if r["batch_id"] is not None and r["batch_id"] != batch_id]
        if stats["n"]:
            rows.append((batch_id, stats["lo"], stats["hi"], stats["n"], False))
        if sum(r[3] for r in rows if not r[4]) >= max(self.pass_every, 1):
            self._passes(rows, running, batch_id)
            rows = [(*r[:4], True) for r in rows]
        self._commit(rows, running, batch_id)

    def _passes(self, rows: list, running: int | None, batch_id: int) -> None:
        """One pass over the slices of the batches that wait; then the registry."""
        length = int(self.buffer_hours * US_PER_HOUR)
        t = epoch_us(F.col("base_date_time"))
        fresh = self._buffer([r[0] for r in rows if not r[4]])
        ends = [r["hi"] for r in fresh.groupBy(F.floor(t / (length // 2)).alias("s")).agg(F.max(t).alias("hi")).collect()]
        if running is not None:  # late slices are seen from the latest time on
            ends = [max(e, running) for e in ends]
        ends = sorted(set(ends))
        live = [r[0] for r in rows if r[2] >= ends[0] - length]
        slices = F.array(*[F.struct(F.lit(i).cast("long").alias("slice"), F.lit(e).cast("long").alias("end")) for i, e in enumerate(ends)])
        inside = F.filter(slices, lambda x: (t >= x["end"] - length) & (t <= x["end"]))
        buffer = self._buffer(live).select("*", F.explode(F.transform(inside, lambda x: x["slice"])).alias("slice"))
        new = self.prediction_pass(buffer)
        # of the slices that score a vessel, the last one stands
        reg = new.groupBy("mmsi").agg(F.max_by(F.struct(*REGISTRY_COLUMNS[1:]), F.col("slice")).alias("r")) \
            .select("mmsi", "r.*")
        self.vessels.write(reg, batch_id)

    def _commit(self, rows: list, running: int | None, batch_id: int) -> None:
        """The meta version, and away with what neither it nor the version before needs (a
        replayed batch starts from that one): evicted batches and superseded versions."""
        spark = self.spark
        running = max([r[2] for r in rows] + ([running] if running is not None else []), default=None)
        cutoff = None if running is None else running - int(self.buffer_hours * US_PER_HOUR)
        live = [r for r in rows if r[2] >= cutoff or not r[4]]
        meta = [(*r, running) for r in live] or [(None, None, None, None, None, running)]
        before = {r["batch_id"] for r in _latest_before(spark, self.meta_path, batch_id, META_SCHEMA).collect()}
        spark.createDataFrame(meta, META_SCHEMA).write.mode("overwrite").parquet(f"{self.meta_path}/v={batch_id}")
        keep = before | {r[0] for r in live} | {batch_id}
        for name, path in _children(spark, self.buffer_path):
            if name.startswith("batch=") and int(name[6:]) not in keep:
                _delete(spark, path)
        for v in _versions(spark, self.meta_path)[:-2]:
            _delete(spark, f"{self.meta_path}/v={v}")

    def flush(self) -> None:
        """A pass over the messages that still wait for ``pass_every`` (the end of a finite stream)."""
        last = _versions(self.spark, self.meta_path)
        if last:
            batch_id = last[-1] + 1
            rows = [(r["batch_id"], r["batch_min"], r["batch_max"], r["n"], r["passed"]) for r in
                    _latest_before(self.spark, self.meta_path, batch_id, META_SCHEMA).collect() if r["batch_id"] is not None]
            if any(not r[4] for r in rows):
                self._passes(rows, None, batch_id)
                self._commit([(*r[:4], True) for r in rows], None, batch_id)

    def registry(self) -> DataFrame:
        """Vessel summary ordered by mmsi; empty with schema before the first pass."""
        return self.vessels.read().orderBy("mmsi")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        w = stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
