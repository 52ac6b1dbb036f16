"""ST2 + ST3 + ST8 in scale mode: a ping buffer per vessel in keyed state.

The predictor in ``stream.py`` trims one buffer of all vessels by the latest time of
any of them. This form keeps state by vessel (``transformWithState`` on RocksDB), so
vessels spread over the cluster and no batch reads a ping twice:

* ``ListState``: the pings of the vessel, one packed chunk for each arrival. Arrivals are appended, never rewritten.
* an event-time timer, one a vessel: ``buffer_hours`` after a vessel's latest ping. When
  the watermark passes it, tracks that have ended (no ping for ``buffer_hours``) leave
  the state and are put out, what the open track holds beyond its last ``buffer_hours``
  is evicted, and the next timer is set. So a list is rewritten at most once in
  ``buffer_hours`` of event time, and holds no more than a few times that.

The watermark trails the latest time of all vessels by ``buffer_hours``: a late ping
counts as the reference counts it, if it is not before that cutoff; one before it is
rejected and counted by the query's progress (`rejected`). A track's end is decided once,
when no ping that belongs to it can come any more, so results do not depend on how the
stream is cut into batches, nor on restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.geo import US_PER_HOUR, epoch_us

BUFFER_HOURS = 48.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "chunk binary"
PING = np.dtype([("us", "<i8"), ("sog", "<f8"), ("latitude", "<f8"), ("longitude", "<f8")])
TRACK = ("mmsi long, first_us long, last_us long, n_pings long, n_sog long, sum_sog double, "
         "latitude double, longitude double")


class TrackBuffer(StatefulProcessor):
    """Per vessel: the pings of the last ``length`` microseconds of each track."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pings = handle.getListState("pings", STATE)

    def _wait(self, last_us: int) -> None:
        """A timer for the time from which a track with this last ping has ended."""
        self.handle.registerTimer((last_us + self.length) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for part in rows:
            chunk = np.empty(len(part), PING)
            for c in PING.names:
                chunk[c] = part[c].to_numpy(dtype=PING[c], na_value=np.nan) if c != "us" else part[c].to_numpy()
            parts.append(chunk)
        came = np.concatenate(parts) if parts else np.empty(0, PING)
        if len(came):
            if not self.pings.exists():  # a vessel with pings has a timer
                self._wait(int(came["us"].max()))
            self.pings.appendValue((came.tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pings = np.concatenate([np.frombuffer(bytes(chunk), PING) for chunk, in self.pings.get()] or [np.empty(0, PING)])
        pings = pings[np.argsort(pings["us"], kind="stable")]
        held, out, first_end = [], [], None
        for track in self._tracks(pings):
            last = int(track["us"][-1])
            kept = track[track["us"] >= last - self.length]
            if (last + self.length) // 1000 + 1 <= now:
                sog = kept["sog"][~np.isnan(kept["sog"])].tolist()
                out.append((int(key[0]), int(kept["us"][0]), last, len(kept), len(sog), float(sum(sog)),
                            float(kept["latitude"][-1]), float(kept["longitude"][-1])))
            else:
                held.append(kept)
                first_end = last if first_end is None else first_end
        if held:
            self.pings.put([(np.concatenate(held).tobytes(),)])
            self._wait(first_end)
        else:
            self.pings.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACK.split(", ")])

    def _tracks(self, pings: np.ndarray) -> list[np.ndarray]:
        return np.split(pings, np.flatnonzero(np.diff(pings["us"]) > self.length) + 1) if len(pings) else []

    def close(self) -> None:
        pass


def ended_tracks(pings: DataFrame, buffer_hours: float = BUFFER_HOURS) -> DataFrame:
    """A stream of pings to a stream of the tracks that have ended (append mode): mmsi,
    first_time and last_time of the buffer, n_pings, mean_sog, and the last position. A track ends where
    a vessel has no ping for ``buffer_hours``; its buffer holds its last ``buffer_hours``, both ends included."""
    length = int(buffer_hours * US_PER_HOUR)
    # Spark takes a row at the watermark for late: the millisecond keeps a ping at the very cutoff
    delay = f"{length // 1000 + 1} milliseconds"
    rows = (pings.withColumn("_ts", F.col("base_date_time").cast("timestamp")).withWatermark("_ts", delay)
            .select("mmsi", "_ts", epoch_us(F.col("base_date_time")).alias("us"), "sog", "latitude", "longitude"))
    tracks = rows.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=TrackBuffer(length), outputStructType=TRACK, outputMode="append", timeMode="EventTime")

    def time(us):
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return tracks.select("mmsi", time("first_us").alias("first_time"), time("last_us").alias("last_time"), "n_pings",
                         (F.col("sum_sog") / F.nullif(F.col("n_sog"), F.lit(0))).alias("mean_sog"), "latitude", "longitude")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_tracks(pings: DataFrame, out: str, checkpoint: str, buffer_hours: float = BUFFER_HOURS) -> list[dict]:
    """Runs the stream over what has come, appends ended tracks to the parquet table ``out``, and
    returns the progress of its batches. Started again with the same checkpoint it goes on where it was."""
    spark = pings.sparkSession
    with rocksdb(spark):
        q = (ended_tracks(pings, buffer_hours).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def rejected(progress: list[dict]) -> int:
    """ST8: the pings that came too late, by the progress of the batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
