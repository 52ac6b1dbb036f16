"""S4 + S2 day by day: port visits and voyages kept up to date as days of pings arrive.

`advance(until)` reads the pings between the last day taken in and ``until`` (exclusive),
and what it has to keep of the past: visits that a ping of the new days could still prolong,
and visits whose voyage is not settled. Four tables, each with one folder ``until=<day>``
a run, which a repeated run overwrites:

* ``visits``: the visits that ended: their gap has passed by ``until``.
* ``voyages``: the pairs of consecutive visits that are settled: both visits, and those with
  the same entry times as they, have ended, so no later ping changes their order.
* ``carry``: the state after the run, of a vessel its visits from the first one on that is open or
  not settled; written last, so it says which days are complete.

So a new day costs its own pings and the carried visits; folders of earlier days are not touched.
Days that are delivered again are taken in by ``redo``, from the state before them. `visits` and
`voyages` are, after any sequence of runs, what a rebuild over all pings up to that day gives.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import US_PER_HOUR, epoch_us
from tidewater.operators import sessions, voyages
from tidewater.plans.pipeline import GAP_THRESHOLD_H, MAX_SPEED_KNOTS, RADIUS_NM
from tidewater.session import path_exists, prepare, write_stage

_VISIT = "mmsi long, portName string, entry_time timestamp_ntz, exit_time timestamp_ntz"
_CARRY = _VISIT + ", closed boolean, settled boolean"
_VOYAGE = ("mmsi long, departure_port string, departure_time timestamp_ntz, arrival_port string, "
           "arrival_time timestamp_ntz, duration_hours double")
_KEY = ["mmsi", "portName", "entry_time"]


class DailyVisits:
    """``pings`` may have a ``date`` column that its files are partitioned by (`ais.ingested`): a run
    then reads its days' folders alone."""

    def __init__(self, spark: SparkSession, root: str, pings: DataFrame, ports: DataFrame, radius_nm: float = RADIUS_NM,
                 max_speed_knots: float = MAX_SPEED_KNOTS, gap_threshold_h: float = GAP_THRESHOLD_H):
        self.spark, self.root, self.pings, self.ports = prepare(spark), root.rstrip("/"), pings, ports
        self.radius_nm, self.max_speed, self.gap_h = radius_nm, max_speed_knots, gap_threshold_h

    # --- tables
    def days(self) -> list[str]:
        """The complete runs, ascending, by the day they end before."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/carry")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        days = [m[1] for m in (re.fullmatch(r"until=(\d{4}-\d\d-\d\d)", n) for n in names) if m]
        return sorted(d for d in days if path_exists(self.spark, f"{self.root}/carry/until={d}/_SUCCESS"))

    def _write(self, df: DataFrame, table: str, day: str) -> DataFrame:
        path = f"{self.root}/{table}/until={day}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, table: str, schema: str, days: list[str]) -> DataFrame:
        if not days:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/until={d}" for d in days])

    # --- runs
    def advance(self, until: datetime.date) -> None:
        """Takes in the days up to ``until``, without it."""
        days, day = self.days(), until.isoformat()
        if days and day <= days[-1]:
            raise ValueError(f"days up to {days[-1]} are taken in; use redo")
        self._run(days[-1] if days else None, day)

    def redo(self, since: datetime.date) -> None:
        """Repeats the runs that took in ``since`` or a later day: after its pings were delivered again."""
        days = self.days()
        for i, day in enumerate(days):
            if day > since.isoformat():
                self._run(days[i - 1] if i else None, day)

    def _between(self, after: str | None, until: str) -> DataFrame:
        t, p = F.col("base_date_time"), self.pings
        if "date" in p.columns:
            p = p.where(F.col("date") < F.lit(until).cast("date"))
            p = p if after is None else p.where(F.col("date") >= F.lit(after).cast("date"))
        p = p.where(t < F.lit(until).cast("timestamp_ntz"))
        return p if after is None else p.where(t >= F.lit(after).cast("timestamp_ntz"))

    def _run(self, after: str | None, until: str) -> None:
        carry = self._read("carry", _CARRY, [after] if after else [])
        new = sessions.find_port_visits(self._between(after, until), self.ports, self.radius_nm, self.max_speed, self.gap_h)
        gap = int(round(self.gap_h * US_PER_HOUR))
        cols = [c.split()[0] for c in _VISIT.split(", ")]
        parts = carry.where("not closed").select(*cols).unionByName(new.select(*cols))
        # an open visit and the new days' visits of one vessel and port: a few rows of a key
        w = Window.partitionBy("mmsi", "portName").orderBy("entry_time", "exit_time")
        reach = F.max("exit_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.coalesce(epoch_us(F.col("entry_time")) - epoch_us(reach) > gap, F.lit(True))
        merged = (parts.withColumn("_new", apart.cast("int"))
                  .withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                  .groupBy("mmsi", "portName", "_no").agg(F.min("entry_time").alias("entry_time"), F.max("exit_time").alias("exit_time")))
        end = epoch_us(F.lit(until).cast("timestamp_ntz"))
        merged = merged.select(*cols, (epoch_us(F.col("exit_time")) + gap < end).alias("closed"), F.lit(False).alias("settled"))
        known = write_stage(merged.unionByName(carry.where("closed")), "known")
        self._write(known.join(carry.where("closed").select(*_KEY), _KEY, "left_anti").where("closed").select(*cols), "visits", until)

        pairs = write_stage(self._settled(known), "pairs")
        self._write(pairs.where("settled and kept").join(
            known.where("settled").select("mmsi", F.col("portName").alias("departure_port"), F.col("entry_time").alias("dep_entry_time")),
            ["mmsi", "departure_port", "dep_entry_time"], "left_anti").select(*self._voyage_columns()), "voyages", until)
        done = pairs.where("settled").select("mmsi", F.col("departure_port").alias("portName"), F.col("dep_entry_time").alias("entry_time"),
                                             F.lit(True).alias("_done"))
        state = write_stage(known.join(done, _KEY, "left")
                            .select(*cols, "closed", (F.col("settled") | F.coalesce("_done", F.lit(False))).alias("settled")), "state")
        first = state.where("not settled").groupBy("mmsi").agg(F.min("entry_time").alias("_from"))
        self._write(state.join(first, "mmsi").where("entry_time >= _from").drop("_from"), "carry", until)

    @staticmethod
    def _settled(known: DataFrame) -> DataFrame:
        """W3 pairs of the known visits, with ``settled``: no visit with the entry time of either is open."""
        groups = known.groupBy("mmsi", "entry_time").agg(F.min("closed").alias("_closed"))
        side = lambda t, c: groups.select("mmsi", F.col("entry_time").alias(t), F.col("_closed").alias(c))
        visits = known.withColumn("duration_hours", F.lit(0.0))
        return (voyages.pair_visits(visits).join(side("dep_entry_time", "_c1"), ["mmsi", "dep_entry_time"])
                .join(side("arrival_time", "_c2"), ["mmsi", "arrival_time"]).withColumn("settled", F.col("_c1") & F.col("_c2")))

    @staticmethod
    def _voyage_columns() -> list:
        hours = (epoch_us(F.col("arrival_time")) - epoch_us(F.col("departure_time"))) / float(US_PER_HOUR)
        return ["mmsi", "departure_port", "departure_time", "arrival_port", "arrival_time", hours.alias("duration_hours")]

    # --- results
    def visits(self) -> DataFrame:
        """A1 over all days taken in: ended visits, and open ones as they are."""
        days = self.days()
        ended = self._read("visits", _VISIT, days)
        whole = ended.unionByName(self._read("carry", _CARRY, days[-1:]).where("not closed").drop("closed", "settled"))
        hours = (epoch_us(F.col("exit_time")) - epoch_us(F.col("entry_time"))) / float(US_PER_HOUR)
        return whole.withColumn("duration_hours", hours)

    def voyages(self) -> DataFrame:
        """W3 over all days taken in (without numbers, which a new day would change)."""
        days = self.days()
        carry = self._read("carry", _CARRY, days[-1:])
        rest = carry.where("not settled").select("mmsi", F.col("portName").alias("departure_port"), F.col("entry_time").alias("dep_entry_time"))
        pending = voyages.pair_visits(carry.withColumn("duration_hours", F.lit(0.0))).where("kept") \
            .join(rest, ["mmsi", "departure_port", "dep_entry_time"], "left_semi").select(*self._voyage_columns())
        return self._read("voyages", _VOYAGE, days).unionByName(pending)
