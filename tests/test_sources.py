"""Sources: S1 parquet scan, S2 daily CSV ingest, S3 port CSV + F1, S5 weather payloads."""

import csv
import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import session
from tidewater.operators import weather
from tidewater.plans.pipeline import Stages
from tidewater.sources import ais, fixtures

SF = "/root/testdata/sf0.001"


def _write_csv(path, name, rows, header=("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselType")):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def _row(mmsi, time, kind="70"):
    return (mmsi, time, 40.0, -74.0, 1.0, kind)


def test_ingest_by_file(spark):
    """Cargo only, numbers in any spelling, a day's own file not hidden by a stray row, bad times kept apart."""
    d = tempfile.mkdtemp(prefix="tw-ingest-")
    kinds = ["70", "79.0", " 75", "69", "80", "n/a", "", "x70"]
    _write_csv(f"{d}/csv", "day1.csv", [_row(i, f"2025-01-01T0{i}:00:00", k) for i, k in enumerate(kinds)]
               + [_row(50, "2025-01-02T00:00:01"), _row(51, "no time")])
    first = ais.ingest_daily_csv(spark, f"{d}/csv", f"{d}/out")
    assert sorted(r.mmsi for r in first.collect()) == [0, 1, 2, 50]
    _write_csv(f"{d}/csv", "day2.csv", [_row(60, "2025-01-02T05:00:00"), _row(61, "2025-01-02T06:00:00")])
    again = ais.ingest_daily_csv(spark, f"{d}/csv", f"{d}/out")
    assert sorted(r.mmsi for r in again.collect()) == [0, 1, 2, 50, 60, 61]
    assert sorted(r.mmsi for r in ais.ingest_daily_csv(spark, f"{d}/csv", f"{d}/out").collect()) == [0, 1, 2, 50, 60, 61]
    assert [r.mmsi for r in spark.read.option("recursiveFileLookup", True).parquet(f"{d}/out/_rejects").collect()] == [51]
    assert again.columns == [f.name for f in ais.AIS_SCHEMA.fields] + ["ping_id"]
    assert again.where(F.col("heading").isNotNull()).count() == 0      # missing column -> NULL
    assert again.select("ping_id").distinct().count() == 6


def test_ingest_by_header_and_new_files_only(spark):
    """Files of one folder with other column orders and sets; a later run reads the new file's lines alone."""
    d = tempfile.mkdtemp(prefix="tw-headers-")
    _write_csv(f"{d}/csv", "a.csv", [_row(1, "2025-01-01T00:00:00"), _row(2, "2025-01-01T00:00:00")])
    _write_csv(f"{d}/csv", "b.csv", [("2025-01-01T01:00:00", "70", -74.0, 40.0, 3, 1.0, "N")],
               ("BaseDateTime", "VesselType", "LON", "LAT", "MMSI", "SOG", "VesselName"))
    _write_csv(f"{d}/csv", "c.csv", [(1.0, 4, "71", 40.0, "2025-01-01T02:00:00", -74.0)],
               ("sog", "mmsi", "vesseltype", "lat", "basedatetime", "lon"))
    _write_csv(f"{d}/csv", "only_header.csv", [])
    first = ais.ingest(spark, f"{d}/csv", f"{d}/out", files_per_batch=2)
    assert len(first) == 2 and sum(p["numInputRows"] for p in first) == 8
    got = {r.mmsi: r for r in ais.ingested(spark, f"{d}/out").collect()}
    assert sorted(got) == [1, 2, 3, 4] and {(r.latitude, r.longitude) for r in got.values()} == {(40.0, -74.0)}
    assert got[3].vessel_name == "N" and got[1].vessel_name is None
    _write_csv(f"{d}/csv", "d.csv", [_row(9, "2025-01-02T00:00:00")])
    again = ais.ingest(spark, f"{d}/csv", f"{d}/out")
    assert [p["numInputRows"] for p in again] == [2]           # d.csv: its header and its row
    assert ais.ingest(spark, f"{d}/csv", f"{d}/out") == []     # nothing new, nothing read
    assert sorted(r.mmsi for r in ais.ingested(spark, f"{d}/out").collect()) == [1, 2, 3, 4, 9]


def test_ingest_takes_up_a_failed_run(spark):
    """A file without a needed column stops the run, nothing of it is kept; mended, the next run ingests it."""
    d = tempfile.mkdtemp(prefix="tw-failed-")
    _write_csv(f"{d}/csv", "a.csv", [(1, "2025-01-01T00:00:00")], ("MMSI", "BaseDateTime"))
    with pytest.raises(Exception, match="raw AIS file without"):
        ais.ingest(spark, f"{d}/csv", f"{d}/out")
    assert ais.ingested(spark, f"{d}/out").isEmpty()
    _write_csv(f"{d}/csv", "a.csv", [_row(1, "2025-01-01T00:00:00")])
    assert [r.mmsi for r in ais.ingest_daily_csv(spark, f"{d}/csv", f"{d}/out").collect()] == [1]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "2025-01-01T00:00:00")], "MMSI long, BaseDateTime string")
    with pytest.raises(ValueError, match="vessel_type"):
        ais.normalize_raw(df)


def test_port_csv_with_dms(spark):
    d = tempfile.mkdtemp(prefix="tw-ports-")
    rows = [(1, "A", "US", "74°0'0\"W", "40°42'0\"N", "x"), (2, "B, the \"big\" one", "US", "118°12'0\"W", "33°42'0\"N", "y"),
            (3, "C", "US", "bad", "33°42'0\"N", "z"), (4, "A", "US", "1°0'0\"E", "1°0'0\"S", "dup")]
    _write_csv(d, "ports.csv", rows, [f.name for f in ais.PORTS_SCHEMA.fields])
    good, bad = ais.read_ports_csv(spark, f"{d}/ports.csv")
    g = {r.portName: (r.port_number, round(r.lat_dd, 6), round(r.lon_dd, 6)) for r in good.collect()}
    assert g == {"A": (1, 40.7, -74.0), 'B, the "big" one': (2, 33.7, -118.2)} and bad.count() == 1


def test_pipelines_run_on_loaded_files(spark):
    """L4 and L5 from files alone: pings, ports and weather with a missing cell."""
    fixture = Stages(spark, SF)
    d = tempfile.mkdtemp(prefix="tw-load-")
    fixture.pings.drop("ping_id").withColumn("heading", F.lit(float("nan"))).write.parquet(f"{d}/pings")
    _write_csv(d, "ports.csv", [(r.port_number, r.portName, "US", r.longitude, r.latitude, "x") for r in fixture.ports.collect()],
               [f.name for f in ais.PORTS_SCHEMA.fields])
    pings, (ports, _) = ais.read_ais_parquet(spark, f"{d}/pings"), ais.read_ports_csv(spark, f"{d}/ports.csv")
    marine, wind = fixtures.cell_weather(weather.add_cell_keys(fixture.sea))
    ais.write_weather_payloads(marine.withColumnRenamed("hour", "time"), ["lat_bin", "lon_bin"], ais.MARINE_HOURLY, f"{d}/marine")
    cells = {"lat_bin": T.DoubleType(), "lon_bin": T.DoubleType()}
    loaded = ais.read_weather_payloads(spark, f"{d}/marine", ais.MARINE_HOURLY, cells)
    port = fixtures.port_weather(weather.add_cell_keys(fixture.sea), fixture.ports)
    st = Stages(spark, pings_df=pings, ports_df=ports, weather_df=(loaded, wind, port))
    assert st.port_call_candidates.count() == fixture.port_call_candidates.count() > 0
    got, want = st.enriched_plan(), fixture.enriched_plan()
    assert got.count() == want.count() > 0
    def waves(df):
        return Counter(r.wave_height for r in df.select("wave_height").collect())
    assert waves(got) == waves(want)
    missed = weather.add_cell_keys(fixture.sea).join(marine, ["lat_bin", "lon_bin", "hour"], "left_anti").count()
    assert missed > 0


def test_weather_payload_roundtrip(spark):
    marine, _ = fixtures.cell_weather(weather.add_cell_keys(Stages(spark, SF).sea))
    d = tempfile.mkdtemp(prefix="tw-wx-")
    ais.write_weather_payloads(marine.withColumnRenamed("hour", "time"), ["lat_bin", "lon_bin"], ais.MARINE_HOURLY, d + "/payloads")
    back = ais.read_weather_payloads(spark, d + "/payloads", ais.MARINE_HOURLY, {"lat_bin": T.DoubleType(), "lon_bin": T.DoubleType()})
    cols = ["lat_bin", "lon_bin", "hour"] + ais.MARINE_HOURLY
    assert back.select(*cols).exceptAll(marine.select(*cols)).count() == 0
    assert marine.select(*cols).exceptAll(back.select(*cols)).count() == 0


def test_port_weather_store(spark):
    st = Stages(spark, SF)
    port = fixtures.port_weather(weather.add_cell_keys(st.sea), st.ports)
    d = tempfile.mkdtemp(prefix="tw-pw-")
    weather.store_port_weather(port, f"{d}/p")
    back = spark.read.parquet(f"{d}/p")
    assert back.drop("port_key").count() == port.count()
    assert all("/" not in r.port_key and " " not in r.port_key for r in back.select("port_key").distinct().collect())


def test_stage_tables_are_reused(spark):
    """A second run over a kept folder reads it and does not touch its inputs."""
    d = tempfile.mkdtemp(prefix="tw-keep-")
    first = Stages(spark, SF, keep_dir=d).labeled
    again = Stages(spark, SF, pings_df=Stages(spark, SF).pings.limit(0), keep_dir=d)
    assert again.labeled.count() == first.count() > 0 and again.voyages_base.count() > 0


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_kept_stages_follow_their_input(spark):
    """A changed input or setting, or a run that wrote one of the two tables alone, is not reused."""
    import shutil
    d, keep = tempfile.mkdtemp(prefix="tw-mark-"), tempfile.mkdtemp(prefix="tw-kept-")
    for t in ("events", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", d)
    first = Stages(spark, d, keep_dir=keep)
    n = first.labeled.count()
    assert Stages(spark, d, pings_df=first.pings.limit(0), keep_dir=keep).labeled.count() == n > 0
    assert Stages(spark, d, pings_df=first.pings.limit(0), keep_dir=keep, gap_threshold_h=12.0).labeled.count() == 0
    session.delete_path(spark, f"{first._kept}/labeled")     # as a run that failed between the two
    again = Stages(spark, d, keep_dir=keep)
    assert not session.path_exists(spark, f"{again._kept}/voyages") and again.labeled.count() == n
    spark.read.parquet(f"{SF}/events.parquet").limit(100).coalesce(1).write.mode("overwrite").parquet(f"{d}/events.parquet")
    changed = Stages(spark, d, keep_dir=keep)
    assert changed._kept != first._kept and changed.labeled.count() == 100
