"""Plan checks and the driver contract."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from tidewater.operators.voyages import VOYAGE_COLUMNS

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
PLAN_QUERIES = ["j1_point_in_radius", "j2_degree_buffer_left", "a1_port_visits", "j3_current_port",
                "w10_voyage_numbering", "p9_training_set", "j9_cell_weather", "a6_describe_label",
                "a13_speed_by_sea_state", "w9_hours_in_port", "a16_correlations"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.columns == VOYAGE_COLUMNS
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cross_join_or_python_eval(spark, name):
    plan = _plan(entry_mod.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name,columns", [("p1_cargo_filter", 4), ("p2_slow_pings", 4), ("a5_vessel_type_counts", 1), ("f7_floor_hour", 2),
                                          ("f3_mercator", 3), ("a1_port_visits", 4)])
def test_queries_scan_the_source_with_their_columns_only(spark, name, columns):
    """No copy of the pings: the scan is the source table, pruned to what the query needs."""
    plan = _plan(entry_mod.queries()[name](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "events.parquet" in line]
    assert len(scans) == 1
    read = scans[0].split("ReadSchema: struct<")[1].rstrip(">").split(",")
    assert len(read) <= columns


def test_stage_writes_have_no_cross_join_or_python(spark, monkeypatch):
    """The plans that are written, before they become scans of a written table."""
    from tidewater import session
    from tidewater.operators import ordered
    from tidewater.plans import pipeline
    seen = {}

    def noting(df, name, root=None):
        seen[name] = _plan(df)
        return session.write_stage(df, name, root)
    monkeypatch.setattr(pipeline, "write_stage", noting)
    monkeypatch.setattr(ordered, "write_stage", noting)
    for name in ("l1_voyages", "a6_describe_label", "a10_speed_by_quintile", "p9_training_set"):
        entry_mod.queries()[name](spark, SF)
    assert {"visits", "voyages", "sea", "features", "ranges", "enriched"} <= set(seen)
    for name, plan in seen.items():
        assert "FileScan parquet" in plan
        for bad in FORBIDDEN:
            assert bad not in plan, f"{name}: {bad}"


def test_slow_filter_reaches_the_join(spark):
    from tidewater.plans.pipeline import Stages
    plan = _plan(Stages(spark, SF).candidates)
    assert plan.index("Filter") > plan.index("BroadcastHashJoin")  # below the join


def test_label_windows_are_bucketed(spark):
    """Ping-level windows in the labelling pass are partitioned by (mmsi, bucket)."""
    from tidewater.plans.pipeline import Stages
    st = Stages(spark, SF)
    from tidewater.operators import voyages
    lab = voyages.label_pings(st.pings, st.visits, st.voyages_base)
    plan = lab._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "last(" in line:
            part = line.split("[")[-1]
            assert "_b#" in line, line


def test_sketches_of_days_merge_and_counters_come_with_the_write(spark, tmp_path):
    """A2: many vessels over days, unions within the tolerance; A7-A9: an observation equals a scan of its own."""
    from tidewater.operators import profile, spread
    rows = spark.range(30000).select(
        (F.col("id") % 9000).alias("mmsi"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("portName"),
        F.timestamp_seconds(F.lit(1735689600) + (F.col("id") % 10) * 86400).cast("timestamp_ntz").alias("base_date_time"))
    spread.port_day_sketches(rows).write.partitionBy("day").parquet(f"{tmp_path}/s")
    kept = spark.read.schema("portName string, sketch binary, day date").parquet(f"{tmp_path}/s")
    near = {r.portName: r.vessels for r in spread.vessels_between(kept, F.lit("2025-01-03").cast("date"), F.lit("2025-01-05").cast("date")).collect()}
    exact = rows.where(F.dayofmonth("base_date_time").between(3, 5)).groupBy("portName").agg(F.count_distinct("mmsi").alias("n"))
    checked = [(r.portName, r.n, r.t) for r in exact.withColumn("t", spread.tolerance(F.col("n"))).collect()]
    assert len(checked) == 2 and all(abs(near[p] - n) <= t and t < 0.1 * n for p, n, t in checked)
    assert spread.vessels_between(kept, F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")).count() == 0

    holes = rows.withColumn("mmsi", F.when(F.col("mmsi") % 4 != 0, F.col("mmsi")))
    watched, found = profile.observed(holes, ["mmsi", "portName"])
    watched.write.parquet(f"{tmp_path}/w")
    got = {r.column_name: (r.nulls, round(r.null_rate, 9), round(r.coverage, 9)) for r in profile.observed_nulls(spark, found, ["mmsi", "portName"]).collect()}
    want = {r.column_name: (r.nulls, round(r.null_rate, 9), round(1 - r.null_rate, 9)) for r in profile.null_counts(holes, ["mmsi", "portName"]).collect()}
    assert got == want and got["mmsi"][0] == 7500 * 1
