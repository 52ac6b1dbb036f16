"""Labels, rolling means and voyages with one window a vessel, against the bucketed forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.operators import features as feat
from tidewater.operators import ordered, voyages
from tidewater.plans.pipeline import Stages

H = 3_600_000_000
BASE = datetime.datetime(2024, 1, 1)


def _plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _rows(df):
    return sorted(map(repr, df.collect()))


def _inputs(spark):
    at = lambda h: BASE + datetime.timedelta(hours=h)
    visits = [(m, f"P{(m + i) % 3}", at(40 * i + m), at(40 * i + m + 12)) for m in range(1, 5) for i in range(6)]
    visits += [(1, "Q", at(41), at(41)), (1, "Q", at(41), at(50))]
    pings = [(m * 1000 + i, m, at(2.5 * i - 5)) for m in range(1, 5) for i in range(110)]
    pings += [(1, 1, at(41)), (2, 1, at(41)), (3, None, at(41)), (4, None, None), (5, 2, None), (6, 9, at(3))]
    p = spark.createDataFrame(pings, "ping_id long, mmsi long, base_date_time timestamp_ntz")
    v = spark.createDataFrame(visits, "mmsi long, portName string, entry_time timestamp_ntz, exit_time timestamp_ntz")
    return p, v


def test_labels_and_voyages_are_those_of_the_buckets(spark):
    p, v = _inputs(spark)
    voy = voyages.voyages_from_visits(v)
    assert _rows(voy) == _rows(voyages.voyages_from_visits(v, ordered.DAY_US))
    assert _rows(voyages.label_pings(p, v, voy)) == _rows(voyages.label_pings(p, v, voy, bucket_us=ordered.DAY_US))
    # a vessel with many pings brings the buckets back, with the same rows
    assert _rows(voyages.label_pings(p, v, voy, hot_bucket_rows=20)) == _rows(voyages.label_pings(p, v, voy))


def test_labels_shuffle_pings_once(spark):
    st = Stages(spark, "/root/testdata/sf0.001")
    st.visits, st.voyages_base
    assert _plan(voyages.label_pings(st.pings, st.visits, st.voyages_base)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("bucket", [ordered.DAY_US, 2 * H])
def test_rolling_means_are_those_of_the_buckets(spark, bucket):
    p, _ = _inputs(spark)
    df = p.withColumn("sog", F.when(F.col("ping_id") % 7 != 0, F.col("ping_id") % 11 / 3.0)) \
        .unionByName(p.where("ping_id < 1050").withColumn("sog", F.lit(2.25)))  # peers, repeated ids
    assert _rows(feat.rolling_sog(df, bucket_us=None)) == _rows(feat.rolling_sog(df, bucket_us=bucket).select(*df.columns, "sog_roll_6h", "sog_roll_24h"))


def test_features_are_those_of_the_buckets_with_one_exchange(spark):
    st = Stages(spark, "/root/testdata/sf0.001")
    cols = [c for c in feat.FEATURE_COLUMNS if c not in ("hist_avg_sog", "sog_deviation")]
    rounded = [F.round("hist_avg_sog", 9).alias("h"), F.round("sog_deviation", 9).alias("d")]
    got, was = st.features_plan, feat.build_features(st.sea, st.ports)
    assert _rows(got.select("ping_id", *cols, *rounded)) == _rows(was.select("ping_id", *cols, *rounded))
    assert _plan(Stages(spark, "/root/testdata/sf0.001").features_plan).count("Exchange hashpartitioning") == 1


def test_heavy_key(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(None,)] * 7 + [(2,)], "k long")
    assert [ordered.has_heavy_key(df, "k", n) for n in (4, 6, 7)] == [True, True, False]
