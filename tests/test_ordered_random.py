"""Bucketed ordered helpers and the one-pass labels vs plain pandas on random data.

Small bucket widths force every cross-bucket path (head/tail carry rows,
halo rows, prefix offsets)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import ordered, voyages

H = 3_600_000_000


def _random_series(seed, keys=4, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        t = np.sort(rng.integers(0, 200, size=n)) * (H // 4)     # quarter-hour grid, ties possible
        for i, ti in enumerate(t):
            rows.append((int(k), int(ti), int(i), float(rng.integers(0, 20))))
    return pd.DataFrame(rows, columns=["k", "t", "o", "v"])


@pytest.mark.parametrize("seed", [1, 2])
def test_lag_next_cumsum_match_pandas(spark, seed):
    pdf = _random_series(seed)
    df = spark.createDataFrame(pdf)
    B = 3 * H
    got = ordered.bucketed_lag(df, ["k"], "t", B, "prev", payload=F.col("v"), order=["o"])
    got = ordered.bucketed_next(got, ["k"], "t", ["o"], B, F.col("v"), "nxt")
    got = ordered.bucketed_cumsum(got, ["k"], "t", B, F.col("v"), "cum", order=["o"])
    g = got.toPandas().sort_values(["k", "t", "o"]).reset_index(drop=True)
    e = pdf.sort_values(["k", "t", "o"]).reset_index(drop=True)
    e["prev"] = e.groupby("k")["v"].shift(1)
    e["nxt"] = e.groupby("k")["v"].shift(-1)
    e["cum"] = e.groupby("k")["v"].cumsum()
    for c in ["prev", "nxt", "cum"]:
        assert np.allclose(g[c].fillna(-1).values, e[c].fillna(-1).values), c


def test_global_index_matches_sorted_rank(spark):
    pdf = _random_series(5, keys=6, n=40)
    df = spark.createDataFrame(pdf)
    got = ordered.global_index(df, "k", "t", ["o"], 5 * H, "idx").toPandas()
    got = got.sort_values(["k", "t", "o"]).reset_index(drop=True)
    assert list(got["idx"]) == list(range(len(got)))


def _reference_labels(pings, visits):
    """Brute-force reading of the reference rules (merge_asof semantics with
    the (entry, exit, port) tie order)."""
    out = {}
    for _, p in pings.iterrows():
        vv = visits[visits.mmsi == p.mmsi]
        b = vv[vv.entry_time <= p.ts].sort_values(["entry_time", "exit_time", "portName"])
        cur = b.iloc[-1] if len(b) else None
        current = cur.portName if cur is not None and p.ts <= cur.exit_time else None
        o = vv[vv.exit_time <= p.ts].sort_values(["exit_time", "entry_time", "portName"])
        d = vv[vv.entry_time >= p.ts].sort_values(["entry_time", "exit_time", "portName"])
        origin = o.iloc[-1].portName if len(o) and current is None else None
        dest = d.iloc[0].portName if len(d) and current is None else None
        out[p.ping_id] = (current, origin, dest)
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_labels_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = pd.Timestamp("2025-01-01")
    vis, pings = [], []
    for m in range(1, 4):
        t = 0.0
        for _ in range(6):
            t += float(rng.integers(1, 40))
            dur = float(rng.integers(0, 10))
            port = f"P{int(rng.integers(0, 3))}"
            vis.append((m, port, base + pd.Timedelta(hours=t), base + pd.Timedelta(hours=t + dur)))
            if rng.random() < 0.3:   # an overlapping visit with a tied entry
                vis.append((m, f"Q{int(rng.integers(0, 2))}", base + pd.Timedelta(hours=t),
                            base + pd.Timedelta(hours=t + float(rng.integers(0, 12)))))
            t += dur
        for i, h in enumerate(sorted(rng.integers(0, int(t) + 10, size=40))):
            pings.append((m * 1000 + i, m, base + pd.Timedelta(hours=int(h))))
    vdf = pd.DataFrame(vis, columns=["mmsi", "portName", "entry_time", "exit_time"]).drop_duplicates()
    pdf = pd.DataFrame(pings, columns=["ping_id", "mmsi", "ts"])
    sv = spark.createDataFrame(vdf.assign(duration_hours=0.0)).select(
        "mmsi", "portName", F.col("entry_time").cast("timestamp_ntz").alias("entry_time"),
        F.col("exit_time").cast("timestamp_ntz").alias("exit_time"), "duration_hours")
    sp = spark.createDataFrame(pdf).select("ping_id", "mmsi", F.col("ts").cast("timestamp_ntz").alias("base_date_time"))
    for bucket in (ordered.DAY_US, 2 * H):
        lab = voyages.label_pings(sp, sv, None, bucket_us=bucket).toPandas()
        got = {r.ping_id: (r.current_port, r.origin_port, r.destination_port) for r in lab.itertuples()}
        exp = _reference_labels(pdf, vdf)
        assert got == exp, bucket


@pytest.mark.parametrize("bucket", [H // 2, 6 * H, 30 * H])
def test_prefix_rolling_mean_matches_range_frame(spark, bucket):
    pdf = _random_series(11)
    pdf.loc[pdf.index % 13 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    wins = {"r6": 6 * H, "r2": 2 * H}
    got = ordered.rolling_range_mean(df, ["k"], "t", "v", wins, bucket).toPandas()
    got = got.sort_values(["k", "t", "o"]).reset_index(drop=True)
    for name, w in wins.items():
        exp = [pdf[(pdf.k == r.k) & (pdf.t > r.t - w) & (pdf.t <= r.t)].v.mean() for _, r in got.iterrows()]
        assert np.allclose(got[name].values.astype(float), np.array(exp, dtype=float), equal_nan=True), name


def test_rolling_means_do_not_depend_on_the_buckets(spark):
    from tidewater.operators import features as feat
    from tidewater.plans.pipeline import Stages
    sea = Stages(spark, "/root/testdata/sf0.001").sea
    t = sea.withColumn("_t", (F.unix_micros(F.col("base_date_time").cast("timestamp"))))
    widths = ordered.hot_key_widths(t, "mmsi", "_t", ordered.DAY_US, 2)
    cols = ["ping_id", "sog_roll_6h", "sog_roll_24h"]
    whole = sorted(map(tuple, feat.rolling_sog(sea).select(*cols).collect()))
    assert widths.count() > 0
    assert sorted(map(tuple, feat.rolling_sog(sea, bucket_us=H).select(*cols).collect())) == whole
    assert sorted(map(tuple, feat.rolling_sog(sea, widths=widths).select(*cols).collect())) == whole


def test_percentiles_with_ties_over_many_rows(spark):
    """Over 10^7 rows, a third of them one value, a skewed scale and NULLs."""
    from tidewater.operators.quantiles import exact_percentiles
    n = 12_000_003
    x = "case when id % 3 = 0 then 5.0D when id % 1000 = 1 then null else pow(1.00003D, id % 100003) end"
    df = spark.range(n).selectExpr("id % 2 as g", f"{x} as x")
    got = exact_percentiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    i = np.arange(n)
    v = np.where(i % 3 == 0, 5.0, np.where(i % 1000 == 1, np.nan, np.power(1.00003, (i % 100003).astype(float))))
    want = np.nanquantile(v, [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose(list(got), want, rtol=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_grouped_percentiles_match_pandas(spark, seed):
    from tidewater.operators.quantiles import exact_percentiles
    pdf = _random_series(seed, keys=7, n=31)
    pdf.loc[pdf.k == 3, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = exact_percentiles(df, "v", [0.1, 0.5], ["a", "b"], ["k"], [F.count(F.lit(1)).alias("n")]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.n[k] == len(g)
        assert np.allclose([got.a[k], got.b[k]], [g.v.quantile(0.1), g.v.quantile(0.5)], equal_nan=True)
    one = exact_percentiles(df.where("false"), "v", [0.5], ["m"]).collect()
    assert len(one) == 1 and one[0].m is None
