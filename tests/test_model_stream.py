"""Model (M1-M6, S10) and streaming (ST1-ST7, S7, S9) on the sf0.001 fixture."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewater.operators import features as feat
from tidewater.operators import ordered
from tidewater.plans import catalog, training
from tidewater.plans.pipeline import Stages
from tidewater.streaming import stream as S

SF = "/root/testdata/sf0.001"
SMALL_GBT = dict(maxIter=5, maxDepth=3, stepSize=0.1, seed=42)


@pytest.fixture(scope="module")
def stages(spark):
    return Stages(spark, SF)


@pytest.fixture(scope="module")
def trained(stages):
    f = stages.features
    split = catalog.voyage_split(f)
    return f, split, training.train(f, split, SMALL_GBT)


def test_split_has_no_voyage_in_both_sets(trained):
    f, split, _ = trained
    n = split.count()
    k = split.where("is_test").count()
    assert k == -(-n * 2 // 10)  # ceil(0.2 n)
    assert split.select("voyage_id").distinct().count() == n


def test_predictions_non_negative_and_metrics(trained):
    f, split, res = trained
    p = training.predict(res.model, f)
    assert p.where(F.col("predicted_remaining_hours") < 0).count() == 0
    assert p.where(F.col("predicted_remaining_hours").isNull()).count() == 0
    assert set(res.metrics) == {"mae", "rmse", "r2"} and res.metrics["rmse"] >= res.metrics["mae"] >= 0


def test_model_save_load_roundtrip(trained, spark):
    f, _, res = trained
    d = tempfile.mkdtemp(prefix="tw-model-")
    training.save(res.model, d + "/m")
    m2 = training.load(d + "/m")
    a = training.predict(res.model, f).select("ping_id", "predicted_remaining_hours")
    b = training.predict(m2, f).select("ping_id", "predicted_remaining_hours")
    assert a.exceptAll(b).count() == 0


def test_permutation_importance_runs(trained):
    f, _, res = trained
    imp = training.permutation_importance(training.model_scorer(res.model), f.limit(200), repeats=2)
    rows = imp.collect()
    assert {r.feature for r in rows} == set(training.MODEL_NUMERIC + feat.CATEGORICAL_FEATURES)


def test_messages_roundtrip_and_bad_json(spark, stages):
    msgs = S.to_messages(stages.pings)
    bad = spark.createDataFrame([("{not json",), ('{"mmsi": 0, "base_date_time": "2024-01-01T00:00:00"}',)], "value string")
    parsed = S.parse_messages(msgs.select("value").unionByName(bad))
    expect = stages.pings.where("mmsi <> 0")
    got = parsed.select(*expect.columns)
    assert got.exceptAll(expect).count() == 0 and expect.exceptAll(got).count() == 0


def test_stream_visits_equal_batch(spark, stages):
    base = tempfile.mkdtemp(prefix="tw-st7-")
    S.write_replay(stages.pings, f"{base}/in", heartbeat_after_h=48.0)
    msgs = S.read_file_stream(spark, f"{base}/in", 4)
    q = (S.stream_port_visits(msgs, stages.ports).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    batch = stages.visits.where("mmsi <> 0")
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_many_categories_fit(spark):
    """More ports than any fixed number of bins."""
    n = 4000
    rows = [(i, float(i % 7), 1.0, 2.0, 0.0, float(i % 50), 60.0, 0.5, f"p{i % 1500}", f"q{i % 40}", float(i % 50)) for i in range(n)]
    cols = ["ping_id", *training.MODEL_NUMERIC, *feat.CATEGORICAL_FEATURES, feat.LABEL]
    model = training.fit(spark.createDataFrame(rows, cols), dict(maxIter=2, maxDepth=2, stepSize=0.1, seed=1))
    assert training.predict(model, spark.createDataFrame(rows[:5], cols)).count() == 5


def test_bad_messages_are_counted_not_fatal(spark):
    good = '{"ping_id": 1, "mmsi": 5, "base_date_time": "2024-01-01T00:00:00"}'
    bad = ["{oops", '{"ping_id": 2, "mmsi": 5, "base_date_time": "yesterday"}', '{"ping_id": 3, "mmsi": 5}', '{"mmsi": 0, "base_date_time": "2024-01-01T00:00:00"}']
    raw = spark.createDataFrame([(m,) for m in [good, *bad]], "value string")
    assert {r.status: r.n for r in S.message_quality(raw).collect()} == {"ok": 1, "bad json": 1, "bad time": 2, "no vessel": 1}
    assert [r.ping_id for r in S.parse_messages(raw).collect()] == [1]


def test_predictor_foreach_batch(spark, stages, trained):
    _, _, res = trained
    base = tempfile.mkdtemp(prefix="tw-pred-")
    S.write_replay(stages.pings, f"{base}/in")
    pred = S.Predictor(spark, stages.ports, training.model_scorer(res.model), f"{base}/state", buffer_hours=192.0)
    assert pred.registry().count() == 0            # empty with schema before the first pass
    q = pred.start(S.read_file_stream(spark, f"{base}/in", files_per_trigger=12), f"{base}/ck")
    q.awaitTermination()
    reg = pred.registry()
    assert reg.columns == S.REGISTRY_COLUMNS
    rows = reg.collect()
    assert len(rows) > 0
    assert all(r.predicted_remaining_hours >= 0 and r.origin_port and r.destination_port for r in rows)
    assert len({r.mmsi for r in rows}) == len(rows)
    assert len(S._versions(spark, pred.meta_path)) <= 2


class Counting(S.Predictor):
    """Records what each slice sees instead of scoring it."""

    def prediction_pass(self, buffer):
        seen = {}
        for r in buffer.select("slice", "ping_id").collect():
            seen.setdefault(r.slice, set()).add(r.ping_id)
        self.seen = getattr(self, "seen", []) + [seen[k] for k in sorted(seen)]
        return self.spark.createDataFrame([], S.REGISTRY_SCHEMA + ", slice bigint")


def _batch(spark, hours, first_id):
    from conftest import at, make_pings
    return make_pings(spark, [(first_id + i, 7, at(h), 0.0, 0.0, 5.0) for i, h in enumerate(hours)]) \
        .withColumn("cog", F.lit(0.0)).withColumn("vessel_type", F.lit(70))


def test_every_ping_reaches_a_pass(spark, stages):
    """A batch that spans many buffers, late pings, and retention (ST2, ST3, ST8)."""
    base = tempfile.mkdtemp(prefix="tw-ret-")
    pred = Counting(spark, stages.ports, None, f"{base}/state", buffer_hours=48.0)
    pred.process_batch(_batch(spark, range(0, 300, 5), 0), 0)
    assert set().union(*pred.seen) == set(range(60))
    assert all(len(s) <= 10 for s in pred.seen)          # 48 h hold 10 pings
    pred.seen = []
    pred.process_batch(_batch(spark, [310, 290, 100], 100), 1)   # the last one is older than the buffer
    assert 100 in pred.seen[-1] and 101 in pred.seen[-1] and 102 not in set().union(*pred.seen)
    pred.process_batch(_batch(spark, [600], 200), 2)
    pred.process_batch(_batch(spark, [601], 300), 3)
    left = {n for n, _ in S._children(spark, pred.buffer_path)}
    assert left == {"batch=2", "batch=3"}                   # evicted batches are gone
    pred.seen = []
    pred.process_batch(_batch(spark, [601], 300), 3)        # a replayed batch sees what it saw
    assert pred.seen == [{200, 300}]


def test_passes_wait_for_enough_messages(spark, stages):
    """ST4: with a count trigger a pass runs when that many messages have come, and at the end."""
    base = tempfile.mkdtemp(prefix="tw-st4-")
    pred = Counting(spark, stages.ports, None, f"{base}/state", buffer_hours=48.0, pass_every=5)
    for i in range(4):
        pred.process_batch(_batch(spark, [3 * i, 3 * i + 1], 10 * i), i)
    assert pred.seen == [{0, 1, 10, 11, 20, 21}]
    pred.flush()
    assert pred.seen[1] == {0, 1, 10, 11, 20, 21, 30, 31}


def test_failed_pass_is_repeated(spark, stages):
    """ST9: a pass that fails leaves no version; the replayed batch starts from the one before."""
    base = tempfile.mkdtemp(prefix="tw-st9-")
    pred = Counting(spark, stages.ports, None, f"{base}/state", buffer_hours=48.0)
    pred.process_batch(_batch(spark, [1], 0), 0)
    ok = Counting.prediction_pass
    try:
        Counting.prediction_pass = lambda self, b: (_ for _ in ()).throw(RuntimeError("pass"))
        with pytest.raises(RuntimeError):
            pred.process_batch(_batch(spark, [2], 10), 1)
    finally:
        Counting.prediction_pass = ok
    assert S._versions(spark, pred.meta_path) == [0]
    pred.process_batch(_batch(spark, [2], 10), 1)
    assert pred.seen[-1] == {0, 10}


def test_permutation_importance_moves_places_only(spark, monkeypatch):
    """The copies of the rows are never written, and a permutation cut by its hash is the whole one."""
    import hashlib
    rng = random.Random(4)
    rows = [(i * 7 % 101, rng.uniform(1, 90), None if i % 9 == 0 else rng.uniform(1, 20), rng.uniform(0, 9)) for i in range(101)]
    df = spark.createDataFrame(rows, "ping_id long, remaining_dist_nm double, sog_roll_6h double, remaining_travel_hours double")
    sizes = []
    for module in (training, ordered):
        def write(frame, name, *more, _write=module.write_stage):
            out = _write(frame, name, *more)
            sizes.append(out.count())
            return out
        monkeypatch.setattr(module, "write_stage", write)
    monkeypatch.setattr(training, "CUT_ROWS", 5, raising=False)
    feats = ["remaining_dist_nm", "sog_roll_6h"]
    got = {r.feature: (r.importance_mean, r.importance_std) for r in
           training.permutation_importance(training.speed_scorer, df, feats, 2).collect()}
    assert max(sizes) <= len(rows)

    def r2(rows):
        y = [r[3] for r in rows]
        p = [max(r[1] / r[2], 0) if r[2] else 0 for r in rows]
        return 1 - sum((a - b) ** 2 for a, b in zip(p, y)) / (sum(v * v for v in y) - sum(y) ** 2 / len(y))
    rows.sort()
    for k, f in enumerate(feats, 1):
        drops = []
        for r in range(2):
            order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{rows[i][0]}:{f}:{r}".encode()).hexdigest())
            mixed = [list(x) for x in rows]
            for donor, i in enumerate(order):
                mixed[i][k] = rows[donor][k]
            drops.append(r2(rows) - r2(mixed))
        mean = sum(drops) / 2
        assert got[f] == pytest.approx((mean, (sum((d - mean) ** 2 for d in drops) / 2) ** 0.5))


def test_permutation_importance_broadcasts_no_copies(spark):
    """Spark takes the (feature, repeat) copies for as small as the rows they come from; none may pass the driver."""
    rng = random.Random(5)
    rows = [(i, rng.uniform(1, 90), rng.uniform(1, 20), rng.uniform(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "ping_id long, remaining_dist_nm double, sog_roll_6h double, remaining_travel_hours double")
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept, got = spark.conf.get(key), {}
    try:
        for limit in ("-1", "10m"):
            spark.conf.set(key, limit)
            imp = training.permutation_importance(training.speed_scorer, df, ["remaining_dist_nm", "sog_roll_6h"], 2)
            got[limit] = sorted(imp.collect())
        assert "Broadcast" not in imp._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, kept)
    for a, b in zip(got["-1"], got["10m"], strict=True):
        assert a.feature == b.feature and a[1:] == pytest.approx(b[1:])
