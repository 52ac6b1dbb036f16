"""Keyed vessel buffers (ST2, ST3, ST8) and the registry of deltas (ST6)."""

import random
import tempfile
from datetime import timedelta

from conftest import BASE, at, make_pings
from pyspark.sql import functions as F

from tidewater.streaming import keyed
from tidewater.streaming import stream as S
from tidewater.streaming.registry import Registry


def brute_tracks(rows, hours):
    gap, out = timedelta(hours=hours), []
    for v in {r[0] for r in rows}:
        own = sorted((t, sog, i) for m, t, sog, i in rows if m == v)
        cuts = [0] + [i for i in range(1, len(own)) if own[i][0] - own[i - 1][0] > gap] + [len(own)]
        for a, b in zip(cuts, cuts[1:]):
            kept = [p for p in own[a:b] if p[0] >= own[b - 1][0] - gap]
            sog = [p[1] for p in kept if p[1] is not None]
            out.append((v, kept[0][0], kept[-1][0], len(kept), round(sum(sog) / len(sog), 9) if sog else None))
    return sorted(out)


def arrive(spark, base, part, rows, **kw):
    pings = make_pings(spark, [(i, m, t, 1.0, 2.0, sog) for m, t, sog, i in rows]).withColumn("cog", F.lit(0.0)).withColumn("vessel_type", F.lit(70))
    S.write_replay(pings, f"{base}/in/part={part}", **kw)


def run(spark, base, files):
    return keyed.run_tracks(S.read_file_stream(spark, f"{base}/in", files), f"{base}/out", f"{base}/ck", 48.0)


def tracks(spark, base):
    return sorted((r.mmsi, r.first_time, r.last_time, r.n_pings, None if r.mean_sog is None else round(r.mean_sog, 9))
                  for r in spark.read.parquet(f"{base}/out").collect())


def test_tracks_do_not_depend_on_batches_or_restarts(spark):
    """Gaps of exactly 48 h and a microsecond more, missing speeds, one batch or many, a restart between."""
    rng = random.Random(3)
    rows = [(m, at(h + rng.random()), rng.choice([None, 1.0, 2.5, 7.0]), 0) for m in (1, 2, 3)
            for h in sorted(rng.sample(range(0, 900), 25))]
    rows += [(4, at(0), 1.0, 0), (4, at(48), 2.0, 0), (5, at(0), 1.0, 0), (5, at(48) + timedelta(microseconds=2000), None, 0)]
    rows = [(m, t, s, i) for i, (m, t, s, _) in enumerate(sorted(rows, key=lambda r: r[1]))]
    want = brute_tracks(rows, 48)
    for files, cut in ((4, 450), (50, None)):
        base = tempfile.mkdtemp(prefix="tw-keyed-")
        first = [r for r in rows if cut is None or r[1] < at(cut)]
        if cut is not None:
            arrive(spark, base, "a", first)
            run(spark, base, files)
        arrive(spark, base, "b", rows if cut is None else [r for r in rows if r[1] >= at(cut)], heartbeat_after_h=240)
        run(spark, base, files)
        assert tracks(spark, base) == want


def test_late_pings_around_the_cutoff(spark):
    base = tempfile.mkdtemp(prefix="tw-late-")
    rows = [(1, at(0), 1.0, 0), (1, at(100), 3.0, 1), (2, at(90), 2.0, 2)]
    arrive(spark, base, "a", rows)
    assert keyed.rejected(run(spark, base, 8)) == 0
    cutoff = at(52)  # 48 h before the latest ping of all vessels
    late = [(2, cutoff, 4.0, 3), (2, cutoff - timedelta(seconds=1), 9.0, 4), (1, at(60), 5.0, 5)]
    arrive(spark, base, "b", late)
    assert keyed.rejected(run(spark, base, 8)) == 1
    arrive(spark, base, "c", [(S.HEARTBEAT_MMSI, at(500), 0.0, 6)])
    run(spark, base, 8)
    assert tracks(spark, base) == brute_tracks(rows + [late[0], late[2]], 48)
    assert BASE == at(0)


def state(reg):
    return {r.mmsi: (r.x, r.name) for r in reg.read().collect()}


def test_registry_of_deltas(spark):
    """Random upserts, replayed batches, compactions: always the last row of each vessel."""
    rng = random.Random(4)
    reg = Registry(spark, tempfile.mkdtemp(prefix="tw-reg-") + "/r", "mmsi long, x double, name string", compact_every=3, buckets=4)
    assert state(reg) == {}
    want = {}
    for b in range(9):
        rows = {m: (float(b), rng.choice(["a", None])) for m in rng.sample(range(12), rng.randrange(0, 4))}
        df = spark.createDataFrame([(m, *r) for m, r in rows.items()], reg.schema)
        if b in (4, 6):  # a failed attempt at the same batch wrote other rows
            reg.write(spark.createDataFrame([(99, 1.0, "failed")], reg.schema), b)
        reg.write(df, b)
        want |= rows
        assert state(reg) == want, b
        assert len(reg.deltas()) <= 4
    reg.compact(9)
    assert state(reg) == want and reg.deltas() == []
    assert not [n for n in reg._list("delta") if n.startswith("v=")] and len(reg._versions("parts")) == 1


def test_compaction_rewrites_touched_buckets_only(spark):
    reg = Registry(spark, tempfile.mkdtemp(prefix="tw-reg-") + "/r", "mmsi long, x double", buckets=8)
    reg.write(spark.range(200).selectExpr("id as mmsi", "0D as x"), 0)
    reg.compact(1)
    assert {v for _, v in reg._parts(0)} == {0} and len(reg._parts(0)) == 8
    reg.write(spark.createDataFrame([(7, 1.0)], reg.schema), 1)
    assert spark.read.parquet(f"{reg.root}/delta/v=1").count() == 1       # a pass writes what it scored
    reg.compact(2)
    assert sorted(v for _, v in reg._parts(1)) == [0] * 7 + [1]
    got = {r.mmsi: r.x for r in reg.read().collect()}
    assert len(got) == 200 and got[7] == 1.0 and sum(got.values()) == 1.0
    assert len([b for b in reg._list("base/v=0") if b.startswith("bucket=")]) == 7


def test_an_arrival_is_one_element_of_the_state():
    """Whatever pings come at once are one chunk of the list, and the list alone is kept."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def appendList(self, rows):
            self.rows += rows

        def appendValue(self, row):
            self.rows.append(row)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def update(self, row):
            self.rows = [row]

    class Handle:
        def __init__(self):
            self.states, self.timers = [], []

        def getListState(self, name, schema):
            self.states.append(Held())
            return self.states[-1]
        getValueState = getListState

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10 ** 9
    handle, buffer = Handle(), keyed.TrackBuffer(10_000_000)
    buffer.init(handle)
    rows = pd.DataFrame({"us": [k * 1_000_000 for k in range(50)], "sog": [None] + [1.0] * 49, "latitude": 1.0, "longitude": [None] * 49 + [2.0]})
    list(buffer.handleInputRows((7,), iter([rows[:30], rows[30:]]), None))
    list(buffer.handleInputRows((7,), iter([rows[:1]]), None))
    assert len(handle.states) == 1 and len(handle.states[0].rows) == 2 and len(handle.timers) == 1
    out = next(buffer.handleExpiredTimer((7,), Now(), None))
    assert out.iloc[0].tolist() == [7, 39_000_000, 49_000_000, 11, 11, 11.0, 1.0, 2.0] and not handle.states[0].rows
