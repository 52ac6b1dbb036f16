"""Histogram boosting (M2) against a plain-Python form, tree by tree."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import boosting as B

SCHEMA = "id long, a double, b double, c string, y double"


def table(n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = None if r.random() < 0.2 else round(r.gauss(0, 3), 3)
        b = None if r.random() < 0.05 else (float("nan") if r.random() < 0.02 else float(r.randrange(6)))
        c = None if r.random() < 0.1 else r.choice(["x", "y", "z", "it's"])
        y = (5.0 if a is None else abs(a)) + {"x": 4.0, "y": -2.0}.get(c, 0.0) + r.random()
        rows.append((i, a, b, c, y))
    return rows


def clean(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def brute_edges(values, max_bins):
    values = sorted(v for v in map(clean, values) if v is not None)
    n, out, seen = len(values), [], 0
    for v in sorted(set(values)):
        before, seen = seen, seen + values.count(v)
        if seen * max_bins // n > before * max_bins // n and seen < n:
            out.append(v)
    return out


def brute_bins(rows, edges, cats):
    def bin_of(x, e):
        x = clean(x)
        return -1 if x is None else sum(k < x for k in e)
    return [[bin_of(r[1], edges[0]), bin_of(r[2], edges[1]), cats.index(r[3]) if r[3] in cats else -1] for r in rows]


def brute_split(bins, g, rows, min_leaf):
    n, total = len(rows), sum(g[i] for i in rows)
    best = None
    for f in range(3):
        cells = {}
        for i in rows:
            c = cells.setdefault(bins[i][f], [0, 0])
            c[0] += 1
            c[1] += g[i]
        lost = cells.pop(-1, [0, 0]) if f < 2 else [0, 0]
        order = sorted(cells, key=(lambda k: k) if f < 2 else (lambda k: (cells[k][1] / cells[k][0], k)))
        for rk in range(len(order)):
            left = order[:rk + 1]
            cn, cg = sum(cells[k][0] for k in left), sum(cells[k][1] for k in left)
            for ml in ([True, False] if lost[0] else [cn >= n - cn]):
                nl, gl = (cn + lost[0], cg + lost[1]) if ml else (cn, cg)
                if min(nl, n - nl) < max(min_leaf, 1):
                    continue
                gain = float(gl) * float(gl) / nl + float(total - gl) * float(total - gl) / (n - nl)
                if gain > float(total) * float(total) / n and (best is None or (gain, -f, -rk, ml) > best[0]):
                    goes = set(left) | ({-1} if ml and f < 2 else set())
                    # numeric bins between those of the node's rows go by the threshold
                    best = ((gain, -f, -rk, ml), f, goes if f == 2 else (max(left), ml))
    return best


def brute_fit(rows, p):
    edges = [brute_edges([r[k] for r in rows], p.max_bins) for k in (1, 2)]
    cats = sorted({r[3] for r in rows if r[3] is not None})
    bins = brute_bins(rows, edges, cats)
    y = [math.floor(r[4] * B.SCALE + 0.5) for r in rows]
    base = math.floor(sum(y) / len(y) + 0.5)
    pred, history = [base] * len(rows), []
    for _ in range(p.rounds):
        g = [a - b for a, b in zip(y, pred)]
        level = [list(range(len(rows)))]
        for depth in range(p.max_depth + 1):
            below = []
            for part in level:
                s = brute_split(bins, g, part, p.min_leaf) if depth < p.max_depth else None
                if s is None:
                    v = math.floor(p.step * sum(g[i] for i in part) / len(part) + 0.5)
                    for i in part:
                        pred[i] += v
                    continue
                _, f, how = s

                def left(k):
                    return k in how if f == 2 else (how[1] if k == -1 else k <= how[0])
                below += [[i for i in part if left(bins[i][f])], [i for i in part if not left(bins[i][f])]]
            level = below
        history.append(list(pred))
    return edges, cats, history


@pytest.fixture(scope="module")
def fitted(spark):
    rows = table()
    p = B.Params(rounds=6, max_depth=3, step=0.3, max_bins=16, min_leaf=10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, p, df, B.fit(df, F.col("y"), ["a", "b"], ["c"], p)


def test_every_tree_equals_the_plain_form(fitted):
    rows, p, df, model = fitted
    edges, cats, history = brute_fit(rows, p)
    assert model.edges == edges and model.categories == [cats] and len(model.trees) == p.rounds
    for k in (1, 2, 6):
        part = B.Model(model.numeric, model.categorical, model.edges, model.categories, model.base, model.trees[:k])
        got = {r["id"]: round(r["prediction"] * B.SCALE) for r in B.predict(part, df).collect()}
        assert got == dict(enumerate(history[k - 1])), k


def test_missing_values_choose_a_side_and_help(fitted):
    rows, _, df, model = fitted
    splits = [s for t in model.trees for s in t.values() if "feature" in s]
    assert {s["missing_left"] for s in splits if s["feature"] == 0} == {True, False}
    assert any(s["left"] and -1 in s["left"] for s in splits)
    err = B.predict(model, df).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    mean = sum(r[4] for r in rows) / len(rows)
    assert err < 0.2 * sum((r[4] - mean) ** 2 for r in rows) / len(rows)


def test_partitions_do_not_change_the_model(fitted):
    _, p, df, model = fitted
    again = B.fit(df.repartition(3, "c"), F.col("y"), ["a", "b"], ["c"], p)
    assert again == model


def test_save_and_load(fitted, spark, tmp_path):
    _, _, _, model = fitted
    B.save(spark, model, f"{tmp_path}/m")
    assert B.load(spark, f"{tmp_path}/m") == model


def test_edge_cases(spark):
    df = spark.createDataFrame(table(40), SCHEMA)
    p = B.Params(rounds=2, max_depth=2, max_bins=8, min_leaf=5)
    empty = B.fit(df.limit(0), F.col("y"), ["a"], ["c"], p)
    assert {r["prediction"] for r in B.predict(empty, df).collect()} == {0.0}
    # no value at all, one constant target, rows without a target
    flat = df.withColumn("a", F.lit(None).cast("double")).withColumn("y", F.when(F.col("id") > 3, 2.0))
    m = B.fit(flat, F.col("y"), ["a"], [], p)
    assert {r["prediction"] for r in B.predict(m, flat).collect()} == {2.0}
    # an unseen category goes where NULL goes; a column named bins stays
    m = B.fit(df, F.col("y"), ["a", "b"], ["c"], p)
    odd = df.withColumn("bins", F.lit(1))
    new = B.predict(m, odd.withColumn("c", F.lit("never seen"))).select("id", "prediction", "bins")
    null = B.predict(m, odd.withColumn("c", F.lit(None).cast("string"))).select("id", "prediction", "bins")
    assert new.exceptAll(null).count() == 0
    with pytest.raises(ValueError):
        B.categories(df, ["c"], 2)


def test_rows_are_binned_and_added_up_in_batches(spark, monkeypatch):
    """No edge is compared and no feature exploded row by row in SQL; large gradients add up exactly."""
    import numpy as np
    plans = []

    def write(frame, name, *more, _write=B.write_stage):
        plans.append((name, frame._jdf.queryExecution().optimizedPlan().toString()))
        return _write(frame, name, *more)
    monkeypatch.setattr(B, "write_stage", write)
    df = spark.createDataFrame([(float(i % 37), "ab"[i % 2], float(i)) for i in range(300)], "x double, c string, y double")
    model = B.fit(df, F.col("y"), ["x"], ["c"], B.Params(rounds=1, max_depth=2, max_bins=8, min_leaf=5))
    assert [p for name, p in plans if name == "binned"] and all("lambdafunction" not in p for _, p in plans)
    assert "lambdafunction" not in B.predict(model, df)._jdf.queryExecution().optimizedPlan().toString()
    g = np.array([(1 << 52) + 1, 1, -(1 << 55) - 3, 7], dtype=np.int64)
    assert B._cell_sums(np.array([0, 0, 1, 1]), g, 3).tolist() == [(1 << 52) + 2, -(1 << 55) + 4, 0]
