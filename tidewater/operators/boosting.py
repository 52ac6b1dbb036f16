"""Histogram gradient boosting (M2) with missing values and categories as they are.

Squared-loss trees over binned features. A tree level is one aggregation: every
row adds (count, gradient) to the cell (node, feature, bin), in numpy inside the task, so
what is shuffled has at most nodes x features x bins rows a task, whatever the
number of rows. The best split of each node is found over that histogram by
windows; one row a node reaches the driver.

* Numeric bins end at exact order statistics: a value is an edge when the running
  count passes a multiple of rows / ``max_bins`` there. NULL and NaN are the bin -1,
  tried on either side of every split; a node without missing rows sends later ones to
  its larger side.
* Categories are ordered by their mean gradient in the node and split along that order.
  NULL is a category of its own; unseen ones count as NULL. More categories than
  ``max_bins`` are an error.
* Target, gradients and leaf values are integers (millionths), so sums do not depend on
  the order of rows or partitions, and a fit repeats exactly. A sum that would pass 2^63
  (some 10^11 rows) is an overflow error under ANSI mode, not a wrong value.
* Equal gains: the first feature, then the lowest place in its order, then missing left.

A frame without rows, or without a target, gives a model that predicts 0. Trees grow
level by level to ``max_depth``; there is no early stopping.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.ordered import range_running_sum
from tidewater.session import write_stage

SCALE = 1_000_000
DECIMALS = 6  # numeric features are rounded before binning
MISSING = -1
WRITE_EVERY = 10  # trees that every level walks again before predictions are written


@dataclass
class Params:
    rounds: int = 200
    max_depth: int = 5
    step: float = 0.05
    max_bins: int = 255
    min_leaf: int = 20


@dataclass
class Model:
    """``trees``: one map a tree, from node (root 1, children 2n and 2n + 1) to a split or a leaf value."""
    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]]
    categories: list[list[str]]
    base: int = 0
    trees: list[dict[str, dict]] = field(default_factory=list)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _value(col: str) -> str:
    return f"round(nanvl(cast({_q(col)} AS double), NULL), {DECIMALS})"


def bin_edges(df: DataFrame, numeric: Sequence[str], max_bins: int) -> list[list[float]]:
    """Per numeric column, the upper ends of its bins but the last: fewer than ``max_bins``."""
    if not numeric:
        return []
    long = df.select(F.posexplode(F.array(*[F.expr(_value(c)) for c in numeric])).alias("f", "x")).where("x IS NOT NULL")
    counted = long.groupBy("f", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = range_running_sum(counted, ["f"], ["x"], F.col("c"), "cum")
    sizes = ranked.groupBy("f").agg(F.max("cum").alias("n"))
    passed = f"(cum * {max_bins}) div n > ((cum - c) * {max_bins}) div n AND cum < n"
    edges: list[list[float]] = [[] for _ in numeric]
    for r in ranked.join(F.broadcast(sizes), "f").where(passed).select("f", "x").orderBy("f", "x").collect():
        edges[r["f"]].append(r["x"])  # sizes: one row a column; edges: below max_bins a column
    return edges


def categories(df: DataFrame, categorical: Sequence[str], max_bins: int) -> list[list[str]]:
    """Per categorical column its values in order; more than ``max_bins`` raise."""
    out = []
    for c in categorical:
        rows = df.select(F.col(_q(c)).cast("string").alias("v")).where("v IS NOT NULL").distinct() \
            .orderBy("v").limit(max_bins + 1).collect()
        if len(rows) > max_bins:
            raise ValueError(f"{c} has more than {max_bins} categories")
        out.append([r["v"] for r in rows])
    return out


def _binner(model: Model):
    """A function of a row's raw values (numeric ones as `_value` gives them, NaN for none; categories as
    text), a column each, to its bins: an int array of rows x features. Numeric: the ends below the value."""
    def bins(columns: Sequence) -> np.ndarray:
        out = np.empty((len(columns[0]) if len(columns) else 0, len(columns)), dtype=np.int32)
        for i, (x, edges) in enumerate(zip(columns, model.edges)):
            x = np.asarray(x, dtype=np.float64)
            out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(np.array(edges, dtype=np.float64), x, side="left"))
        for i, (v, names) in enumerate(zip(columns[len(model.numeric):], model.categories), len(model.numeric)):
            out[:, i] = pd.Categorical(v, categories=names).codes
        return out
    return bins


def _raw(model: Model) -> list[Column]:
    """What `_binner` takes, once a row."""
    return [F.expr(_value(c)) for c in model.numeric] + [F.col(_q(c)).cast("string") for c in model.categorical]


def binned(df: DataFrame, model: Model, y) -> DataFrame:
    """(bins, y) of every row."""
    bins, width = _binner(model), len(model.numeric) + len(model.categorical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = bins([b.column(i).to_pandas() for i in range(width)]).ravel()
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat)), b.column(width)], ["bins", "y"])
    raw = [c.alias(f"_{i}") for i, c in enumerate(_raw(model))]
    return df.select(*raw, y.alias("y")).mapInArrow(run, "bins array<int>, y long")


def _ends_at(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node at which each row of bins ends."""
    node = np.ones(len(bins), dtype=np.int64)
    for k in sorted(int(k) for k, s in tree.items() if "value" not in s):
        s = tree[str(k)]
        at = np.flatnonzero(node == k)
        b = bins[at, s["feature"]]
        left = np.isin(b, s["left"]) if s["left"] is not None else (b >= (MISSING if s["missing_left"] else 0)) & (b <= s["bin"])
        node[at] = np.where(left, 2 * k, 2 * k + 1)
    return node


def _grown(trees: list[dict], bins: np.ndarray) -> np.ndarray:
    """The sum of the trees' values for each row of bins."""
    total = np.zeros(len(bins), dtype=np.int64)
    for t in trees:
        leaves = {int(k): s["value"] for k, s in t.items() if "value" in s}
        values = np.zeros(max(leaves) + 1, dtype=np.int64)
        values[list(leaves)] = list(leaves.values())
        total += values[_ends_at(t, bins)]
    return total


def _row_bins(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass
class State:
    """Rows (bins, y, pred) as written, and the trees grown since, which ``pred`` lacks."""
    written: DataFrame
    new: list[dict] = field(default_factory=list)

    def write(self) -> State:
        new = self.new

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pred = b.column("pred").to_numpy(zero_copy_only=False) + _grown(new, _row_bins(b))
                yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), pa.array(pred)], ["bins", "y", "pred"])
        return State(write_stage(self.written.mapInArrow(run, "bins array<int>, y long, pred long"), "boosted"))


def _cell_sums(cell: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of ``g`` by cell: ``bincount`` adds doubles, so the high and the low bits are added by themselves."""
    high, low = g >> 26, g & ((1 << 26) - 1)
    return (np.bincount(cell, high, size).astype(np.int64) << 26) + np.bincount(cell, low, size).astype(np.int64)


def histogram(state: State, tree: dict, nodes: Sequence[int], max_bins: int) -> DataFrame:
    """(node, f, bin, n, g) of the rows that have come to one of ``nodes``. A task adds its rows up
    batch by batch and gives at most nodes x features x bins rows, a few times that if its sums get near 2^63."""
    new, wide = state.new, max_bins + 1
    place = np.full(2 * max(nodes) + 2, -1, dtype=np.int64)
    place[list(nodes)] = np.arange(len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = g = None
        bound = 0

        def cells():
            at = np.flatnonzero(n)
            node, f, b = np.unravel_index(at, (len(nodes), features, wide))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(nodes, dtype=np.int32)[node]), pa.array(f.astype(np.int32)), pa.array((b - 1).astype(np.int32)),
                 pa.array(n[at]), pa.array(g[at])], ["node", "f", "bin", "n", "g"])
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _row_bins(batch)
            features = bins.shape[1]
            ends = _ends_at(tree, bins)
            here = place[np.minimum(ends, len(place) - 1)]
            take = here >= 0
            grad = (batch.column("y").to_numpy(zero_copy_only=False) - batch.column("pred").to_numpy(zero_copy_only=False) - _grown(new, bins))[take]
            cell = ((here[take, None] * features + np.arange(features)) * wide + bins[take] + 1)
            top = int(max(grad.max(initial=0), -int(grad.min(initial=0)), 1))
            step = max(1, (1 << 61) // top)  # rows whose gradients are sure to add up below 2^61
            for lo in range(0, len(grad), step):
                part, at = grad[lo:lo + step], cell[lo:lo + step].ravel()
                if n is not None and bound + top * len(part) >= 1 << 62:
                    yield cells()
                    n = None
                if n is None:
                    n, g, bound = np.zeros(len(nodes) * features * wide, np.int64), np.zeros(len(nodes) * features * wide, np.int64), 0
                bound += top * len(part)
                n += np.bincount(at, minlength=len(n))
                g += _cell_sums(at, np.repeat(part, features), len(g))
        if n is not None:
            yield cells()
    found = state.written.mapInArrow(run, "node int, f int, bin int, n long, g long")
    return found.groupBy("node", "f", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


def best_splits(hist: DataFrame, n_numeric: int, min_leaf: int) -> DataFrame:
    """(node, s): the best split of every node that gains by one."""
    numeric = F.col("f") < n_numeric
    cell = Window.partitionBy("node", "f")
    lost = numeric & (F.col("bin") == MISSING)
    h = hist.select("*", F.sum("n").over(cell).alias("all_n"), F.sum("g").over(cell).alias("all_g"),
                    F.sum(F.when(lost, F.col("n")).otherwise(0)).over(cell).alias("nm"),
                    F.sum(F.when(lost, F.col("g")).otherwise(0)).over(cell).alias("gm")).where(~lost)
    key = F.when(numeric, F.col("bin").cast("double")).otherwise(F.col("g") / F.col("n"))
    order = cell.orderBy(key, "bin")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.select("node", "f", "bin", "all_n", "all_g", "nm", "gm", F.row_number().over(order).alias("rk"),
                 F.sum("n").over(upto).alias("cn"), F.sum("g").over(upto).alias("cg"),
                 F.when(~numeric, F.collect_list("bin").over(upto)).alias("left"))
    larger = F.array(F.col("cn") >= F.col("all_n") - F.col("cn"))
    h = h.select("*", F.explode(F.when(F.col("nm") > 0, F.array(F.lit(True), F.lit(False))).otherwise(larger)).alias("ml"))
    h = h.selectExpr("*", "cn + if(ml, nm, 0L) AS nl", "cg + if(ml, gm, 0L) AS gl")
    h = h.selectExpr("*", "all_n - nl AS nr", "cast(gl AS double) AS dl", "cast(all_g - gl AS double) AS dr", "cast(all_g AS double) AS d")
    h = h.where(f"nl >= {min_leaf} AND nr >= {min_leaf} AND nl > 0 AND nr > 0") \
        .selectExpr("*", "dl * dl / nl + dr * dr / nr AS gain").where("gain > d * d / all_n")
    s = F.struct("gain", (-F.col("f")).alias("nf"), (-F.col("rk")).alias("nrk"), "ml", "bin", "nl", "gl", "left")
    return h.groupBy("node").agg(F.max(s).alias("s"))


def _leaf(g: int, n: int, step: float) -> int:
    return int((step * g / n + 0.5) // 1)


def grow(state: State, n: int, g: int, n_numeric: int, p: Params) -> tuple[dict, int]:
    """(tree, sum of gradients after it) for ``n`` rows whose gradients sum to ``g``."""
    tree: dict[str, dict] = {}
    open_nodes = {1: (n, g)}
    rest = 0
    for depth in range(p.max_depth + 1):
        found = {}
        if depth < p.max_depth and open_nodes:
            able = [k for k, (m, _) in open_nodes.items() if m >= 2 * p.min_leaf]
            if able:
                rows = best_splits(histogram(state, tree, able, p.max_bins), n_numeric, p.min_leaf).collect()  # one row a node
                found = {r["node"]: r["s"] for r in rows}
        after = {}
        for k, (m, h) in open_nodes.items():
            if k in found:
                s = found[k]
                tree[str(k)] = {"feature": -s["nf"], "bin": s["bin"], "missing_left": s["ml"],
                                "left": None if s["left"] is None else sorted(s["left"])}
                after[2 * k], after[2 * k + 1] = (s["nl"], s["gl"]), (m - s["nl"], h - s["gl"])
            else:
                v = _leaf(h, m, p.step)
                tree[str(k)] = {"value": v}
                rest += h - m * v
        open_nodes = after
    return tree, rest


def fit(df: DataFrame, target, numeric: Sequence[str], categorical: Sequence[str], params: Params | None = None) -> Model:
    """A model of ``target`` (a column); rows without a target are left out."""
    p = params or Params()
    rows = df.withColumn("_y", target).where("_y IS NOT NULL AND NOT isnan(_y)")
    model = Model(list(numeric), list(categorical), bin_edges(rows, numeric, p.max_bins),
                  categories(rows, categorical, p.max_bins))
    base = write_stage(binned(rows, model, F.expr(f"cast(floor(_y * {SCALE} + 0.5D) AS bigint)")), "binned")
    n, total = base.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return model
    model.base = int((total / n + 0.5) // 1)
    state, g = State(base.withColumn("pred", F.lit(model.base).cast("long"))), total - n * model.base
    for i in range(p.rounds):
        tree, g = grow(state, n, g, len(model.numeric), p)
        model.trees.append(tree)
        state = State(state.written, [*state.new, tree])
        if len(state.new) == WRITE_EVERY and i + 1 < p.rounds:
            state = state.write()
    return model


def predict(model: Model, df: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` with the model's value in the target's unit; any feature can be NULL in a row."""
    if not model.numeric and not model.categorical:
        return df.withColumn(out, F.lit((model.base + sum(t["1"]["value"] for t in model.trees)) / SCALE))
    bins, base, trees = _binner(model), model.base, model.trees

    @F.pandas_udf("long")
    def value(*columns: pd.Series) -> pd.Series:
        return pd.Series(base + _grown(trees, bins(columns)))
    return df.select("*", (value(*_raw(model)).cast("double") / SCALE).alias(out))


def save(spark: SparkSession, model: Model, path: str) -> None:
    """One line of JSON; its size is that of the trees, edges and categories."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model(**json.loads(spark.read.text(path).first()["value"]))
