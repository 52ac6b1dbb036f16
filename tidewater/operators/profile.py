"""Profiling and analysis tables.

Scalar statistics that parameterize a later step (bin edges, min/max) are
computed by a one-row aggregation and embedded as literals; the rows
themselves never leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.quantiles import exact_percentiles

SAMPLE_MULTIPLIER = 1103515245
SAMPLE_MODULUS = 2 ** 31


def group_sizes(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A5: value_counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, exact linear quartiles, max."""
    extra = [F.count(col).alias("count"), F.avg(col).alias("mean"),
             F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")]
    return exact_percentiles(df, col, [0.25, 0.5, 0.75], names=["p25", "p50", "p75"],
                             extra_aggs=extra)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count and rate per column, one pass, unpivoted."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.agg(*aggs)
    stacked = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in cols])).alias("_s"))
    return stacked.select(
        F.col("_s.column_name").alias("column_name"), F.col("_s.nulls").cast("long").alias("nulls"),
        (F.col("_s.nulls") / F.col("_n")).alias("null_rate"))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of non-null values per column (one row)."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage") for c in cols])


def observed(df: DataFrame, cols: Sequence[str], name: str = "profile") -> tuple[DataFrame, Observation]:
    """A7-A9 without a scan of their own: ``df`` and an Observation that counts its rows and the nulls of
    ``cols`` while ``df`` is written (or read to the end) by whatever action comes next."""
    found = Observation(name)
    return df.observe(found, F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]), found


def observed_nulls(spark: SparkSession, found: Observation, cols: Sequence[str]) -> DataFrame:
    """column_name, nulls, null_rate and coverage of an observation that has been made: one row a column."""
    m = found.get
    rate = [(c, m[c], m[c] / m["_n"] if m["_n"] else None) for c in cols]
    return spark.createDataFrame([(c, n, r, None if r is None else 1 - r) for c, n, r in rate],
                                 "column_name string, nulls long, null_rate double, coverage double")


def quantile_bins(df: DataFrame, col: str, out: str, q: int = 5) -> DataFrame:
    """pd.qcut(q, labels=False, duplicates='drop') as a column.

    Edges are exact linear percentiles (one aggregation, q+1 numbers brought
    to the driver), duplicates merged; bins are right-closed with the lowest
    edge included."""
    probs = [i / q for i in range(q + 1)]
    row = exact_percentiles(df.select(col), col, probs).first()
    edges = sorted(set(v for v in row if v is not None)) if row is not None else []
    if not edges:
        return df.withColumn(out, F.lit(None).cast("int"))
    inner = F.array(*[F.lit(float(e)) for e in edges[1:]]) if len(edges) > 1 else F.array().cast("array<double>")
    x = F.col(col)
    idx = F.size(F.filter(inner, lambda e: e < x))
    return df.withColumn(out, F.when(x.isNotNull() & (x >= edges[0]) & (x <= edges[-1]), idx).cast("int"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, chosen by a seeded multiplicative hash of the key
    (same order in Spark and DuckDB); a top-k, so no global sort."""
    h = ((F.pmod(F.col(key), F.lit(SAMPLE_MODULUS)) * SAMPLE_MULTIPLIER + seed) % SAMPLE_MODULUS)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def sample_hash(key: Column, seed: int = 42) -> Column:
    return (F.pmod(key, F.lit(SAMPLE_MODULUS)) * SAMPLE_MULTIPLIER + seed) % SAMPLE_MODULUS


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """O2: top n by ``by`` descending, tie broken by ``tie`` (TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)


def equal_width_hist(df: DataFrame, col: str, bins: int = 40, split: str | None = None) -> DataFrame:
    """Equal-width histogram (last bin closed) and density n / (N * width).

    ``split`` makes one density histogram per value of a flag column."""
    x = F.col(col)
    stats = df.where(x.isNotNull()).agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = stats["lo"], stats["hi"]
    keys = [split] if split else []
    if lo is None:
        return df.sparkSession.createDataFrame([], _hist_schema(keys, df))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    d = df.where(x.isNotNull()).withColumn("bin", b)
    counts = d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.select(
        *keys, "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        F.col("count").cast("long").alias("count"),
        (F.col("count") / (F.sum("count").over(w) * F.lit(width))).alias("density"),
    )


def _hist_schema(keys, df):
    from pyspark.sql import types as T
    fields = [df.schema[k] for k in keys] + [
        T.StructField("bin", T.IntegerType()), T.StructField("bin_lo", T.DoubleType()),
        T.StructField("count", T.LongType()), T.StructField("density", T.DoubleType())]
    return T.StructType(fields)


def correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """A16 + O3: pairwise-complete Pearson r of each feature with each
    target, one aggregation, unpivoted and ranked by |r| against the first
    target."""
    aggs = [F.corr(F.col(f).cast("double"), F.col(t).cast("double")).alias(f"{f}__{t}")
            for f in features for t in targets]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{t}").alias(f"corr_{t}") for t in targets])
        for f in features]))
    long = wide.select(rows.alias("_r")).select("_r.*")
    w = Window.orderBy(F.abs(F.col(f"corr_{targets[0]}")).desc_nulls_last(), F.col("feature"))
    return long.withColumn("abs_rank", F.row_number().over(w).cast("long"))
