"""Exact linear-interpolation percentiles for groups of any size.

Equal values are first counted (map-side combined), then the distinct values
get their running counts from a range-partitioned running sum, and the order
statistics around rank p * (n - 1) are the least values whose running count
passes that rank: ``lo + (hi - lo) * frac``, as DuckDB ``quantile_cont`` and
pandas ``quantile`` interpolate. No task holds more than one range partition,
no sketch is involved, and ties, skew or the number of rows change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ordered import range_running_sum


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float],
                      names: Sequence[str] | None = None, group_cols: Sequence[str] = (),
                      extra_aggs: Sequence[Column] = (),
                      positions: Sequence[int] | None = None) -> DataFrame:
    """One row per group: group columns, ``extra_aggs`` (over all rows), and
    one column per probability (``names`` or p_<i>); NULLs are not counted.

    With ``positions`` (0-based ranks, one per probability) the exact order
    statistic at that rank is returned instead of an interpolated value."""
    g = list(group_cols)
    names = list(names) if names else [f"p_{i}" for i in range(len(probs))]
    values = df.select(*g, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counted = values.groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ranked = range_running_sum(counted, g, ["_x"], F.col("_c"), "_cum")
    sizes = ranked.groupBy(*g).agg(F.max("_cum").alias("_n"))

    def at(rank):
        """The least value whose running count passes ``rank``."""
        return F.min(F.when(F.col("_cum") > rank, F.col("_x")))
    if g:
        rows = ranked.join(sizes, g)
        n = F.col("_n")
    else:
        total = sizes.first()["_n"]
        rows, n = ranked, F.lit(total).cast("long")
    aggs, vals = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (n - 1) if positions is None else F.lit(float(positions[i]))
        k = F.floor(pos)
        aggs += [at(k).alias(f"_a{i}"), at(k + 1).alias(f"_b{i}"), F.first(pos - k).alias(f"_f{i}")]
        a, b, f = (F.col(f"_{x}{i}") for x in "abf")
        vals.append(F.when(f == 0, a).otherwise(a + (b - a) * f).alias(names[i]))
    wide = rows.groupBy(*g).agg(*aggs).select(*g, *vals)
    if g:
        keep = df.groupBy(*g).agg(*(extra_aggs or [F.count(F.lit(1)).alias("_rows")]))
        return (keep if extra_aggs else keep.drop("_rows")).join(wide, g, "left")
    # one group: its values are scalars
    found = wide.first()
    lits = [F.lit(found[c] if found is not None else None).cast("double").alias(c) for c in names]
    if extra_aggs:
        return df.agg(*extra_aggs).select("*", *lits)
    return df.agg(F.count(F.lit(1)).alias("_rows")).select(*lits)
