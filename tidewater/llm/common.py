"""Helpers the operators of this subpackage share.

Everything here works on narrow frames (keys, hashes, counts), never on whole
texts, except where a caller passes texts itself.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir, prepare

# Rows of one Arrow batch handed to Python. Texts are unbounded, so batches
# are small; the default of 10,000 rows could hold gigabytes.
ARROW_ROWS = 256

#: A side with at most this many narrow rows (some tens of bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()  # applications whose executors have this package


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, so that the
    functions run there whatever their Python path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)


def setup(spark: SparkSession) -> SparkSession:
    prepare(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind a size check; beyond it the join shuffles (AQE splits skew)."""
    return F.broadcast(df) if small(df, rows) else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row, without nulls: its id and its text's hash. Rows without
    an id sort last; only rows equal in both share a key."""
    return F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, any order, loops allowed).

    Alternates large-star and small-star steps until the edge set is stable;
    every step is two narrow shuffles and its result is written to the shared
    folder. Returns ``(node, root)`` for nodes with a link to another node,
    ``root`` the smallest node of the component; an empty frame without links.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stage_table(e, "edges")
    mark = None
    while True:
        new = e.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")).first()
        if mark == tuple(new) or new["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(new)
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = stage_table(both.join(least, "u").where("v > u")
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its smaller neighbours link to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = stage_table(e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def neighbours(light: DataFrame, order: list[str]) -> DataFrame:
    """Previous and next row of each row in the total ascending order of ``order``.

    ``light`` must be narrow. Rows are range-partitioned, neighbours inside a
    partition come from a window over it, and across partitions from one row
    per partition. Adds ``prev`` and ``next``, structs of ``order`` (null at
    the ends). Rows with equal keys follow each other in any order.
    """
    key = F.struct(*order)
    t = stage_table(light.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_pid").orderBy(*order)
    ends = t.groupBy("_pid").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    over = Window.orderBy("_pid")  # one row per partition
    ends = ends.select("_pid", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    return (t.withColumn("_p", F.lag(key).over(w)).withColumn("_n", F.lead(key).over(w))
            .join(F.broadcast(ends), "_pid")
            .withColumn("prev", F.coalesce("_p", "before")).withColumn("next", F.coalesce("_n", "after"))
            .drop("_pid", "_p", "_n", "before", "after"))
