"""Session helpers.

`get_session` is for tests, the bench and local runs. Library functions never
create a session; they use the one their input DataFrames belong to and only
set runtime SQL options that affect semantics (UTC time zone).
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime options the library relies on. All are session-settable.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime options every query depends on (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "tidewater") -> SparkSession:
    master = master or os.environ.get("TIDEWATER_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster `spark.checkpoint.dir` names a shared (HDFS/object store)
    folder and is used as is. Where it is unset, only a local master gets a
    scratch folder: executors on other machines could not read it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="tidewater-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def write_stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a stage result as Parquet in the shared folder and read it back.

    Cuts the lineage, is computed once (``Dataset.checkpoint`` recomputes an
    uncached input), and a lost executor costs no recomputation of earlier
    stages. With ``root`` the table is kept under that folder by its name and
    read instead of written when it is complete there (S4)."""
    spark = df.sparkSession
    if root is not None:
        path = f"{root.rstrip('/')}/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
    else:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewater/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_mark(spark: SparkSession, paths: list[str], *settings) -> str:
    """A hash of the names, sizes and times of the files under ``paths``, and of settings."""
    marks = [repr(settings)] if settings else []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        marks += [f"{st.getPath()} {st.getLen()} {st.getModificationTime()}" for st in fs.listStatus(p)]
    return hashlib.md5("\n".join(sorted(marks)).encode()).hexdigest()


_COUNTS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def checked_count(df) -> int:
    """Row count used by broadcast size checks, computed once per DataFrame
    object (the same small dimension frame is checked by several joins)."""
    try:
        return _COUNTS[df]
    except (KeyError, TypeError):
        n = df.count()
        try:
            _COUNTS[df] = n
        except TypeError:
            pass
        return n
