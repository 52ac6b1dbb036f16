"""Cross-site boilerplate removal by distinct-site spread.

A line (trimmed, one hash) is boilerplate when it stands on at least ``MIN_SITES``
distinct sites. Sites per line are counted by HyperLogLog sketches that merge in
a grouped aggregation, map side first, so a line that stands in a third of all
documents is one small sketch per task. Lines whose estimate is within ``MARGIN``
of the threshold get exact distinct counts; the decision equals exact counting
everywhere unless an estimate is off by more than the margin (over ten standard
errors).

Exact copies of a text count once, as one document of its least site: copying a
document does not make its lines boilerplate. Boilerplate lines go from every
document, however much of it they are; a document of nothing else is left empty.

Null texts stay null, empty texts empty; empty lines are never boilerplate; a
null site is a site of its own. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import maybe_broadcast, row_key, setup, stage_table

MIN_SITES = 10
MARGIN = 0.25
LG_K = 10  # sketch of 2^10 registers: standard error about 2.6 %


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trim(line):
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(text):
    """Hash of each line, null for empty lines."""
    return F.transform(_lines(text), lambda x: F.when(_trim(x) != "", F.xxhash64(_trim(x))))


def occurrences(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(line, site): the distinct lines of every distinct text, with the text's least site."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    texts = (docs.select(F.xxhash64(text_col).alias("t"), site.alias("site"),
                         F.array_distinct(F.filter(_hashes(F.col(text_col)), lambda h: h.isNotNull())).alias("h"))
             .groupBy("t").agg(F.min_by("h", "site").alias("h"), F.min("site").alias("site")))
    return texts.select(F.explode("h").alias("line"), "site")


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text",
                min_sites: int = MIN_SITES) -> DataFrame:
    """(line,): hashes of the lines that stand on at least ``min_sites`` sites."""
    occ = stage_table(occurrences(docs, site_col, text_col), "lines")
    spread = stage_table(occ.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
                         .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
                         .where(F.col("sites") >= min_sites * (1 - MARGIN)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("line")
    exact = (occ.join(maybe_broadcast(near), "line").distinct().groupBy("line").count()
             .where(F.col("count") >= min_sites).select("line"))
    return stage_table(sure.unionByName(exact), "boilerplate")


def marks(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, found): for every document with boilerplate, its key and its boilerplate hashes."""
    occ = docs.select(row_key(id_col, text_col).alias("row"), F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("line"))
    return (occ.where("line is not null").join(maybe_broadcast(lines), "line")
            .groupBy("row").agg(F.collect_set("line").alias("found")))


def remove(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
           min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and two columns more:
    ``_n_lines`` and ``_n_removed``."""
    setup(docs.sparkSession)
    found = marks(docs, boilerplate(docs, site_col, text_col, min_sites), id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = (docs.select(whole.alias("_whole"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_row"))
            .join(found.withColumnRenamed("row", "_row"), "_row", "left"))
    # null-safe: a line without a hash is empty and stays
    left = F.filter(_lines(F.col("_text")), lambda x: ~F.array_contains("found", F.xxhash64(_trim(x))) | (_trim(x) == ""))
    n = F.size(_lines(F.col("_text")))
    marked = F.col("found").isNotNull()
    rows = rows.withColumn("_left", F.when(marked, left))
    cols = [F.when(marked, F.array_join("_left", "\n")).otherwise(F.col("_text")).alias(c) if c == text_col
            else F.col("_whole").getField(c).alias(c) for c in docs.columns]
    return rows.select(*cols, n.cast("long").alias("_n_lines"),
                       F.when(marked, n - F.size("_left")).otherwise(0).cast("long").alias("_n_removed"))


def dedup_lines(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines taken out; the same rows and columns."""
    return remove(docs, site_col, id_col, text_col).drop("_n_lines", "_n_removed")
