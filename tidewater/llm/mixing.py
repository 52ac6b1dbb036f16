"""Mixing sources to target weights by hash thresholds.

Every document has a slot, 20 bits of its id's MD5. A source's share is a number
of whole passes over the source plus the documents whose slot lies below a
threshold. The threshold comes from histograms: sizes are summed by source and
coarse bucket (the slot's upper 10 bits), the bucket in which the budget runs out
is found, and only that bucket is refined by the lower 10 bits. No document is
sorted or shuffled; the histograms have at most 1,024 rows per source.

A threshold stops before the first slot that does not fit, which with a long
document can leave much of the budget. The same search then runs again over the
documents still out that fit into the rest, ``ROUNDS`` times; each round leaves
less than the smallest size it met at its threshold.

Null and empty texts have size 0 and are never taken. Null is a source of its
own, the last. Rows that share an id share a slot, so they are taken together.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import maybe_broadcast, setup, stage_table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
ROUNDS = 4
BITS = 10  # of each histogram level
SLOTS = 1 << (2 * BITS)


def size_of(text_col: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def slot_of(id_col: str = "doc_id"):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 5), 16, 10).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)``, a row per source: adds ``target``.

    Shares follow the weights; a target stops at ``max_repeat`` times its source,
    and the excess is shared again. Sources reach that limit in the order of
    size by weight, so one pass in this order finds all that do. The windows run
    over the list of sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = (t.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(rest)))
    t = t.withColumn("level", F.col("left").cast("double") / F.col("w_left"))
    t = t.withColumn("free", F.col("cap").cast("double") / F.col("w") > F.col("level"))
    # the first source below its limit fixes the level of all that follow
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "source"))).over(every)
    target = F.when(F.col("free"), F.col("w") * level).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def _boundary(hist: DataFrame, step: str) -> DataFrame:
    """``hist(source, d, base, step, s)``: the first step at which base plus the running
    sum passes d (null if none does), and the sum before it."""
    run = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy(step))
    return (hist.withColumn("c", run).groupBy("source")
            .agg(F.min(F.when(F.col("c") > F.col("d"), F.col(step))).alias("at"),
                 F.coalesce(F.max(F.when(F.col("c") <= F.col("d"), F.col("c"))), F.min("base")).alias("sum")))



def _round(light: DataFrame, state: DataFrame) -> DataFrame:
    """One threshold search. ``state(source, ..., d, cuts)``: ``d`` words are still
    wanted; appends (d, slot threshold) to ``cuts`` and takes off what it takes."""
    side = maybe_broadcast(state.select(F.col("source").alias("_s"), "d", "cuts"))
    out = (light.join(side, F.col("source").eqNullSafe(F.col("_s")))
           .where("size > 0 and size <= d and not exists(cuts, c -> size <= c.d and slot < c.slot)")
           .select("source", "size", "slot", "d"))
    coarse = F.shiftright("slot", BITS)
    h1 = (out.groupBy("source", coarse.alias("b")).agg(F.sum("size").alias("s"), F.first("d").alias("d"))
          .withColumn("base", F.lit(0).cast("long")))
    b1 = stage_table(_boundary(h1, "b"), "coarse")
    side = maybe_broadcast(b1.where("at is not null").select(F.col("source").alias("_s"), "at", F.col("sum").alias("base")))
    h2 = (out.join(side, F.col("source").eqNullSafe(F.col("_s")) & (coarse == F.col("at")))
          .groupBy("source", "slot").agg(F.sum("size").alias("s"), F.first("d").alias("d"), F.first("base").alias("base")))
    b2 = _boundary(h2, "slot").withColumnsRenamed({"at": "at2", "sum": "sum2", "source": "source2"})
    found = (b1.join(b2, F.col("source").eqNullSafe(F.col("source2")), "left")
             .select(F.col("source").alias("_s"), F.coalesce("at2", F.lit(SLOTS)).alias("slot"),
                     F.coalesce("sum2", "sum").alias("got")))
    joined = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
    cut = F.struct("d", F.coalesce("slot", F.lit(0)).alias("slot"))
    return stage_table(joined.select(
        "source", "source_size", "target", "passes",
        (F.col("d") - F.coalesce("got", F.lit(0))).alias("d"),
        F.concat("cuts", F.array(cut)).alias("cuts")), "state")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(light, state): the documents' (doc_id, source, size, slot), and per source its size,
    target, whole passes and the cuts that select the documents of the last, partial pass."""
    setup(docs.sparkSession)
    light = stage_table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    size_of(text_col).alias("size"), slot_of(id_col).alias("slot")), "sizes")
    t = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0,
                    F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEAT))).otherwise(0).cast("long")
    state = t.withColumn("passes", passes)
    state = stage_table(state.withColumn("d", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
                        .withColumn("cuts", F.expr("cast(array() as array<struct<d:bigint, slot:int>>)")), "state")
    for _ in range(ROUNDS):
        state = _round(light, state)
    return light, state


def _apply(rows: DataFrame, state: DataFrame, source: str, size: str, slot: str, taken: str) -> DataFrame:
    """``rows`` joined with their source's state, and the words taken of each."""
    side = maybe_broadcast(state.select(F.col("source").alias("_s"), "source_size", "target", "passes", "cuts"))
    extra = F.exists("cuts", lambda c: (F.col(size) <= c["d"]) & (F.col(slot) < c["slot"]) & (F.col(size) > 0))
    return (rows.join(side, F.col(source).eqNullSafe(F.col("_s")))
            .withColumn(taken, F.col(size) * (F.col("passes") + extra.cast("long"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    light, state = plan(docs, id_col, text_col, source_col)
    return (_apply(light, state, "source", "size", "slot", "taken")
            .select("doc_id", "size", "source_size", "target", "taken"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with all their columns and ``taken`` (a column of that
    name is replaced): words to read, a multiple of the document's size."""
    _, state = plan(docs, id_col, text_col, source_col)
    cols = [c for c in docs.columns if c.lower() != "taken"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_whole"),
                        F.col(source_col).alias("source"), size_of(text_col).alias("size"), slot_of(id_col).alias("slot"))
    return (_apply(whole, state, "source", "size", "slot", "_taken").where("_taken > 0")
            .select("_whole.*", F.col("_taken").alias("taken")))
