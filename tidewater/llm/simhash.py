"""SimHash near-duplicates with pigeonring candidate pruning.

A text's fingerprint has bit b set when more than half of its shingle hashes
(XXH64, seed 42) have it set. Two fingerprints link when they differ in at
most ``MAX_BITS`` bits; components of links are the near-duplicate groups.

Pigeonring. The 64 bits are cut into m = MAX_BITS + 1 segments laid in a ring.
If two fingerprints differ in at most t bits, some segment starts a chain whose
first l segments differ in at most l*t/m bits together, for every l. With
m = 5 and t = 4 a chain begins with an equal segment and a next one that differs
in at most one bit. This two-segment prefix is the join key: a fingerprint
lists itself under the exact key and probes the keys with one set bit of the
next segment cleared (of two segments one bit apart exactly one has the bit
set, so each pair meets once per start). Pairs that meet must pass the budgets
of the longer prefixes before the full Hamming check.

Equal fingerprints are collapsed before any key is made, and inside a key only
a spanning star of each component is emitted, so a group of copies never
becomes pairs. The fingerprints of one key (of 5 * 2^26) are compared in one
task, as a numpy vector of 8 bytes each.

Empty and null texts have fingerprint zero and link like any other. Rows
without a doc_id take part and get the component's smallest doc_id, null if
none has one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tidewater.llm.common import components, row_key, setup, stage_table

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

SEGMENTS = MAX_BITS + 1
WIDTHS = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]  # 13 13 13 13 12
SHIFTS = [sum(WIDTHS[:i]) for i in range(SEGMENTS)]
_BLOCK = 1 << 16  # shingles counted at once


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``; A-Z is lower-cased, words
    are separated by ASCII white space. Memory: the text, its words' offsets and one block of hashes."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    k = min(words, len(tokens))
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(tokens) - k + 1]
    ends = np.concatenate((gaps, [len(joined)]))[k - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        s, e = starts[at:at + _BLOCK].tolist(), ends[at:at + _BLOCK].tolist()
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


@pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(text_col: str = "text") -> Column:
    """Column: signed 64-bit fingerprint of ``text_col``."""
    return _fingerprints(F.col(text_col).cast("binary"))


def _segment(fp, i: int):
    i %= SEGMENTS
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): the chain prefixes of each fingerprint; the key's lowest bit marks a probe."""
    fp, rows = F.col("fp"), []
    for i in range(SEGMENTS):
        first, then = _segment(fp, i), _segment(fp, i + 1)
        width = WIDTHS[(i + 1) % SEGMENTS]

        def key(second, probe, i=i, first=first):
            return (F.lit(i << 27) + F.shiftleft(first, 14) + F.shiftleft(second, 1) + F.lit(probe)).cast("long")
        rows.append(F.array(key(then, 0)))
        rows.append(F.filter(F.array(*[
            F.when(then.bitwiseAND(F.lit(1 << b)) != 0, key(then.bitwiseAND(F.lit(~(1 << b))), 1))
            for b in range(width)]), lambda x: x.isNotNull()))
    return nodes.select("fp", F.explode(F.concat(*rows)).alias("key"))


def _chain_masks(start: int) -> list[tuple[int, int]]:
    """(mask, budget) of the chain prefixes of 3 segments and more from ``start``."""
    out = []
    for length in range(3, SEGMENTS + 1):
        mask = 0
        for i in range(start, start + length):
            mask |= ((1 << WIDTHS[i % SEGMENTS]) - 1) << SHIFTS[i % SEGMENTS]
        out.append((mask, length * MAX_BITS // SEGMENTS))
    return out


_MASKS = [[(np.uint64(m), b) for m, b in _chain_masks(s)] for s in range(SEGMENTS)]


def _linked(pivot: np.uint64, others: np.ndarray, masks) -> np.ndarray:
    """Positions of ``others`` that pass every chain budget against ``pivot``; the last budget is the full check."""
    x = others ^ pivot
    at = np.arange(len(others))
    for mask, budget in masks:
        keep = np.bitwise_count(x[at] & mask) <= budget
        at = at[keep]
    return at


def _stars(fps: np.ndarray, masks) -> list[tuple[int, int]]:
    """Spanning stars of the link components among ``fps`` (signed), found breadth first:
    a fingerprint already reached is not compared again."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        comp, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            at = _linked(queue.pop(), left, masks)
            if len(at):
                found = left[at]
                comp.extend(found)
                queue.extend(found)
                left = np.delete(left, at)
        if len(comp) > 1:
            c = np.array(comp, np.uint64).view(np.int64)
            root = int(c.min())
            out += [(int(v), root) for v in c if v != root]
    return out


def _link_runs(batches):
    """Rows sorted by key: emit the stars of each run that holds a listed (not only probing) fingerprint."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

    def done(keys, fps):
        run = keys >> 1
        cut = np.flatnonzero(np.diff(run)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(run)]))
        # sorted by key, so a run's listed rows come first
        use = (hi - lo > 1) & (keys[lo] & 1 == 0) if len(run) else np.zeros(0, bool)
        edges = []
        for i, j in zip(lo[use], hi[use]):
            edges += _stars(fps[i:j], _MASKS[int(run[i]) >> 26])
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    waiting: list = []  # batches of the run that is still open
    for batch in batches:
        k, f = (np.asarray(c) for c in (batch.column(0), batch.column(1)))
        if not len(k):
            continue
        waiting.append((k, f))
        if waiting[0][0][0] >> 1 == k[-1] >> 1:
            continue
        keys, fps = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting])
        last = int(np.searchsorted(keys >> 1, keys[-1] >> 1))
        yield done(keys[:last], fps[:last])
        waiting = [(keys[last:], fps[last:])]
    if waiting:
        yield done(np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting]))


def links(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)``, distinct: edges (a, b) that connect exactly the fingerprints
    reachable from each other by links."""
    keyed = _keys(nodes).select("key", "fp")
    run = F.shiftright("key", 1)
    dealt = keyed.repartition(run).sortWithinPartitions("key")
    return dealt.mapInArrow(_link_runs, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (its `row_key`), ``fp``, and ``rep``, the
    smallest `row_key` of its near-duplicate component."""
    spark = setup(docs.sparkSession)
    t = stage_table(docs.select(row_key(id_col, text_col).alias("row"), fingerprints(text_col).alias("fp")),
                    "fingerprints")
    nodes = stage_table(t.groupBy("fp").agg(F.min("row").alias("least")), "nodes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows of 16 bytes
    try:
        edges = stage_table(links(nodes.select("fp")), "links")
    finally:
        setup(spark)
    roots = components(edges)
    named = stage_table(nodes.join(roots, nodes.fp == roots.node, "left")
                        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    reps = named.groupBy("root").agg(F.min("least").alias("rep"))
    return t.join(named.join(reps, "root").select("fp", "rep"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    def id_of(row):
        return F.when(~F.col(f"{row}.no_id"), F.col(f"{row}.id"))
    return groups(docs, id_col, text_col).select(
        id_of("row").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_of("rep").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id (of rows equal
    in id and text, one); all columns of ``docs``."""
    keep = groups(docs, id_col, text_col).where("row = rep").select(F.col("row").alias("_row_key")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(whole.alias("_whole"), row_key(id_col, text_col).alias("_row_key")).join(keep, "_row_key")
    one = kept.groupBy("_row_key").agg(F.min("_whole").alias("_whole"))
    return one.select("_whole.*")
