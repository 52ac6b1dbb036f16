"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows
of the test items, each document scanned once.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and characters
beyond ASCII. A window is ``WINDOW`` consecutive words of an item; an item of
fewer words, but not none, is one window. Word boundaries are part of the
patterns, so a window never matches inside longer words.

The windows are the query set. They are collected in blocks of at most about
``BLOCK_CHARS`` pattern characters (a bigger benchmark makes more blocks, not
bigger ones) and broadcast; a worker keeps at most ``CACHED`` automata. The
documents are scanned in place, without a shuffle.

Null and empty texts have no words. An item without an id is named ``null``;
items with the same id are one item.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewater.llm.common import fresh, setup

WINDOW = 10
BLOCK_CHARS = 2_000_000
CACHED = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
RESULT = ("struct<n_words:bigint, n_hit:bigint, items:array<string>, "
          "spans:array<struct<start:bigint, stop:bigint>>>")

_automata: OrderedDict = OrderedDict()  # per worker: block id -> automaton


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows of the items, space-joined, and the item ids that have them."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    last = F.greatest(F.size("w") - size, F.lit(0))
    cut = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return (benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words.alias("w"))
            .where(F.size("w") > 0).select("item", F.explode(F.array_distinct(cut)).alias("window"))
            .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")))


def _automaton(block: tuple[str, object]):
    """The block's automaton, built once per worker and kept while it is among the last used."""
    key, sent = block
    if key not in _automata:
        a = ahocorasick.Automaton()
        for window, items in sent.value:
            # one character per UTF-8 byte, as the documents are scanned
            a.add_word(f" {window} ".encode().decode("latin-1"), (len(window.encode()) + 2, window.count(" ") + 1, items))
        a.make_automaton()
        _automata[key] = a
        while len(_automata) > CACHED:
            _automata.popitem(last=False)
    _automata.move_to_end(key)
    return _automata[key]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets in the original text of word ranges (ascending, disjoint)."""
    out, at = [], iter(ranges)
    lo, hi = next(at)
    for i, m in enumerate(_WORD.finditer(text.decode("utf-8", "replace"))):
        if i == lo:
            start = m.start()
        if i == hi - 1:
            out.append({"start": start, "stop": m.end()})
            lo, hi = next(at, (-1, -1))
    return out


def scan(texts: list[bytes | None], blocks: list[tuple[str, object]]) -> list[dict]:
    """Hits of every text, block by block, so that one automaton is in use at a time."""
    plain = []
    for t in texts:
        words = (t or b"").translate(_TABLE).split()
        plain.append((len(words), f" {b' '.join(words).decode('latin-1')} " if words else ""))
    found: list[tuple[list, set]] = [([], set()) for _ in texts]
    for block in blocks:
        a = _automaton(block)
        for (_, s), (ranges, items) in zip(plain, found):
            gaps = None
            for end, (chars, words, ids) in a.iter(s):
                if gaps is None:  # the k-th space stands before word k
                    gaps = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 32)
                first = int(np.searchsorted(gaps, end - chars + 1))
                if ranges and ranges[-1][0] <= first <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], first + words))
                else:
                    ranges.append((first, first + words))
                items.update(ids)
    out = []
    for t, (n, _), (ranges, items) in zip(texts, plain, found):
        ranges = _merged(ranges)
        out.append({"n_words": n, "n_hit": sum(hi - lo for lo, hi in ranges), "items": sorted(items),
                    "spans": _spans(t, ranges) if ranges else []})
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits",
         size: int = WINDOW) -> DataFrame:
    """``docs`` with the column ``out``: n_words, n_hit, items (ids, sorted as strings)
    and spans (code point ranges of hit words in the original text)."""
    spark = setup(docs.sparkSession)
    win = windows(benchmark, size=size)
    chars = win.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    blocks = []
    for i in range(n):
        part = win.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i)
        sent = spark.sparkContext.broadcast([(r["window"], list(r["items"])) for r in part.toLocalIterator()])
        blocks.append((f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}", sent))

    @pandas_udf(RESULT)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scan(list(texts), blocks), columns=["n_words", "n_hit", "items", "spans"])
    return docs.withColumn(out, hits(F.col(text_col).cast("binary")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a window occurs."""
    hits = fresh(docs, "hits")
    return find(docs, benchmark, text_col, hits).where(F.col(hits).n_hit == 0).drop(hits)
