"""Source divergence audit over a transducer vocabulary.

Which terms set a source apart, and how far apart are two sources of one language? Terms are
runs of letters and of code points beyond ASCII, A-Z lower-cased. A language keeps the terms
that occur in at least ``MIN_DOCS`` of its documents.

Vocabulary. The kept terms, sorted by their UTF-8 bytes, make a minimal acyclic transducer: an
automaton whose equal suffixes are one state and whose transitions carry the number of
terms that come before, so that a term's path adds up to its place among the sorted terms, its
ordinal. Texts are streamed through it, all words of a batch one byte at a time, and come out
as counts by (source, ordinal); what falls off the automaton is no kept term. Ordinals stand for
terms from there on, and break ties, since they are in the order of the terms.

A vocabulary of at most ``SENT_TERMS`` terms in all goes to the executors as one transducer a
language (some 20 bytes a term). A larger one is cut into transducers of ``SHARD`` consecutive terms;
then the words move to them instead, counted by (source, word) first and dealt by (language,
range of terms, salt), and stream through the transducer of their range. Results are the same.

Scores. With V kept terms, N occurrences of them in a group (a source in a language, or the
language) and smoothed shares p = 1 + floor(10^9 (count + 2) / (N + 2 V)), a term or a pair of
sources is scored by floor((p - q)^2 / (p + q)), in integers. Pairs of sources are asked for, all of
them: they are summed in groups of ``BLOCK`` ordinals and two tiles of about ``TILE`` sources
each, so no group grows with the data; ordinals that neither source has are not stored but
counted.

Null text, lang and source are empty strings. Groups without kept terms are reported, with
shares of zero counts; a language without kept terms has pairs of value 0. A source alone in its
language has no pairs. Repeated rows count as often as they occur; an empty table has no rows.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewater.llm.common import maybe_broadcast, setup, stage_table

MIN_DOCS = 10
TOP = 10
SENT_TERMS = 1 << 20  # of all languages, in transducers sent to the executors
SHARD = 1 << 18       # terms of one transducer where they are not sent
SALTED = 1 << 20      # words that meet one transducer in a task then, about
BLOCK = 4096          # ordinals in a group of the pairs
TILE = 256            # sources in a tile, about
HELD = 1 << 21        # counts that a task holds before it passes them on
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

# each byte as the automaton reads it: 0 for what is between terms
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
for _lo, _hi in ((0, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _READ[_lo:_hi + 1] = 0


def _terms(text: str | Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


class Transducer:
    """A minimal acyclic transducer from sorted byte strings to their ordinals."""

    def __init__(self, words: list[bytes]):
        register: dict[tuple, int] = {}  # (final, label, target, ...) of a finished state to its number

        def finish(node: list) -> int:
            return register.setdefault(tuple(node), len(register))
        path, last = [[0]], b""
        for word in words:
            if last >= word and last:
                raise ValueError("the terms are not sorted or not distinct")
            common = 0
            while common < len(last) and last[common] == word[common]:
                common += 1
            for i in range(len(last), common, -1):  # what the new word leaves can't change any more
                target = finish(path.pop())
                path[-1] += (last[i - 1], target)
            path += [[0] for _ in range(len(word) - common)]
            path[-1][0] = 1
            last = word
        for i in range(len(last), 0, -1):
            target = finish(path.pop())
            path[-1] += (last[i - 1], target)
        self.root = finish(path.pop())
        below, source, label, target, before = [], [], [], [], []  # by state, and by transition
        for state, node in enumerate(register):  # targets have smaller numbers
            n = node[0]
            for i in range(1, len(node), 2):
                source.append(state)
                label.append(node[i])
                target.append(node[i + 1])
                before.append(n)
                n += below[node[i + 1]]
            below.append(n)
        self.size = below[self.root]
        self.final = np.fromiter((node[0] for node in register), bool, len(register))
        key = np.array(source, np.int64) * 256 + np.array(label, np.int64)
        self._table(key, np.array(target, np.int32), np.array(before, np.int32))

    def _table(self, key: np.ndarray, target: np.ndarray, before: np.ndarray) -> None:
        """Transitions by an open hash table on (state, label)."""
        self.bits = max(4, int(2 * len(key)).bit_length())
        size = 1 << self.bits
        self.key, self.target, self.before = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.key[slot] < 0
            place, first = np.unique(np.where(free, slot, size), return_index=True)
            first = first[place < size]  # one of those that want a free slot gets it
            at, who = slot[first], left[first]
            self.key[at], self.target[at], self.before[at] = key[who], target[who], before[who]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Slots of the transitions, -1 where there is none."""
        want = state * 256 + label
        slot = self._slot(want)
        found = self.key[slot]
        out = np.where(found == want, slot, -1)
        left = np.flatnonzero((found != want) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
            found = self.key[slot[left]]
            hit = found == want[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (found >= 0)]
        return out

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, ordinal) of every kept term in ``data``, bytes as ``_READ`` gives them that end with a zero."""
        inside = data != 0
        at = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        start, state, ordinal = at, np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
        starts, ordinals = [], []
        while len(at):
            label = data[at]
            over = label == 0
            if over.any():
                done = over & self.final[state]
                starts.append(start[done])
                ordinals.append(ordinal[done])
            slot = np.full(len(at), -1)
            go = np.flatnonzero(~over)
            slot[go] = self.step(state[go], label[go].astype(np.int64))
            go = np.flatnonzero(slot >= 0)
            slot = slot[go]
            at, start, state, ordinal = at[go] + 1, start[go], self.target[slot].astype(np.int64), ordinal[go] + self.before[slot]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ordinals])


def _joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts as the automaton reads them, where each text ends)."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    return _READ[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([len(r) for r in raw])


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs(lang, source, text)`` without nulls to (lang, term, ordinal) of the kept terms."""
    counted = docs.select("lang", F.explode(F.array_distinct(_terms("text"))).alias("term")).groupBy("lang", "term").count()
    kept = counted.where(F.col("count") >= min_docs).select("lang", "term")
    kept = stage_table(kept.repartitionByRange("lang", "term").withColumn("part", F.spark_partition_id()), "kept")
    # the terms of a language in earlier ranges: one row a range and language
    sizes = kept.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("lang", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term"))
    return stage_table(kept.withColumn("place", place).join(maybe_broadcast(sizes), ["lang", "part"])
                       .select("lang", "term", (F.col("base") + F.col("place") - 1).cast("long").alias("ordinal")), "vocabulary")


def transducers(kept: DataFrame, shard: int) -> DataFrame:
    """(lang, shard, first, made): the transducer of each ``shard`` consecutive terms, pickled."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        words = [t.encode() for t in pdf["term"]]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "shard": pdf["shard"].iloc[:1], "first": pdf["term"].iloc[:1],
                             "made": [pickle.dumps(Transducer(words))]})
    return (kept.withColumn("shard", F.floor(F.col("ordinal") / shard)).groupBy("lang", "shard")
            .applyInPandas(build, "lang string, shard long, first string, made binary"))


def _sent_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept terms' counts, texts streamed through the transducers at hand."""
    made = {r["lang"]: bytes(r["made"]) for r in transducers(kept, SENT_TERMS).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def count(batches):
        machines = {lang: pickle.loads(m) for lang, m in sent.value.items()}
        codes: dict[tuple, int] = {}
        keys, held = [], 0

        def rows():
            if not keys:
                return pd.DataFrame([], columns=["lang", "source", "ordinal", "n"])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            names = list(codes)
            group = (key // SENT_TERMS).tolist()
            keys.clear()
            return pd.DataFrame({"lang": [names[g][0] for g in group], "source": [names[g][1] for g in group],
                                 "ordinal": key % SENT_TERMS, "n": n})
        for batch in batches:
            for lang, own in batch.groupby("lang", sort=False):
                if lang not in machines:
                    continue
                data, end = _joined(own["text"])
                start, ordinal = machines[lang].read(data)
                code = np.array([codes.setdefault((lang, s), len(codes)) for s in own["source"]], np.int64)
                keys.append(code[np.searchsorted(end, start, side="right")] * SENT_TERMS + ordinal)
                held += len(start)
            if held >= HELD:
                yield rows()
                held = 0
        yield rows()
    return docs.select("lang", "source", "text").mapInPandas(count, "lang string, source string, ordinal long, n long")


def _moved_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The same where the words move to the transducer of their range."""
    spark = docs.sparkSession
    made = stage_table(transducers(kept, SHARD), "transducers")
    bounds: dict[str, list] = {}
    for r in made.select("lang", "shard", "first").orderBy("lang", "shard").collect():  # one row for SHARD terms
        bounds.setdefault(r["lang"], []).append(r["first"].encode())
    sent = spark.sparkContext.broadcast(bounds)

    @pandas_udf("long")
    def shard_of(langs: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(sent.value.get(l, []), w.encode("utf-8", "replace")) - 1 for l, w in zip(langs, words)], dtype="int64")
    words = docs.select("lang", "source", F.explode(_terms("text")).alias("word")).groupBy("lang", "source", "word").agg(F.count("*").alias("n"))
    words = stage_table(words.withColumn("shard", shard_of("lang", "word")).where("shard >= 0"), "words")
    salts = (words.groupBy("lang", "shard").agg(F.ceil(F.count("*") / SALTED).alias("salts")))
    made = made.join(salts, ["lang", "shard"])
    salted = words.join(maybe_broadcast(salts), ["lang", "shard"]).withColumn("salt", F.pmod(F.xxhash64("source", "word"), "salts"))
    each = made.select("lang", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "made")

    def count(key, mine: pd.DataFrame, machines: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or machines.empty:
            return pd.DataFrame([], columns=["lang", "source", "ordinal", "n"])
        machine = pickle.loads(machines["made"].iloc[0])
        data, end = _joined(mine["word"])
        start, ordinal = machine.read(data)
        row = np.searchsorted(end, start, side="right")
        return pd.DataFrame({"lang": key[0], "source": mine["source"].to_numpy()[row], "ordinal": ordinal + key[1] * SHARD,
                             "n": mine["n"].to_numpy()[row]})
    by = ["lang", "shard", "salt"]
    return salted.groupBy(by).cogroup(each.groupBy(by)).applyInPandas(count, "lang string, source string, ordinal long, n long")


def _share(count: str, total: str = "total", terms: str = "v") -> Column:
    """p, in integers: decimals up to the division."""
    return F.expr(f"""cast(1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0)))
                      div cast({total} + 2 * {terms} as decimal(20,0)) as long)""")


def _score(p, q) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language with kept terms."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    own = (groups.where("v > 0").join(maybe_broadcast(sizes), "lang")
           .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
           .select("lang", "source", "tile", "tiles", "p0", "v"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / BLOCK))
    # of every source and block, the share of a zero count and the block's width stand at ordinal -1
    marks = (own.withColumn("block", F.explode(blocks))
             .select("lang", "source", "tile", "tiles", "block", F.lit(-1).cast("long").alias("ordinal"), F.col("p0").alias("p"),
                     F.least(F.lit(BLOCK), F.col("v") - F.col("block") * BLOCK).alias("width")))
    cells = (entries.join(maybe_broadcast(own.select("lang", "source", "tile", "tiles")), ["lang", "source"])
             .select("lang", "source", "tile", "tiles", F.floor(F.col("ordinal") / BLOCK).alias("block"), "ordinal", "p",
                     F.lit(0).cast("long").alias("width")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = (marks.unionByName(cells).withColumn("other", other)
             .withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, i, j = pdf["lang"].iloc[0], int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        mark = pdf["ordinal"].to_numpy() < 0
        names, tile = pdf["source"].to_numpy()[mark], pdf["tile"].to_numpy()[mark]
        zero, width = pdf["p"].to_numpy()[mark], int(pdf["width"].max())
        row = pd.Series(np.arange(len(names)), index=names)
        seen, col = np.unique(pdf["ordinal"].to_numpy()[~mark], return_inverse=True)
        share = np.repeat(zero[:, None], len(seen), axis=1)
        share[row[pdf["source"].to_numpy()[~mark]].to_numpy(), col] = pdf["p"].to_numpy()[~mark]
        right = np.flatnonzero(tile == j)
        out = []
        for a in np.flatnonzero(tile == i):
            b = right[right > a] if i == j else right
            if len(b):
                def score(p, q):
                    return (p - q) * (p - q) // (p + q)
                value = score(share[a], share[b]).sum(axis=1) + (width - len(seen)) * score(zero[a], zero[b])
                out.append(pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": value}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["lang", "source", "item", "value"])
    half = (dealt.drop("other", "tiles").groupBy("lang", "block", "ti", "tj")
            .applyInPandas(sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    half = stage_table(half, "pairs")
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of every source in a language, its distance to
    every other one (part ``pair``) and its ``top`` most distinctive terms (part ``term``)."""
    setup(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = vocabulary(docs, min_docs)
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    way = _sent_counts if (kept.limit(SENT_TERMS + 1).count() <= SENT_TERMS) else _moved_counts
    counts = stage_table(way(docs, kept).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("0")))
    groups = stage_table(groups, "groups")

    entries = stage_table(
        counts.join(maybe_broadcast(groups.select("lang", "source", "total", "v")), ["lang", "source"])
        .select("lang", "source", "ordinal", _share("n").alias("p")), "entries")
    pairs = _pair_sums(entries, groups)
    bare = groups.where("v = 0").select("lang", "source")
    bare = (bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
            .select("lang", "source", "item", zero.alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang", "v").agg(F.sum("total").alias("total"))
    whole = whole.join(maybe_broadcast(of_lang), "lang").select(
        "lang", "ordinal", _share("n").alias("q"))
    scored = (entries.join(whole, ["lang", "ordinal"]).where("p > q")
              .select("lang", "source", "ordinal", _score("p", "q").alias("value"), F.floor(F.col("ordinal") / BLOCK).alias("block")))
    order = [F.col("value").desc(), "ordinal"]  # ordinals are in the order of the terms
    near = scored.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "block").orderBy(*order))).where(F.col("r") <= top)
    tops = (near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
            .select("lang", "source", "ordinal", "value", "rank"))
    tops = stage_table(tops, "tops")
    named = kept.join(maybe_broadcast(tops), ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(named)
