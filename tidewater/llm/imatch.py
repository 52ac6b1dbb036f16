"""I-Match document fingerprints over randomised lexicon subsets.

A document's terms are its distinct lower-cased words. The lexicon keeps the terms
whose document frequency, as a share of all documents, lies in the band
[``LOW``, ``HIGH``] (an inverse-document-frequency band). It is cut at random, by
term hash, into ``SUBSETS`` disjoint parts, and each part into nested thinner ones:
level l keeps about 2^-l of its terms. An entry of a fingerprint is the hash of the
sorted terms that a document has in one (level, part). A document uses the levels
at which a part holds 1/4 to 1/2 and 1/8 to 1/4 of one of its terms on average: most
entries hash one or two terms, so the share of equal entries follows the overlap
of the term sets, a long text is as robust to an edit as a short one, and two versions
of a text share a level.

Every fingerprint has two parts: the entries of the document's lexicon terms, and those of
all its terms. Two documents are compared by their lexicon parts where both have
``MIN_TERMS`` lexicon terms or more, else by their parts of all terms: a hash of one or two
rare words would say nothing of the rest. So a text and its edit are always compared
over terms chosen alike.

Document frequencies are exact counts over all documents, aggregated map side
first. The lexicon reaches the documents as a Bloom filter of fixed size, a
2 MB array built by aggregation: document frequencies sum to at most the number of
documents times the mean number of terms t, so at most t / LOW terms are in the
band, whatever the corpus size (600,000 for 300 terms a document: one in 28 terms
outside the band passes, the same ones in every document).

All of it is DataFrame functions; no Python runs on the executors.

Null and empty texts have no entries; two empty fingerprints have likeness 1, an
empty and another 0. Rows that share a doc_id are one document for the order of
documents; the next document's text is then its least one. Null ids come after
all others; however many rows have none, only the least text of them takes part in the
blocks of ids. With one document, the next document is itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import neighbours, setup, stage_table

LOW, HIGH = 1 / 2000, 1 / 20
MIN_TERMS = 8
SUBSETS = 64      # the top 6 bits of a term's hash
LEVELS = 2
BLOCK_BITS = 6    # documents meet their neighbours in blocks of 64 consecutive ids
FILTER_BITS = 24  # of the Bloom filter; the hash's lowest bits
_NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words (runs of letters and digits)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(h,): hashes of the terms whose document frequency is in the band."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") >= low * n) & (F.col("df") <= max(1.0, high * n))).select("h")


def bloom(lex: DataFrame) -> DataFrame:
    """One row: an array of 2^FILTER_BITS / 64 longs with the bits of the lexicon set."""
    words = 1 << (FILTER_BITS - 6)
    bits = lex.groupBy(_word("h").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("w"))
    dense = (lex.sparkSession.range(words).withColumnRenamed("id", "i").join(bits, "i", "left")
             .select("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))
    row = dense.agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("all"))
    return row.select(F.transform("all", lambda x: x["w"]).alias("bits"))


def _word(h) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << (FILTER_BITS - 6)) - 1))


def _in_lexicon(bits: Column, h: Column) -> Column:
    word = F.get(bits, _word(h).cast("int"))
    # shifts take an int literal only as a Column expression here
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _thinned(kept: Column, level: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    return F.filter(kept, lambda t: F.shiftrightunsigned(t, 24).bitwiseAND(mask) == 0)


def _entries(kept: Column, level: Column) -> Column:
    part = lambda t: F.shiftrightunsigned(t, 58)
    return F.transform(F.array_distinct(F.transform(kept, part)), lambda j: (
        F.call_function("shiftleft", level.cast("long"), F.lit(58))
        .bitwiseOR(F.shiftleft(j, 52))
        .bitwiseOR(F.xxhash64(F.filter(kept, lambda t: part(t) == j)).bitwiseAND(F.lit((1 << 52) - 1)))))


def with_fingerprint(df: DataFrame, text: Column, bits: Column, out: str) -> DataFrame:
    """``df`` with ``out``: struct(n, band, every): the number of lexicon terms of ``text``, and the
    struct(level, entries) of these terms and of all its terms."""
    cols = df.columns
    d = df.withColumn("_every", F.sort_array(terms(text)))
    d = d.withColumn("_band", F.filter("_every", lambda h: _in_lexicon(bits, h)))
    fields = [F.size("_band").alias("n")]
    for part in ("band", "every"):
        size = F.greatest(F.size(f"_{part}"), F.lit(1))
        d = d.withColumn(f"_{part}l", F.greatest(F.lit(0), F.floor(F.log2(size / SUBSETS)).cast("int") + 2))
        last = F.col(f"_{part}")
        for i in range(LEVELS):
            d = d.withColumn(f"_{part}{i}", _thinned(last, F.col(f"_{part}l") + i))
            last = F.col(f"_{part}{i}")
        entries = F.concat(*[_entries(F.col(f"_{part}{i}"), F.col(f"_{part}l") + i) for i in range(LEVELS)])
        fields.append(F.struct(F.col(f"_{part}l").alias("level"), entries.alias("entries")).alias(part))
    return d.select(*cols, F.struct(*fields).alias(out))


def as_text(fp: Column) -> Column:
    """A fingerprint as a string: the number of lexicon terms, then for either part its first
    level and its entries in hexadecimal."""
    def part(p):
        return F.concat_ws(".", p["level"].cast("string"), F.transform(p["entries"], lambda e: F.lower(F.hex(e))))
    return F.concat_ws("|", fp["n"].cast("string"), part(fp["band"]), part(fp["every"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries in the part of two fingerprints that both have (see above)."""
    both = F.least(a["n"], b["n"]) >= MIN_TERMS
    return F.when(both, _part_likeness(a["band"], b["band"])).otherwise(_part_likeness(a["every"], b["every"]))


def _part_likeness(a: Column, b: Column) -> Column:
    """Of the (level, part) pairs that either fills at their common levels,
    the share with equal entries; 0 without a common level, 1 for two empty ones."""
    lo = F.greatest(a["level"], b["level"])
    hi = F.least(a["level"], b["level"]) + (LEVELS - 1)

    def common(fp):
        return F.filter(fp["entries"], lambda e: F.shiftrightunsigned(e, 58).between(lo, hi))

    def slots(entries):
        return F.transform(entries, lambda e: F.shiftrightunsigned(e, 52))
    x, y = common(a), common(b)
    union = F.size(F.array_union(slots(x), slots(y)))
    return (F.when((F.size(a["entries"]) == 0) & (F.size(b["entries"]) == 0), F.lit(1.0))
            .when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "imatch", bits: Column | None = None) -> DataFrame:
    """``docs`` with ``out``: the fingerprint of every text under the lexicon of all of them."""
    setup(docs.sparkSession)
    bits = lexicon_filter(docs, text_col) if bits is None else bits
    return with_fingerprint(docs, F.col(text_col), bits, out)


def lexicon_filter(docs: DataFrame, text_col: str = "text") -> Column:
    """The corpus's lexicon as a session variable: a constant of fixed size wherever it is used."""
    spark = setup(docs.sparkSession)
    name = f"imatch_lexicon_{uuid.uuid4().hex}"
    stage_table(bloom(lexicon(docs, text_col)), "lexicon").createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name}_bits ARRAY<BIGINT>")
    spark.sql(f"SET VARIABLE {name}_bits = (SELECT bits FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"{name}_bits")


def _with_next(own: DataFrame) -> DataFrame:
    """``own(k, text, fp)``, null keys after all others, with ``nxt``: text and fp of the next document, that
    with the next smaller key (after the smallest, the largest; of rows with one key, the least text).

    Rows meet in blocks of neighbouring keys, so texts are shuffled once; only the
    first document of each block moves on, to the block above.
    """
    first = F.min(F.struct("text", "fp"))
    top = own.agg(F.max("k")).first()[0]
    rest = own.where("k is null")
    # rows without an id all have the same next document; one of them stands for them in the blocks
    after = rest if top is None else own.where(F.col("k") == top)
    alone = rest.join(F.broadcast(after.agg(first.alias("nxt")))).select("k", "text", "fp", "nxt")
    least = rest.agg(first.alias("r")).where("r is not null").select(F.lit(_NO_ID).alias("k"), "r.text", "r.fp", F.lit(None).cast("boolean").alias("own"))
    own = own.where("k is not null").withColumn("own", F.lit(True)).unionByName(least)
    own = own.withColumn("b", F.shiftright("k", BLOCK_BITS)).where("b is not null")
    in_block = Window.partitionBy("b").orderBy("k", F.col("text").desc())
    rows = own.withColumn("above", F.lead("k").over(in_block))
    # of each key, the last row stands for it; a row takes the last of those before it
    stands = F.coalesce(F.col("above") != F.col("k"), F.lit(True))
    marked = rows.withColumn("mark", F.when(stands, F.struct("text", "fp")))
    below = F.last("mark", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1))

    blocks = own.select("b").distinct()
    lowest = blocks.agg(F.min("b")).first()[0]
    info = neighbours(blocks, ["b"]).select("b", F.coalesce("next.b", F.lit(lowest)).alias("taker"))
    # the blocks' own column and filter, so that both uses of the blocks share one exchange of the texts
    tops = (rows.where(F.col("above").isNull() & F.coalesce("own", F.lit(True))).select("b", "text", "fp").join(info, "b")
            .select("taker", F.struct("text", "fp").alias("first")))
    met = (marked.withColumn("below", below).join(tops, F.col("b") == F.col("taker"), "left").where("own")
           .select("k", "text", "fp", F.coalesce("below", "first").alias("nxt")))
    return met.unionByName(alone)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against an edited version of itself and against the next document.

    The next document is the one with the next smaller id (after the smallest, the
    largest). The edited text has its last third replaced by as many first code
    points of the next one.
    """
    bits = lexicon_filter(docs, text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("k"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = _with_next(with_fingerprint(keyed, F.col("text"), bits, "fp"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    both = both.select(
        F.col("k").alias("doc_id"), n.cast("long").alias("n_chars"),
        "fp", F.col("nxt.fp").alias("next_fp"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("nxt.text"), F.lit(1), cut)).alias("edited"))
    both = with_fingerprint(both, F.col("edited"), bits, "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
