"""The registered queries of this subpackage, opN_<name> and pipeline, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import (chat, decontam, imatch, linespread, mixing, oracle, pagediff, prefixtrie, quality,
                           secretscan, sentencepieces, simhash, termaudit, urltree)
from tidewater.llm.common import setup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return setup(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark, sf_dir):
    return imatch.edited_pairs(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    """All conversations and conversation -7, whose texts hold the template's own marks."""
    cols = ["conv_id", "turn", "role", "text"]
    rows = _table(spark, sf_dir, "conversations").select(*cols)
    probe = r"\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    extra = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(extra)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_page_diff(spark, sf_dir):
    return pagediff.extract(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("secrets")
    return secretscan.secrets(docs, secretscan.fit(docs)).select(
        "doc_id", s.n_assign.alias("n_assign"), s.n_access.alias("n_access"), s.n_hex.alias("n_hex"),
        F.sha2(s.base.cast("binary"), 256).alias("base_sha256"), s.spans.alias("spans"))


def op5_line_spread(spark, sf_dir):
    """Every document after cross-site line removal."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linespread.remove(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_url_tree(spark, sf_dir):
    return urltree.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_decontaminate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return decontam.find(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id", h.n_words.alias("n_words"), h.n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (h.n_hit > 0).alias("contaminated"))


def op11_sentencepiece(spark, sf_dir):
    """Every document's ids, an end id last, and the text they decode to."""
    import public_tokenizers
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepieces.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded", end=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_prefix_trie(spark, sf_dir):
    own = prefixtrie.paths(_table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.rebuilt(own)).drop("key")


def op13_divergence(spark, sf_dir):
    return termaudit.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_imatch, op2_chat_format, op3_page_diff, op4_secret_scan, op5_line_spread, op6_mix_sources, op7_url_tree, op8_simhash, op9_quality, op10_decontaminate, op11_sentencepiece, op12_prefix_trie,
    op13_divergence)}

#: The others have no SQL form (XXH64 fingerprints, html, regular-expression offsets, a
#: network); tests/llm holds them against brute force.
ORACLE = {"op2_chat_format": oracle.op2(), "op5_line_spread": oracle.op5(), "op6_mix_sources": oracle.op6(),
          "op7_url_tree": oracle.op7(), "op10_decontaminate": oracle.op10(),
          "op12_prefix_trie": oracle.op12(), "op13_divergence": oracle.op13()}
