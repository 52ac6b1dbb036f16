"""Work that two parts of a plan, or all chunks of a batch, do once."""

import random

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm import imatch, sentencepieces
from test_ops_b import docs_of


def test_imatch_shuffles_texts_once(spark):
    rows = [(i, f"word{i % 7} text number {i} of some length {i * i}", "s") for i in range(300)]
    pairs = imatch.edited_pairs(docs_of(spark, rows))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    blocks = [line for line in plan.splitlines() if "Exchange hashpartitioning(b#" in line and "ReusedExchange" not in line and "fp#" in line]
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line and "text#" in line and "fp#" in line]
    assert len(reused) == 1, (blocks, reused)


def test_new_chunks_are_checked_a_batch_at_a_time(monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        e = sentencepieces.Encoder(f.read())
    calls = []
    whole = e._single
    monkeypatch.setattr(e, "_single", lambda raw: calls.append(1) or whole(raw))
    text = " ".join(f"wörter{i} other{i * 7}" for i in range(500)) + " " + "x" * 200
    assert e.encode([text])[0].tolist() == e.library.encode(text)
    assert len(calls) == 1  # the text; every chunk is compared in its batch

    # a chunk that differs is still found
    e.cache.clear()
    right = e.merged_all
    monkeypatch.setattr(e, "merged_all", lambda chunks: [b"\1\0\0\0" + x[4:] if i == 17 else x for i, x in enumerate(right(chunks))])
    try:
        e.encode([text])
    except sentencepieces.Mismatch:
        return
    raise AssertionError("a wrong chunk went through")


def test_ids_and_decoded_text_take_one_encoding(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs_of(spark, [(1, "Hello  wörld\n", "s"), (2, None, "s"), (2, "", "s"), (2, "日本 text", None)])
    out = sentencepieces.tokenize(docs, model, decoded="back", begin=True, end=True, check="texts")
    plan = out._jdf.queryExecution().executedPlan().toString()
    calls = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(calls) == 1 and calls[0].count("(text#") == 1, calls
    sent = sentencepieces.load(spark, model)
    apart = docs.withColumn("ids", sentencepieces.encode(docs.text, sent, True, True))
    apart = apart.withColumn("back", sentencepieces.decode(apart.ids, sent))
    assert sorted(map(str, out.collect())) == sorted(map(str, apart.collect()))


def test_arrays_of_any_length_and_symbol():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        e = sentencepieces.Encoder(f.read())
    rng = random.Random(5)
    chunks = ["▁" + "".join(rng.choice("abcdeinrst\n😀²é.") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 40, 63, 64, 126, 127, 300))))
              for _ in range(600)] + ["▁", "▁▁▁", "\n", "😀"]
    for block in (1, 7, 1 << 13):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sentencepieces, "BLOCK", block)
            assert [list(memoryview(x).cast("i")) for x in e.merged_all(chunks)] == e.inner.encode(chunks)


def test_every_pair_is_found_in_the_open_table():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        e = sentencepieces.Encoder(f.read())
    cuts = [(p[:k], p[k:]) for p in list(e.ids)[::50] for k in range(1, len(p))]
    cuts = [(a, b) for a, b in cuts + [(b, a) for a, b in cuts] if all(len(x) == 1 or x in e.ids for x in (a, b))]
    left, right = (np.array([e._symbol(x) for x in part]) for part in zip(*cuts))
    rank, made = e._agenda(left, right)
    for (a, b), r, i in zip(cuts, rank.tolist(), made.tolist()):
        assert (r, i) == (e.rank[a + b], e.ids[a + b]) if a + b in e.ids else r == sentencepieces._NEVER
