"""Operators 6, 8, 9, 10 and the shared helpers against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontam, mixing, quality, simhash
from tidewater.llm.common import components, neighbours
from tests_llm_helpers import brute_components, brute_fingerprint, brute_hits, brute_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(500, 500)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {frozenset(p) for p in pairs}
    want = brute_components({x for p in pairs for x in p}, lambda a, b: frozenset((a, b)) in links)
    for n, r in want.items():
        assert got.get(n, n) == r
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_across_partitions(spark):
    rows = [(i * 7 % 101,) for i in range(101)]
    got = {r.k: (r.prev and r.prev.k, r.next and r.next.k) for r in
           neighbours(spark.createDataFrame(rows, "k long").repartition(5), ["k"]).collect()}
    assert got == {k: (k - 1 if k else None, k + 1 if k < 100 else None) for k in range(101)}


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50, 400):
        text = " ".join(rng.choice(["Abc", "dé", "x", "ÄB\t", " y"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_every_pair_within_reach_is_linked(spark):
    """Random fingerprints with neighbours at 0 to 6 bits: the links' components are the brute-force ones."""
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(7)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    for f in signed:
        assert got.get(f, f) == want[f]


def test_near_duplicates_on_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "a"), (3, base + " tail", "a"), (9, base.upper(), "b"), (7, None, "a"), (2, "", None), (8, " \t", "b"),
            (None, base, "a"), (None, "alone here", None), (5, base, "a"), (11, "entirely other words stand in this one", "c")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fp = {i: f"{brute_fingerprint(t):016x}" for i, t, _ in rows if i is not None}
    assert len(got) == len(rows)
    assert all(r.fingerprint == fp[r.doc_id] for r in got if r.doc_id is not None)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by == {5: 3, 3: 3, 9: 3, 7: 2, 2: 2, 8: 2, 11: 11}
    assert Counter(r.component_id for r in got if r.doc_id is None) == {3: 1, None: 1}
    kept = simhash.deduplicate(docs_of(spark, rows).withColumn("_row_key", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "2", "3", "None"]
    assert kept.columns[-1] == "_row_key"
    empty = docs_of(spark, []).limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark):
    rows = [(1, "some words that are here to stay", "a"), (1, "quite different from the row before it", "a")]
    assert simhash.deduplicate(docs_of(spark, rows)).count() == 2


def test_mix_against_its_rules(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["b", "a", None, "é", "Z"] + ["big"] * 4)) for i in range(600)]
    rows += [(1000, "tiny one", "rare"), (1001, None, "nothing"), (1, "w w w", "a")]
    got = mixing.mix(docs_of(spark, rows).withColumn("taken", F.lit(7)).withColumn("SIZE", F.lit(7))).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    src = {i: s for i, _, s in rows}
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        if r.doc_id == 1:
            continue
        s = src[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for r in got:
        s = src[r.doc_id] if r.doc_id != 1 else None
        if s is not None:
            taken[s] += r.taken
            most[s] = max(most[s], r.size)
    for s in ("b", "é", "Z", "big"):
        assert want[s] - most[s] <= taken[s] <= want[s] + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs_of(spark, rows).repartition(7)).collect()), key=str)
    assert mixing.mix(docs_of(spark, []).limit(0)).count() == 0
    some = mixing.sample(docs_of(spark, rows))
    assert some.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken"] and some.where("taken <= 0").count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["alpha", "Béta", "g1", "delta", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 9, 10, 14])))) for i in range(12)]
    items += [(3, "only three words"), (50, None), (51, "  ,, "), (7, items[4][1])]
    texts = [", ".join(rng.choice(vocab) for _ in range(60)) for _ in range(30)]
    texts += [None, "", "!!", "pre " + items[3][1].upper() + " post", "alphaonly three wordsx", "is Only, THREE-words!", texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]).withColumn("hits", F.lit(1))
    for block in (2_000_000, 300):  # one automaton, and many blocks
        monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
        got = {r.doc_id: r.found for r in decontam.find(docs, bench, out="found").collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (n, hit, found)
            inside = sum(len(decontam._WORD.findall(t[s.start:s.stop])) for s in got[i].spans)
            assert inside == hit
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontam.find(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 7, 448, 512, 513, 5000):
        text = bytes(i % 251 + 1 for i in range(n))
        rows, real = quality.chunks(text)
        seen = np.zeros(n, bool)
        for k, r in enumerate(rows):
            at = k * (quality.CHUNK - quality.OVERLAP)
            part = text[at:at + quality.CHUNK]
            assert bytes(r[:len(part)]) == part and not r[len(part):].any()
            if real[k]:
                seen[at:at + (real[k] - 1) * quality.STRIDE + quality.KERNEL] = True
        assert seen.all()


def test_long_text_scores_as_its_blocks():
    rng = np.random.default_rng(0)
    f, h = quality.FILTERS, quality.HIDDEN
    model = quality.Model(rng.normal(size=(quality.KERNEL, 256, f)).astype(np.float32), np.zeros(f, np.float32),
                          rng.normal(0, 0.02, (3 * f, h)), rng.normal(size=h), rng.normal(0, 0.1, h), 0.1)
    text = rng.integers(1, 255, 3 * 448 * quality.BLOCK + 99, dtype=np.uint8).tobytes()
    rows, real = quality.chunks(text)
    top, _ = quality.convolve(model.table, model.bias, rows, real, quality.STRIDE)
    x = np.concatenate([top.mean(axis=0), top.max(axis=0), top.min(axis=0)])
    want = 1 / (1 + np.exp(-(np.maximum(x @ model.w1 + model.b1, 0) @ model.w2 + model.b2)))
    assert 0.01 < want < 0.99 and quality.score(model, text) == pytest.approx(want, rel=1e-4)


def test_training_separates_what_is_separable():
    texts = [(b"AB" if i % 2 else b"xy") * (20 + 300 * (i % 5)) for i in range(20)]
    model = quality.train(texts, [i % 2 for i in range(20)], quality.Fit(epochs=30, batch=4))
    assert all((quality.score(model, t) > 0.5) == bool(i % 2) for i, t in enumerate(texts))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(words) if good else "*** ".join(words), "s"))
        labels.append((i, int(good), 0))
    rows += [(900, None, "s"), (901, "", "s"), (None, "no id here", "s"), (902, "long words " * 20000, "s")]
    labels += [(7, labels[7][1], 0), (None, 1, 0), (903, None, None)]
    docs = docs_of(spark, rows).withColumn("score", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab, quality.Fit(rows=400))
    got = quality.scores(docs, model, out="p").select("doc_id", "p", quality.held_out().alias("h")).collect()
    assert all(0 <= r.p <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 500]
    assert held and all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict((i, y) for i, y, _ in labels[:500])
    assert sum((r.p >= 0.3) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    none = quality.scores(docs, quality.fit(docs, lab.limit(0)), out="p").select("p").distinct().collect()
    assert len(none) == 1
    assert quality.scores(docs.limit(0), model, out="p").count() == 0
