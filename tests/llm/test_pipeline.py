"""The pipeline: each stage against brute force on its own input, and the contract's small print."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewater.llm import quality
from tests_llm_helpers import brute_components, brute_fingerprint, brute_hits, brute_lines, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, n):
    return " ".join("".join(rng.choice("abdeghilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    boiler = "Reproduced with the kind permission of everybody who was asked about it."
    bench = [(k, words(rng, 25)) for k in range(6)] + [(90, None), (91, "")]
    docs, labels = [], []

    def add(text, source=None, good=1):
        docs.append((len(docs), text, "en", source if source is not None else f"s{rng.randrange(14)}", len(text or "")))
        labels.append((len(docs) - 1, good, 0))
    for _ in range(160):
        add("\n".join(words(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 5))) + (f"\n{boiler}" if rng.random() < 0.4 else ""))
    for _ in range(40):
        add("$$$ ".join(words(rng, 60).split()), good=0)
    for k in range(12):                      # exact and near copies, and leaks
        add(docs[k][1])
        add(docs[k][1].replace(" ", "  ", 3))
        add(words(rng, 30) + " " + bench[k % 6][1].upper() + ". " + words(rng, 30))
    for text in (None, "", "one"):
        add(text)
    docs += [docs[3], (None, words(rng, 50), "en", None, None), (None, docs[5][1], "en", "s1", None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in cp.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_each_stage_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("hits", F.lit(1)).withColumn("_whole", F.lit("x"))
    columns = docs.columns

    kept = cp.quality_classifier(spark, docs, corpus)
    model = quality.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    want = [r for r in rows_of(docs) if quality.score(model, (r[1] or "").encode()) >= quality.THRESHOLD]
    assert kept.columns == columns and sorted(rows_of(kept), key=str) == sorted(want, key=str)
    good = {i for i, _, _ in want}
    assert sum(i in good for i in range(160)) >= 155 and sum(i in good for i in range(160, 200)) <= 2

    lined = cp.line_dedup(spark, kept, corpus)
    before = rows_of(kept)
    assert lined.columns == columns
    assert sorted(((i, t) for i, t, _ in rows_of(lined)), key=str) == sorted(((i, t) for i, t, _ in brute_lines(before, 10)), key=str)

    one = cp.simhash_near_dedup(spark, lined, corpus)
    before = rows_of(lined)
    groups = brute_components({brute_fingerprint(t) for _, t, _ in before}, lambda a, b: (a ^ b).bit_count() <= 4)
    left = {}
    for i, t, _ in before:
        left.setdefault(groups[brute_fingerprint(t)], set()).add((i is None, i or 0))
    got = rows_of(one)
    assert one.columns == columns and len(got) == len(left)
    assert sorted(i or -1 for i, _, _ in got) == sorted((-1 if n else i) or -1 for n, i in (min(x) for x in left.values()))

    clean = cp.benchmark_decontamination(spark, one, corpus)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    want = [r for r in rows_of(one) if not brute_hits(r[1], items)[1]]
    assert clean.columns == columns and sorted(rows_of(clean), key=str) == sorted(want, key=str) and len(want) < len(got)

    mixed = cp.source_mixing(spark, clean, corpus)
    size, taken = {}, {}
    for _, t, s in rows_of(clean):
        size[s] = size.get(s, 0) + len((t or "").split())
    most = max(len((t or "").split()) for _, t, _ in rows_of(clean))
    for r in mixed.collect():
        assert 0 < r.taken <= 3 * len(r.text.split())
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in brute_targets(size).items():
        assert target - most <= taken.get(s, 0) <= target + 1e-6


def test_run_and_empty_tables(spark, corpus, tmp_path):
    out = cp.run(spark, corpus)
    assert out.columns == COLUMNS + ["taken"] and out.count() > 50
    assert sorted(map(str, out.collect())) == sorted(map(str, cp.run(spark, corpus).collect()))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
