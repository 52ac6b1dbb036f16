"""Very long texts, and extra columns of any name, through every operator on documents."""

from pyspark.sql import functions as F

from tidewater.llm import decontam, imatch, linespread, mixing, quality, secretscan, simhash

CLASHES = ["size", "slot", "taken", "target", "hits", "score", "spans", "fp", "k", "b", "n", "row", "rep", "line", "found",
           "node", "root", "mark", "below", "level", "entries", "window", "items", "words", "edited", "site", "t", "h"]


def corpus(spark):
    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    rows = [(1, long, "a"), (2, long + " tail", "b"), (3, "\n".join(["the same short line"] * 50_000), "c"), (4, "x" * 3_000_000, None),
            (5, None, None), (6, "", "a"), (6, "", "a"), (None, "a few words", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, df.withColumns({c: F.lit("clash") for c in CLASHES})


def test_long_texts_and_clashing_columns(spark):
    rows, docs = corpus(spark)
    n = len(rows)
    bench = spark.createDataFrame([(1, "word4998 word4999 word0 word1"), (2, "not there at all")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")

    pairs = {r.doc_id: r for r in imatch.edited_pairs(docs).collect() if r.doc_id in (1, 2, 4)}
    assert pairs[1].n_chars == len(rows[0][1]) and pairs[2].near_next > 0.9 and pairs[4].n_chars == 3_000_000
    assert imatch.edited_pairs(docs).count() == n

    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id}
    assert near[1] == near[2] == 1 and near[5] == near[6] == 5
    assert simhash.deduplicate(docs).columns == docs.columns

    found = {r.doc_id: r.out for r in decontam.find(docs, bench, out="out").collect() if r.doc_id}
    assert found[1].n_words == 400_000 and list(found[1]["items"]) == ["1"] and found[1].n_hit == 79 * 4
    span = found[1].spans[-1]
    assert rows[0][1][span.start:span.stop] == "word4998 word4999 word0 word1"
    assert decontam.clean(docs, bench).columns == docs.columns

    kept = linespread.dedup_lines(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))

    mixed = mixing.mix(docs)
    assert mixed.count() == n and {r.doc_id: r["size"] for r in mixed.collect() if r.doc_id}[1] == 400_000
    assert mixing.sample(docs).columns == [c for c in docs.columns if c != "taken"] + ["taken"]

    model = quality.fit(docs, labels)
    assert quality.scores(docs, model, out="p").where("p between 0 and 1").count() == n
    assert quality.keep_good(docs, labels).columns == docs.columns

    scanned = secretscan.secrets(docs, secretscan.fit(docs), out="out")
    assert scanned.count() == n and scanned.where("doc_id = 4").first().out.base == ""
