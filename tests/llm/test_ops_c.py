"""Operators 11, 12 and 13 against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewater.llm import prefixtrie, queries, sentencepieces, termaudit

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- 11: SentencePiece

ODD = ["", " ", "  a", "a  b ", "　x", "▁a", "a▁b", "é", "<s> </s>", "\x00a", "日本語のtext", "😀 \n\n x", "a\tb", "<0x41>", "²."]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abceth▁  \n\té日本😀²3.,;()\"'") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_agenda_against_the_library():
    e = sentencepieces.encoder(open(MODEL, "rb").read())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + random_texts(1, 3000) + ["x" * 5000, "ab" * 40_000, " " * 3000, "the and of " * 2000]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == lib.encode(t), t[:60]
        assert e.decode(ids.tolist() + [2]) == lib.decode(ids.tolist() + [2])
    for c in ("▁thethe", "▁" * 70, "antidisestablishment" * 5):  # the heap and the arrays
        assert e.merged(c) == list(memoryview(e.merged_all([c, "▁x"])[0]).cast("i"))


def test_decoding_of_any_ids():
    e = sentencepieces.encoder(open(MODEL, "rb").read())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    for _ in range(800):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randrange(12))]
        assert e.decode(ids) == lib.decode(ids), ids


def test_parts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(sentencepieces, "PART", 50)
    monkeypatch.setattr(sentencepieces, "CACHE", 20)
    e = sentencepieces.Encoder(open(MODEL, "rb").read())
    texts = random_texts(3, 300) + ["one two  three " * 60]
    assert [x.tolist() for x in e.encode(texts)] == e.library.encode(texts)


def test_a_foreign_result_is_an_error(monkeypatch):
    e = sentencepieces.Encoder(open(MODEL, "rb").read())
    monkeypatch.setattr(e, "merged_all", lambda chunks: [b"\1\0\0\0" for _ in chunks])
    with pytest.raises(sentencepieces.Mismatch):
        e.encode(["hello"])


def test_tokenize_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "Hello  world", "k"), (3, "Hello  world", "k"), (None, "é\n", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepieces.tokenize(docs, MODEL, decoded="back", begin=True, end=True, check="texts")
    assert out.columns == ["doc_id", "text", "ids", "back"]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in out.collect():
        assert list(r.ids) == [1] + lib.encode(r.text or "") + [2] and r.back == (r.text or "")
    assert sentencepieces.tokenize(docs.limit(0), MODEL, decoded="back").count() == 0


def test_sentencepiece_query_on_whole_texts(spark):
    d = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_sentencepiece(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# --- 12: prefix trie

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    # the rows of one turn number are equal here but for nulls
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda v: v[:2])] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ended = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        ended[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)

    def below(n):
        return [m for m in members if m[:len(n)] == n]

    def words(n):
        return len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    return sorted((min(c), len(n), min(members[n[:-1]]) if n else None, len(c), children[n],
                   sum(not children[m] for m in below(n)), sum((len(members[m]) - 1) * words(m) for m in below(n)),
                   hashlib.sha256(",".join(map(str, sorted(ended[n]))).encode()).hexdigest()) for n, c in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, key long").drop("depth")
    out = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.paths(df))).drop("key").collect()
    return sorted((tuple(r) for r in out), key=lambda r: tuple((x is None, x) for x in r))


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in [i * 3 for i in range(n)] + [20, 40, 400]:
        turns = rng.randrange(1, 6)
        for t in range(turns):
            text = rng.choice(["hi there", "a b\tc", "", None, "é ü"])
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if t % 2 else "user", text, "x", 1))
    rows += [(c, t, "user", "same words here", "x", 1) for c in (5001, 5002, 5003, 5004) for t in range(3)]
    rows += [(7000, t, "user", f"turn {t}", "x", 1) for t in range(long)] + [(7001, t, "user", f"turn {min(t, long - 5)}", "x", 1) for t in range(long)]
    return rows + [(None, 0, "user", "no conversation", "x", 1)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("deep", [0, 1000])
def test_trie_against_brute_force(spark, monkeypatch, deep):
    monkeypatch.setattr(prefixtrie, "DEEP_ROWS", deep)
    rows = list({(r[0], r[1]): r for r in conversations(4, 60)}.values())
    assert trie_rows(spark, rows) == in_order(brute_trie([r[:4] for r in rows]))


def test_trie_of_a_long_conversation_and_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN", 2)
    monkeypatch.setattr(prefixtrie, "DEEP_ROWS", 5)
    rows = list({(r[0], r[1]): r for r in conversations(5, 30, long=70)}.values())
    assert trie_rows(spark, rows) == in_order(brute_trie([r[:4] for r in rows]))


def test_trie_edge_cases(spark):
    assert trie_rows(spark, [(None, 1, "user", "a", "x", 1)]) == []
    # repeated rows are turns of their own; a conversation may lose all its turns
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(c, 0, "user", "a", "x", 1)] * 2
    assert trie_rows(spark, rows) == in_order(brute_trie([r[:4] for r in rows]))


# --- 13: divergence audit

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_audit(rows, min_docs, top):
    rows = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for g, _, ws in rows if g == lang for t in set(ws))
        kept = sorted((t for t, n in df.items() if n >= min_docs), key=str.encode)
        v = len(kept)

        def shares(sources):
            n = Counter(t for g, s, ws in rows if g == lang and s in sources for t in ws)
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10 ** 9 * (n[t] + 2) // (total + 2 * v) for t in kept}
        sources = {s for g, s, _ in rows if g == lang}
        group = {s: shares({s}) for s in sources}
        _, q = shares(sources)

        def score(a, b):
            return (a - b) ** 2 // (a + b)
        for s, (n, p) in group.items():
            pairs = [(-sum(score(p[t], group[o][1][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-score(p[t], q[t]), t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def audit_rows(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {"term": F.lit("clash"), "ordinal": F.lit(1), "n": F.lit(2)})
    return sorted(tuple(r) for r in termaudit.audit(docs, **kw).collect())


def documents(seed, n):
    rng = random.Random(seed)
    words = ["été", "The", "the", "zebra", "日本", "naïve", "a", "ab", "abc", "b_c", "x1y", "Ünder", "ünder", "😀"]
    return [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "ß", None, "s10"]),
             rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])) for _ in range(n)]


def test_audit_against_brute_force(spark):
    rows = documents(6, 120) + [("de", "only", "Wort"), ("xx", "a", "rare"), ("xx", "b", None), ("", "", "the the")]
    assert audit_rows(spark, rows, min_docs=4, top=3) == brute_audit(rows, 4, 3)


def test_audit_where_words_move_and_sources_are_tiled(spark, monkeypatch):
    for name, value in (("SENT_TERMS", 2), ("SHARD", 3), ("SALTED", 5), ("BLOCK", 4), ("TILE", 2)):
        monkeypatch.setattr(termaudit, name, value)
    rows = documents(7, 120) + [("fr", "alone", "rien"), ("en", "q", "été " * 500)]
    assert audit_rows(spark, rows, min_docs=3, top=4) == brute_audit(rows, 3, 4)


def test_audit_of_nothing(spark):
    assert audit_rows(spark, []) == []


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 7))).encode() for _ in range(400)})
    m = termaudit.Transducer(words)
    assert m.size == len(words)
    suffixes = {frozenset(w[i:] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    assert len(m.final) == len(suffixes)  # one state for each set of suffixes
    texts = [b" ".join(rng.choices(words + [b"zz", b"abz"], k=50)).decode() for _ in range(5)] + ["", "a" * 3000]
    data, end = termaudit._joined(texts)
    start, ordinal = m.read(data)
    got = sorted(zip(start.tolist(), ordinal.tolist()))
    want, at = [], 0
    for t in texts:
        raw = t.encode()
        want += [(at + x.start(), words.index(x[0])) for x in re.finditer(rb"[^\x00-\x40]+", raw) if x[0] in words]
        at += len(raw) + 1
    assert got == sorted(want) and end[-1] == at
