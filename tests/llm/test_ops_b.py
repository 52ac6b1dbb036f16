"""Operators 1, 2, 3, 4, 5, 7 against brute force."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests_llm_helpers import brute_lines
from tidewater.llm import chat, imatch, linespread, pagediff, secretscan, urltree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- 1: I-Match

_TERM = re.compile(r"[^\W_]+")


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_imatch(text, df, n):
    words = set(_TERM.findall((text or "").lower()))
    band = {w for w in words if df.get(w, 0) >= imatch.LOW * n and df.get(w, 0) <= max(1, imatch.HIGH * n) and df.get(w)}
    return len(band), brute_part(band), brute_part(words)


def brute_part(words):
    hashes = sorted((xxhash.xxh64_intdigest(w.encode(), 42) for w in words), key=_signed)
    level = max(0, math.floor(math.log2(max(1, len(hashes)) / 64)) + 2)
    entries = []
    for l in (level, level + 1):
        parts = defaultdict(list)
        for h in hashes:
            if (h >> 24) % (1 << l) == 0:
                parts[h >> 58].append(h)
        for part, own in parts.items():
            seed = 42
            for h in own:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
            entries.append((l << 58 | part << 52) | seed & (1 << 52) - 1)
    return level, set(entries)


def brute_likeness(a, b):
    part = 1 if min(a[0], b[0]) >= imatch.MIN_TERMS else 2
    a, b = a[part], b[part]
    if not a[1] and not b[1]:
        return 1.0
    lo, hi = max(a[0], b[0]), min(a[0], b[0]) + 1
    x, y = ({e for e in f[1] if lo <= e >> 58 <= hi} for f in (a, b))
    union = {e >> 52 for e in x} | {e >> 52 for e in y}
    return len(x & y) / len(union) if union else 0.0


def test_imatch_against_its_definition(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    common = ["the", "of", "Ünd"]
    rows = [(i * 3, " ".join(rng.choice(vocab + common * 200) for _ in range(rng.choice([0, 1, 3, 40, 300, 900]))), "s") for i in range(80)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "éa" * 50 + " \U0001f600 x", "s"), (None, "a row without an id", "s")]
    n = len(rows)
    df = Counter(w for _, t, _ in rows for w in set(_TERM.findall((t or "").lower())))
    got = {r.doc_id: r for r in imatch.edited_pairs(docs_of(spark, rows)).collect()}
    assert len(got) == n
    order = sorted((i for i, _, _ in rows if i is not None), reverse=True) + [None]
    text = {i: t or "" for i, t, _ in rows}
    for i in order:
        t, nxt = text[i], text[order[(order.index(i) + 1) % n]]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute_imatch(x, df, n) for x in (t, edited, nxt))
        for f, s in ((a, r.fingerprint), (b, r.edited_fingerprint)):
            size, *parts = s.split("|")
            assert int(size) == f[0] and len(parts) == 2
            for got_part, want in zip(parts, f[1:]):
                level, *entries = got_part.split(".")
                assert int(level) == want[0] and {int(e, 16) for e in entries if e} == want[1]
        assert r.near_edited == pytest.approx(brute_likeness(a, b)) and r.near_next == pytest.approx(brute_likeness(a, c))


def test_imatch_edit_across_the_lexicon_bound(spark):
    """A text with just enough lexicon terms and its edit with one less are compared over all terms of both."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(common + [f"f{rng.randrange(400)}"]), "s") for i in range(300)]
    rare = [f"r{i}" for i in range(imatch.MIN_TERMS)]
    rows += [(1000, " ".join(common[:12] + rare), "s"), (1001, " ".join(common[:12] + rare[:-1]), "s")]
    got = {r.doc_id: r for r in imatch.edited_pairs(docs_of(spark, rows)).collect()}
    assert [int(got[i].fingerprint.split("|")[0]) for i in (1000, 1001)] == [imatch.MIN_TERMS, imatch.MIN_TERMS - 1]
    assert got[1001].near_next > 0.8


def test_imatch_many_rows_without_an_id(spark):
    rows = [(i, f"text number {i} of them", "s") for i in range(-3, 4)]
    bare = [(None, f"row {i % 40} without an id", "s") for i in range(200)] + [(None, None, "s")]
    for some in (rows + bare, bare, rows):
        order = sorted((r for r in some if r[0] is not None), key=lambda r: -r[0])
        least = min((t or "" for i, t, _ in some if i is None), default=None)
        texts = [t for _, t, _ in order] + ([least] if least is not None else [])
        after = {i: texts[(at + 1) % len(texts)] for at, (i, _, _) in enumerate(order)} | {None: texts[0]}

        def edited(i, t):
            cut = len(t) // 3
            return hashlib.sha256((t[:len(t) - cut] + after[i][:cut]).encode()).hexdigest()
        got = Counter((r.doc_id, r.edited_sha256) for r in imatch.edited_pairs(docs_of(spark, some)).collect())
        assert got == Counter((i, edited(i, t or "")) for i, t, _ in some)


def test_imatch_odd_tables(spark):
    assert imatch.edited_pairs(docs_of(spark, []).limit(0)).count() == 0
    one = imatch.edited_pairs(docs_of(spark, [(4, "abc def ghi", "s")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
    rows = [(1, "same words here", "s"), (1, "same words here", "s"), (2, "same words here", "s"), (2, "other text", "s")]
    got = imatch.edited_pairs(docs_of(spark, rows).withColumn("fp", F.lit(1))).collect()
    assert len(got) == 4
    assert len({r.fingerprint for r in got if r.n_chars == 15}) == 1
    fp = imatch.fingerprints(docs_of(spark, rows).withColumn("k", F.lit(1)))
    assert fp.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "imatch"]


# --- 2: chats

def test_marked_round_trip():
    odd = ["", "\\", "###", "####", "\\###", "</turn>", "\\</turn>\n", " </turn>\n### user: x", "a\\\\", "#" * 7, ": :", "é\U0001f600\n\n"]
    turns = [(r, t) for r in odd + ["assistant"] for t in odd]
    assert chat.Marked.parse(chat.Marked.render(turns)) == turns
    out, spans, contents, rewrites = chat.trace(chat.Marked.render, turns)
    assert not rewrites and "".join(out[a:b] for a, b in spans) == out
    assert [chat.Marked.unescape(out[a:b]) for a, b in contents] == [t for _, t in turns]


def test_rewriting_templates_are_found():
    def forgetful(turns):  # shows only the last assistant turn's text
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else '-'}\n" for i, (r, t) in enumerate(turns))
    out, spans, contents, rewrites = chat.trace(forgetful, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    assert rewrites == [3] and contents[1] is None
    assert out[slice(*contents[3])] == "d" and out[slice(*contents[0])] == "a"


def brute_digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    body = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
            len(chat.Marked.render(turns)))


def test_conversations_long_and_odd(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi\\", "### x </turn>", "ok " * 9]))
            for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(700)]  # a long one
    rows += [(78, None if t % 3 else 5, "user", f"t{t}") for t in range(300)]  # long, tied and without turns
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 99, "user", "twice"), (3, 99, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(df.repartition(5)).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == brute_digest(turns)
    assert chat.digests(df.limit(0)).count() == 0
    seg = chat.render_conversations(df.where("conv_id = 77")).collect()
    assert len(seg) >= 700 // chat.SEGMENT and "".join(s.formatted for s in sorted(seg, key=lambda s: (s.block, s.seq))) == \
        chat.Marked.render(by[77])
    for x in seg:
        assert "".join(x.formatted[t.start:t.stop] for t in x.turns) == x.formatted and not x.rewrites


def test_rewrites_are_reported_per_conversation(spark):
    class Forgetful:  # shows the last assistant turn's text only; not local
        local = False

        @staticmethod
        def render(turns):
            last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
            return "".join(f"[{r}]{t if r != 'assistant' or i == last else '-'}\n" for i, (r, t) in enumerate(turns))
    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t}") for c in (1, 2) for t in range(100 if c == 1 else 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.render_conversations(df, Forgetful).collect()}
    assert len(got) == 2 and list(got[2].rewrites) == [] and list(got[1].rewrites) == list(range(3, 100, 2))
    last = got[1].loss[-1]
    assert got[1].formatted[last.start:last.stop] == "t99"


# --- 3: pages

def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("body,want", [
    ("<nav><a>menu</a></nav><article><h1>T &amp; t</h1><p>a\n  b<br>c<p>d &lt;&#233;&nbsp;x</article><footer>f</footer>", "T & t\na b c\nd <é x"),
    ("<div class='ad'>buy</div><article><p>one <b>bold<p>two</p><aside>side</aside><div id=comments><p>me too</div>three</article>tail", "one bold\ntwo\nthree"),
    ("<main><form><p>mail</form><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></main>", "x\ny\n1 2\n3"),
    ("<article><header><h1>Head</h1></header><!-- <p>no</p> --><p>yes</p><div class='cookie-notice'>c</div></article>", "Head\nyes"),
    ("<article><p>in</p></article><article class='comment'><p>reader</p></article>", "in"),
    ("<article><p>unclosed &am <i>x", "unclosed &am x"),
    ("<header><p>h</header><p>only body</p>", "only body"),
    ("", ""),
])
def test_lines_of_a_page(body, want):
    assert pagediff.main_text(page(body), None) == want


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        at = pagediff.shared(a, b)
        assert at == sorted(set(at)) and len(at) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in at)  # a subsequence of b


def test_shared_lines_of_nearest_pages_go(spark):
    def plain(text, n):
        return page(f"<div>Site name</div><div>Sections</div><p>{text}</p><p>{text} more</p><div>Imprint {n % 2}</div>")
    rows = [(i, f"http://h.example.org/a/{i}", plain(f"story number {i} tells of {i * i}", 0)) for i in range(6)]
    rows += [(50, "http://other.org/x", plain("alone on its host", 1)), (51, None, None), (52, "no scheme", ""), (None, "http://z.org/", plain("no id", 1))]
    rows += [(60, "http://copy.org/1", plain("a copied story", 0)), (61, "http://copy.org/2", plain("a copied story", 0))]
    rows += [(70, "http://art.org/1", page("<article><p>same</p></article>")), (70, "http://art.org/1", page("<article><p>same</p></article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = pagediff.extract(df.repartition(3)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    text = {r.page_id: r.text for r in got}
    for i in range(6):
        assert text[i] == f"story number {i} tells of {i * i}\nstory number {i} tells of {i * i} more"
    assert "alone on its host" in text[50] and text[50].startswith("Site name")
    assert text[51] == text[52] == "" and "no id" in text[None]
    assert "a copied story" in text[60] and "a copied story" in text[61] and text[70] == "same"
    assert all(r.n_chars == len(r.text) for r in got)
    assert pagediff.extract(df.limit(0)).count() == 0


# --- 4: secrets

def brute_base(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_spans_are_the_contract():
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "\u017fecret", "to\u212aen", "=", ":", " ", "\"", "'", "AKIA", "AKIA" + "A" * 14,
            "0123456789abcdef", "deadbeef", "Zz-._+/=", "é", "\U0001f600", "x" * 12, "\n", "ABCDEF0123456789"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert secretscan.base_spans(text) == brute_base(text)


def test_scan_learns_forms_and_keeps_base(spark):
    rng = random.Random(12)
    hexs, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=letters: "".join(rng.choice(a) for _ in range(n))
    rows, planted = [], set()
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(20)]
        kind = rng.randrange(6)
        extra = ["", f"token = {key(32)}", f"password: '{key(40, hexs)}'", f"mail user{i}.name{i}@host{i}.example.com now",
                 f"see https://host{i}.example.org/path/{i}.html", f"the id {key(32)} stands alone"][kind]
        if kind == 5:
            planted.add(i)
        rows.append((i, " ".join(words[:10] + [extra] + words[10:]), "s"))
    rows += [(9000, None, "s"), (9001, "", "s"), (None, "secret=abcdefghijkl", "s"), (9002, "word " * 60000 + "AKIA" + "Q" * 20, "s")]
    docs = docs_of(spark, rows).withColumn("spans", F.lit(1))
    got = {r.doc_id: r.out for r in secretscan.secrets(docs, secretscan.fit(docs), out="out").collect()}
    for i, t, _ in rows:
        want = brute_base(t or "")
        joined = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, b, k in want)
        assert got[i].base == joined
        assert [got[i][x] for x in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, _, k in want) for j in range(3)]
        assert not want or set(joined.split(",")) <= set(got[i].spans.split(","))
    added = {i for i, x in got.items() if x.spans != x.base}
    assert len(added & planted) >= 0.9 * len(planted) and len(added - planted) <= 9
    assert secretscan.secrets(docs.limit(0), secretscan.fit(docs.limit(0)), out="out").count() == 0


# --- 5: lines

def test_line_spread_against_brute_force(spark):
    rng = random.Random(10)
    rows = []
    shared = [f"boiler line {k}" for k in range(40)]  # line k stands on about k sites: below, near and above the threshold
    for i in range(400):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(1, 6))]
        own += [x for k, x in enumerate(shared) if rng.random() < k / 300]
        rng.shuffle(own)
        rows.append((i, "\n".join(x + rng.choice(["", " ", "\r"]) for x in own), rng.choice([None] + [f"s{n}" for n in range(25)])))
    rows += [(1000 + n, "copied whole\nsecond line", f"s{n}") for n in range(20)]  # copies are one document
    rows += [(2000 + n, f"near copy\nlong common body of the text in every copy\n{n}", f"s{n}") for n in range(20)]
    rows.append((2100, "boiler line 39", "s1"))  # nothing but boilerplate: left empty
    rows += [(3000, None, "s1"), (3001, "", "s2"), (3002, "\n\n", "s3"), (None, "no id\nboiler line 39", "s4"), (5, rows[5][1], rows[5][2])]
    docs = docs_of(spark, rows).withColumn("found", F.lit("x"))
    got = linespread.remove(docs)
    assert got.columns == docs.columns + ["_n_lines", "_n_removed"]
    assert sorted(((r.doc_id, r.text, r._n_removed) for r in got.collect()), key=str) == brute_lines(rows, linespread.MIN_SITES)
    assert any(n for _, _, n in brute_lines(rows, linespread.MIN_SITES))
    left = {r.doc_id: r.text for r in got.where("doc_id >= 1000").collect()}
    assert left[2100] == "" and left[1000] == "copied whole\nsecond line" and left[2000] == "0"
    assert linespread.dedup_lines(docs.limit(0)).count() == 0


# --- 7: URLs

def test_hosts_paths_and_rules(spark):
    rows = [("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), ("https://b.net", "b.net", "", None),
            ("https://net/", "net", "/", "net/"), ("x://mynet/", "mynet", "/", None), (None, "", "", None), ("no scheme", "", "", None),
            ("http://é.Org/fr/a\nb", "é.org", "/fr/a\nb", "org/fr/"), ("http://example.net/EN/", "example.net", "/EN/", "net/"),
            ("http://a?b://c/d", "a", "", None), ("http://example.com/de", "example.com", "/de", None), ("://h/p#x?y", "h", "/p", None)]
    df = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urltree.judge(df.withColumn("verdict", F.lit(1)), labels).collect()}
    for i, (_, host, path, rule) in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (dict(urltree.RULES)[rule] if rule else "allow")
    assert urltree.judge(df.limit(0), labels).count() == 0


def test_bad_branches_are_blocked(spark):
    rows, labels = [], []
    for i in range(4000):
        section = ["news", "spam", "blog"][i % 3]
        tail = str(i) if i % 2 else f"slug-{i}"
        rows.append((i, f"http://site.example/{section}/{tail}", None))
        labels.append((i, 0 if section == "spam" and i % 10 else 1, 0))
    rows += [(9000 + i, f"http://bad.example/{i}.html", None) for i in range(100)] + [(9000, "http://bad.example/0.html", None), (None, "http://bad.example/q", None)]
    labels += [(9000 + i, 1, 1) for i in range(60)] + [(None, 0, 0), (9001, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urltree.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.verdict == ("block" if "/spam/" in r.path or r.host == "bad.example" and r.page_id is not None else r.verdict)
        if r.host == "site.example" and "/spam/" not in r.path:
            assert r.verdict == "allow"


def labelled_pages(spark, groups):
    """groups: (urls, share of bad pages as one in k, 0 for none)."""
    rows, labels = [], []
    for urls, one_in in groups:
        for j, url in enumerate(urls):
            labels.append((len(rows), 0 if one_in and j % one_in == 0 else 1, 0))
            rows.append((len(rows), url, None))
    return (spark.createDataFrame(rows, "page_id long, url string, html string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_deep_branches_are_told_apart(spark):
    site = "http://site.example"
    groups = [([f"{site}/forum/casino/{i}" for i in range(300)], 1), ([f"{site}/forum/help/{i}" for i in range(600)], 0),
              ([f"{site}/a/b/c/d/bad/{i}/" for i in range(300)], 1), ([f"{site}/a/b/c/d/good/{i}" for i in range(600)], 0),
              ([f"{site}/en/{i}" for i in range(300)], 0), ([f"{site}/en/{i}/" for i in range(300)], 0),
              (["http://long.example" + "/x" * 60 + "/1"], 1), ([f"http://long.example/y/{i}" for i in range(99)], 0)]
    pages, labels = labelled_pages(spark, groups)
    got = urltree.judge(pages, labels).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.verdict == ("block" if "/casino/" in r.path or "/bad/" in r.path else "allow")
    p, leaves = urltree.templates(pages, labels)
    assert leaves.where("host = 'site.example' and pattern = 'en/*'").first().n == 600
    assert urltree.tree(leaves).count() == leaves.count()


def test_bad_directory_among_many(spark):
    """A directory is judged by its own pages, with 51 siblings or more as with few."""
    for others in (49, 50, 200):
        groups = [([f"http://site.example/dir{d}/{i}" for i in range(5)], 0) for d in range(others)]
        groups.append(([f"http://site.example/casino/{i}" for i in range(300)], 1))
        groups += [([f"http://deep.example/a/dir{d}/{i}" for i in range(5)], 0) for d in range(others)]
        groups.append(([f"http://deep.example/a/casino/{i}" for i in range(300)], 1))
        for r in urltree.judge(*labelled_pages(spark, groups)).collect():
            assert r.verdict == ("block" if "/casino/" in r.path else "allow")


def test_unnamed_keys_of_held_out_documents(spark):
    """Recall and precision on keys without a name before them, in documents the fit never saw."""
    rng = random.Random(31)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    words = "alpha beta gamma internationalisation responsibilities donaudampfschiff 123456789012 and/or/otherwise of the".split()

    def prose(extra):
        some = [rng.choice(words) for _ in range(30)]
        return " ".join(some[:15] + [extra] + some[15:])
    named = [prose(f"{rng.choice(['token', 'secret', 'api_key'])} = {key(rng.choice([20, 24, 32, 40]), letters + rng.choice(['', '0123456789']))}") for _ in range(1500)]
    plain = [prose(rng.choice(["", f"see https://host{i}.example.org/path/{i}.html"])) for i in range(1500)]
    model = secretscan.fit(docs_of(spark, [(i, t, "s") for i, t in enumerate(named + plain)]))
    assert model.borrowed == (0,) and model.thresholds[0] == model.thresholds[1] < 1
    hidden = [key(n, a) for n in (28, 35) for a in (letters, letters + "0123456789") for _ in range(100)]  # letters alone, too
    texts = [prose(k) for k in hidden] + [prose("") for _ in range(400)]
    got = [r["spans"] for r in secretscan.scan(texts, model)]
    want = [f"cnn:{t.index(k)}:{t.index(k) + len(k)}" for t, k in zip(texts, hidden)]
    hits = sum(w in g.split(",") for w, g in zip(want, got))
    added = sum(len([s for s in g.split(",") if s]) for g in got)
    assert hits >= 0.9 * len(hidden) and hits >= 0.9 * added, (hits, added)


def test_candidates_next_to_spans():
    rng = random.Random(4)
    for _ in range(500):
        ends = sorted(rng.sample(range(60), 2 * rng.randrange(1, 6)))
        cands = list(zip(ends[::2], ends[1::2]))
        spans = sorted((a, a + rng.randrange(1, 15), 0) for a in rng.sample(range(60), rng.randrange(6)))
        want = [not any(a < hi and lo < b for a, b, _ in spans) for lo, hi in cands]
        assert secretscan.uncovered(cands, spans) == want


def test_long_candidates_are_seen_whole():
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    path = lambda n: "/".join(rng.choice(["docs", "page1", "images", "2024", "index"]) for _ in range(n))
    for n in range(12, 300):
        seen = {x for a, b in secretscan.parts(7, 7 + n) for x in range(a, b)}
        assert seen == set(range(7, 7 + n)) and all(b - a <= secretscan.BODY for a, b in secretscan.parts(7, 7 + n))
    cuts = []
    for _ in range(700):
        cuts += secretscan.labelled(f"see {path(12)}/1.html and token = {key(32)} here")
        cuts += secretscan.labelled(f"at {path(12)}/{rng.choice(['token=', 'secret='])}{key(40)} then")
        cuts += secretscan.labelled(f"visit {path(3)}/page7 and more")
    rng.shuffle(cuts)
    model = secretscan.train(cuts)
    model.thresholds = (0.5, 0.5)
    for _ in range(20):
        text = f"go to {path(12)}/{key(40)} now"  # the key begins behind the first BODY characters
        plain = f"go to {path(20)}/page1 now"
        spans = [secretscan.scan([t], model)[0]["spans"] for t in (text, plain)]
        assert spans == [f"cnn:6:{len(text) - 4}", ""]
    both = f"id {key(22)}+{'0123456789abcdef'}+{key(22)} end"  # the hex run in it is a base span
    got = secretscan.scan([both], model)[0]
    assert got["base"] != got["spans"] and f"cnn:3:{len(both) - 4}" in got["spans"]
    assert secretscan.scan([f"token = {key(32)}"], model)[0]["spans"].startswith("assign:0:40")


def test_thresholds_keep_the_promised_recall(spark):
    rng = random.Random(9)
    model = secretscan.train([])
    for low in (-4.0, -0.5, 3.0):  # positives that mostly score below even odds, and above
        scores = sorted(rng.gauss(low, 1) for _ in range(400))
        counts = Counter((1, 1, math.floor(x / secretscan.BIN)) for x in scores)
        counts += Counter((1, 0, math.floor(rng.gauss(low - 3, 1) / secretscan.BIN)) for _ in range(900))
        got = secretscan.calibrate(model, [(*k, n) for k, n in counts.items()])
        a, b = got.scale
        kept = sum(1 / (1 + math.exp(-(a * x + b))) >= got.thresholds[1] for x in scores)
        assert 0.95 * 400 <= kept <= 0.97 * 400
        assert got.thresholds[0] == got.thresholds[1] and got.borrowed == (0,)  # none of class 0 were labelled
    assert secretscan.calibrate(model, [(1, 0, 5, 9)]).thresholds == (2.0, 2.0)
    # a class that the sample has hardly any of gets its threshold from all documents
    key = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    rows = [(i, f"see page{i}/of/the/site and token = {key(32, 'abcdXYZW0123456789')} here", "s") for i in range(300)]
    rows += [(300 + i, f"sum {key(40, 'abcdef0123456789')} of it", "s") for i in range(40)]
    docs = docs_of(spark, rows)
    model = secretscan.fit(docs, secretscan.Fit(docs=150, findings=60, epochs=3))
    assert all(0 <= t < 1 for t in model.thresholds)


def test_small_bad_directories_do_not_take_clean_ones_along(spark):
    """100 directories of 5 bad pages and 100 of 5 clean ones: the bad half is blocked, no clean page; with the
    bad pages dealt at random (a share of 0.3) no directory is."""
    def judged(host, bad):
        pages = [(1000 * d + i, f"http://{host}/d{d}/{i}.html") for d in range(200) for i in range(5)]
        labels = [(p, 0 if bad(p // 1000, p % 1000) else 1, 0) for p, _ in pages]
        df = spark.createDataFrame([(*p, None) for p in pages], "page_id long, url string, html string")
        out = urltree.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        return {r.page_id for r in out if r.verdict == "block"}
    assert judged("mixed.example.io", lambda d, i: d < 100) == {1000 * d + i for d in range(100) for i in range(5)}
    rng = random.Random(12)
    dealt = {(d, i): rng.random() < 0.3 for d in range(200) for i in range(5)}
    assert judged("even.example.io", lambda d, i: dealt[d, i]) == set()
