"""Main-text extraction by nearest-URL page differencing.

Pages are ordered by host and URL path; a page's partner is the neighbour of the same
host that shares the longer path prefix with it. The text lines of the two pages
are aligned by their longest common subsequence, and lines they share are template
text: they are deleted.

Differencing alone can't give the article: in one site's pages menus, adverts and
footers may differ from page to page, while articles may repeat each other's lines.
So lines come with what the markup says of them. Lines inside an ``article`` or
``main`` element are not deleted for being shared. Of what the alignment leaves, lines
inside elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments (by element, role or a word of the class or id)
go too, and if there is an article, all lines outside it. If the alignment would
delete more than ``COPY_SHARE`` of a page's open lines (neither article nor dropped),
the page is a copy of its partner and keeps them.

Pairing and alignment move keys and 8-byte line hashes only; the order of a hot
host's pages is found over range partitions. What moves back to the html is the list of
deleted lines of the pages that have any, behind a size check. The alignment needs
memory in proportion to the two pages' lines.

Null and empty html give an empty text. Pages without a host (or a null url) form one
host. Repeated rows are paired with each other and keep their lines.
"""

from __future__ import annotations

import html as html_lib
import os
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewater.llm.common import maybe_broadcast, neighbours, setup, stage_table
from tidewater.llm.urltree import host_of, path_of

COPY_SHARE = 0.8
CHROME, OPEN, MAIN = 0, 1, 2

# Fixed values of HTML: elements without content, with raw content, and those that end a line.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe noscript xmp template".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
             "tfoot thead tr ul".split())
_DROP = set("nav header footer aside form button select dialog menu search svg canvas object head".split())
_DROP_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_DROP_WORDS = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banners?|sidebars?|aside|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|"
    r"recommended|comments?|replies|respond|disqus|pagination|pager|toolbar|widget|skip)$")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _dropped(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element holds none of the main text."""
    if tag in _DROP and not (tag == "header" and in_main):  # an article's own header is its title
        return True
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _DROP_ROLES:
                return True
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if any(_DROP_WORDS.match(w) for word in value.split() for w in re.split(r"[-_]+", word)):
                    return True
            if name in ("class", "id") and tag == "article" and re.search(r"\bcomments?\b", value):
                return True
    return False


def lines(html: str | None) -> list[tuple[str, int]]:
    """(line, zone) of each text block, in page order: MAIN, OPEN, or CHROME for dropped elements."""
    html = html or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, main; each with what it inherits
    parts: list[str] = []
    at = 0

    def end_line():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, dropped, main = stack[-1] if stack else ("", False, False)
            out.append((text, CHROME if dropped else MAIN if main else OPEN))

    def pop_to(i: int):
        end_line()
        del stack[i:]

    def add(text: str):
        if text:
            parts.append(html_lib.unescape(text))

    while m := _TOKEN.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag closes the nearest open element of its name, and what is open inside
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0 and (tag in _BLOCK or all(x[0] not in _BLOCK for x in stack[i + 1:])):
                if tag in _BLOCK or stack[i][1]:
                    pop_to(i)
                else:
                    del stack[i:]
            elif tag in _BLOCK:
                end_line()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag in _BLOCK:
            end_line()
            # a paragraph ends where the next block starts, an item where the next one does
            scope = ("p",) if tag not in ("li", "dd", "dt", "tr") else ("p", tag)
            stop = ("ul", "ol", "dl", "table") if tag in ("li", "dd", "dt", "tr") else _BLOCK - {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    pop_to(i)
                    break
                if stack[i][0] in stop:
                    break
        elif tag in ("td", "th"):
            parts.append(" ")
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        up = stack[-1] if stack else ("", False, False)
        drop = up[1] or _dropped(tag, m[3], up[2])
        if drop and not up[1]:
            end_line()
        stack.append((tag, drop, up[2] or tag in ("article", "main")))
    add(html[at:])
    end_line()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, bit-parallel."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, in memory linear in both."""
    in_b, in_a = set(b), set(a)
    # what only one side has is in no common subsequence
    pos = [i for i, x in enumerate(a) if x in in_b]
    out: list[int] = []

    def split(lo: int, hi: int, b: list):
        while lo < hi and b and a[pos[lo]] == b[0]:
            out.append(pos[lo])
            lo, b = lo + 1, b[1:]
        tail = []
        while lo < hi and b and a[pos[hi - 1]] == b[-1]:
            tail.append(pos[hi - 1])
            hi, b = hi - 1, b[:-1]
        if hi - lo == 1 and a[pos[lo]] in b:
            out.append(pos[lo])
        elif hi - lo > 1 and b:
            mid = (lo + hi) // 2
            left = _lengths([a[pos[i]] for i in range(lo, mid)], b)
            right = _lengths([a[pos[i]] for i in range(hi - 1, mid - 1, -1)], b[::-1])[::-1]
            j = int(np.argmax(left + right))
            split(lo, mid, b[:j])
            split(mid, hi, b[j:])
        out.extend(reversed(tail))
    split(0, len(pos), [y for y in b if y in in_a])
    return out


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def outline(html: str | None) -> tuple[list[int], list[int]]:
    """(hash, 4 * length + zone) of each line."""
    found = lines(html)
    return [_hash(line) for line, _ in found], [4 * len(line) + zone for line, zone in found]


def deleted(hashes: list[int], shapes: list[int], partner: list[int]) -> list[int]:
    """Positions of the lines that the alignment with the partner's lines deletes."""
    gone = [i for i in shared(hashes, partner) if shapes[i] % 4 != MAIN]
    size = sum(x // 4 for x in shapes if x % 4 == OPEN)
    if sum(shapes[i] // 4 for i in gone if shapes[i] % 4 == OPEN) > COPY_SHARE * size:
        gone = [i for i in gone if shapes[i] % 4 != OPEN]
    return gone


def main_text(html: str | None, gone=None) -> str:
    """The page's main text, without the lines at the positions ``gone``."""
    gone = set() if gone is None else set(int(i) for i in gone)
    left = [x for i, x in enumerate(lines(html)) if i not in gone]
    zone = MAIN if any(z == MAIN for _, z in left) else OPEN
    return "\n".join(line for line, z in left if z == zone)


@pandas_udf(StructType([StructField("hashes", ArrayType(LongType())), StructField("shapes", ArrayType(LongType()))]))
def _outlines(htmls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outline(h) for h in htmls], columns=["hashes", "shapes"])


@pandas_udf(ArrayType(LongType()))
def _deleted(hashes: pd.Series, shapes: pd.Series, partners: pd.Series) -> pd.Series:
    return pd.Series([deleted([int(h) for h in a], [int(x) for x in b], [int(h) for h in c])
                      for a, b, c in zip(hashes, shapes, partners)], dtype="object")


@pandas_udf(StringType())
def _main_texts(htmls: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([main_text(h, g) for h, g in zip(htmls, gone)], dtype="object")


@pandas_udf(LongType())
def _common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([-1 if y is None else len(os.path.commonprefix((x, y))) for x, y in zip(a, b)], dtype="int64")


def partners(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``pages(host, path, *keys)``: adds ``partner``, the struct of keys of the neighbour by
    (host, path) that shares more of the path (the one before on a tie); null for a host's only page."""
    order = neighbours(pages.select("host", "path", *keys), ["host", "path", *keys])

    def near(side):
        return F.when(F.col(f"{side}.host") == F.col("host"), F.col(f"{side}.path"))
    order = order.withColumn("_p", _common_prefix("path", near("prev"))).withColumn("_n", _common_prefix("path", near("next")))
    side = F.when((F.col("_p") >= F.col("_n")) & (F.col("_p") >= 0), F.col("prev")).when(F.col("_n") >= 0, F.col("next"))
    return order.select(*keys, F.struct(*[side.getField(k).alias(k) for k in keys]).alias("partner"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    setup(pages.sparkSession)
    keys = ["k1", "k2"]
    t = pages.select("page_id", "url", "html", F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("k1"),
                     F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("k2"))
    plan = stage_table(t.select(*keys, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                                _outlines("html").alias("o")).select(*keys, "host", "path", "o.*"), "outlines")
    own = plan.select(*keys, "hashes", "shapes").dropDuplicates(keys)  # repeated rows share keys
    theirs = own.select(F.struct(*keys).alias("partner"), F.col("hashes").alias("partner_hashes"))
    pairs = partners(plan.select("host", "path", *keys), keys).where("partner.k1 is not null").dropDuplicates(keys)
    gone = (pairs.join(theirs, "partner").join(own, keys)
            .select(*keys, _deleted("hashes", "shapes", "partner_hashes").alias("gone")).where(F.size("gone") > 0))
    gone = stage_table(gone, "deleted")
    return (t.join(maybe_broadcast(gone), keys, "left")
            .select("page_id", "url", _main_texts("html", "gone").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
