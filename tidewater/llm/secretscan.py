"""Secret scans: fixed patterns plus a character convolutional network in numpy.

Three patterns (assignments to password-like names, access keys, long hexadecimal
runs) give the base spans, which always stand. A candidate is any run of 12 and more
token characters, wherever it stands in the text; long words are candidates too. The
network sees windows of ``BODY`` characters of it, ``STEP`` apart and over all of it, each
with ``LEFT`` characters before and ``RIGHT`` after; a candidate is accepted by any of its
windows. Accepted candidates of which a character is in no base span are added whole, as
kind ``cnn``; the others are reported already.

It is trained on labelled findings of the corpus: candidates of a bounded sample of
documents (``Fit.docs``), window by window: positive where a base span overlaps, negative
where not and the candidate's form is not a key's either (`keylike`: a long piece that mixes
character classes often). A window of a longer candidate that holds a few characters of a
span alone is left out.
What looks like a key but has no name before it is unknown and not trained on. Each
positive comes ``RENAMED`` more times with its left context replaced by that of a negative, so
that a secret's form counts without the name before it. The weights are trained on part of
the sample. The scores are calibrated (Platt scaling) and the thresholds set by counts of
(class, label, score bin) over the labelled windows of all documents, without those the
weights may come from: per class of window, the largest with at least ``MIN_RECALL`` of the
positives, whatever it is. A class without positives takes the highest threshold of the
others (``Model.borrowed`` names it).

Offsets are code points, ends exclusive. Null and empty texts have no spans. Without
positives of any class, nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewater.llm.bytecnn import Adam, convolve, sigmoid, table_gradient
from tidewater.llm.common import setup

KINDS = ("assign", "access", "hex", "cnn")
LEFT, BODY, RIGHT = 20, 44, 8
WIDTH = LEFT + BODY + RIGHT
STEP = BODY // 2
SHORTEST = 12  # characters of a candidate
KERNEL, FILTERS = 5, 16
RENAMED = 3
MIN_RECALL = 0.95
BIN, BINS = 0.01, 3000  # of a score (a logit), and bins on either side of zero
CLASSES = 2  # lower-case hexadecimal candidates, and all others
RESULT = "struct<n_assign:bigint, n_access:bigint, n_hex:bigint, base:string, spans:string>"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters and more
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_PIECE = re.compile(r"[A-Za-z0-9]{12,}")
_CHANGES = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])")
_IS_HEX = re.compile(r"[0-9a-f]+")


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit."""
    docs: int = 6000        # documents in the sample, about
    findings: int = 6000    # candidates kept of them, at most, half of either label
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class Model:
    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: tuple[float, float]  # Platt: probability = sigmoid(scale[0] * logit + scale[1])
    thresholds: tuple[float, ...]  # by class
    borrowed: tuple[int, ...] = ()  # classes without labelled positives


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start and then kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def keylike(token: str) -> bool:
    """Whether a piece of 12 letters and digits or more changes its character class 4 times or more."""
    return any(len(_CHANGES.findall(piece)) >= 4 for piece in _PIECE.findall(token))


def uncovered(cands: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each candidate overlaps no span; both ascend by start, one pass over the two."""
    out, at, reach = [], 0, -1
    for lo, hi in cands:
        while at < len(spans) and spans[at][0] < hi:
            reach = max(reach, spans[at][1])
            at += 1
        out.append(reach <= lo)
    return out


def beyond(cands: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each candidate has a character in no span; both ascend by start, one pass over the two."""
    whole = []  # the spans' union
    for lo, hi, _ in spans:
        if whole and lo <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], hi)
        else:
            whole.append([lo, hi])
    out, at = [], 0
    for lo, hi in cands:
        while at < len(whole) and whole[at][1] < hi:
            at += 1
        out.append(at == len(whole) or whole[at][0] > lo)
    return out


def parts(lo: int, hi: int) -> list[tuple[int, int]]:
    """The candidate's windows: one if it fits, else overlapping ones, the last at its end."""
    return [(at, at + BODY) for at in range(lo, hi - BODY, STEP)] + [(max(lo, hi - BODY), hi)]


def window(text: str, lo: int, hi: int) -> bytes:
    """A window and its context in WIDTH bytes; characters beyond ASCII are one byte."""
    def part(s: str) -> bytes:
        return s.encode("ascii", "replace")
    left, body, right = part(text[max(0, lo - LEFT):lo]), part(text[lo:hi]), part(text[hi:hi + RIGHT])
    return left.rjust(LEFT, b"\0") + body.ljust(BODY, b"\0") + right.ljust(RIGHT, b"\0")


def labelled(text: str) -> list[tuple[bytes, int, int]]:
    """(window, class, label) of the candidates' windows; what looks like a key without a span is left out."""
    cands, spans = candidates(text), base_spans(text)
    cuts = [parts(lo, hi) for lo, hi in cands]
    free = iter(uncovered([w for c in cuts for w in c], spans))
    # the windows with a span in all but their first or last SHORTEST - 1 characters
    deep = iter(uncovered([(a + SHORTEST - 1, b - SHORTEST + 1) if len(c) > 1 else (a, b) for c in cuts for a, b in c], spans))
    out = []
    for (lo, hi), cut in zip(cands, cuts):
        odd = keylike(text[lo:hi])
        for a, b in cut:
            none, few = next(free), next(deep)
            if not few or none and not odd:
                out.append((window(text, a, b), _class(text[a:b]), int(not few)))
    return out


def _class(token: str) -> int:
    return 0 if _IS_HEX.fullmatch(token) else 1


def _rows(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)


def _logits(p: dict, rows: np.ndarray) -> np.ndarray:
    real = np.full(len(rows), WIDTH - KERNEL + 1)
    top, _ = convolve(p["table"], p["bias"], rows, real, 1)
    return top @ p["weight"] + p["offset"]


def _held(window: bytes) -> bool:
    """Whether a window of the sample is kept from the weights."""
    return zlib.crc32(window) % 5 <= 1


def _renamed(rows, y, rng):
    yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    yes = np.tile(yes, RENAMED)
    moved = rows[yes].copy()
    moved[:, :LEFT] = rows[rng.choice(no, len(yes)), :LEFT]
    return moved, y[yes]


def train(findings: list[tuple[bytes, int, int]], fit: Fit = Fit()) -> Model:
    """The weights, fitted on those of ``findings`` (window, class, label), in a fixed random
    order, that are not held; scores are not calibrated and no class is accepted yet."""
    rng = np.random.default_rng(fit.seed)
    findings = [f for f in findings if not _held(f[0])]
    rows = _rows([f[0] for f in findings]) if findings else np.zeros((0, WIDTH), np.uint8)
    y = np.array([f[2] for f in findings], np.int64)
    p = {"table": rng.normal(0, 0.1, (KERNEL, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
         "weight": rng.normal(0, 0.1, FILTERS), "offset": np.array(0.0)}
    if 0 < y.sum() < len(y):
        # a secret's form without the name before it: each positive comes again with
        # negatives' left contexts
        x, t = (np.concatenate(z) for z in zip((rows, y), _renamed(rows, y, rng)))
        net, real = Adam(p), np.full(fit.batch, WIDTH - KERNEL + 1)
        for epoch in range(fit.epochs):
            order = rng.permutation(len(t))
            for at in range(0, len(t), fit.batch):
                ids = order[at:at + fit.batch]
                top, where = convolve(p["table"], p["bias"], x[ids], real[:len(ids)], 1)
                err = (sigmoid(top @ p["weight"] + p["offset"]) - t[ids]) / len(ids)
                dtop = err[:, None] * p["weight"] * (top > 0)
                net.update({"weight": top.T @ err + 1e-4 * p["weight"], "offset": err.sum(), "bias": dtop.sum(axis=0),
                            "table": table_gradient(p["table"], x[ids], where, dtop, 1)}, fit.rate * (1 - epoch / fit.epochs))
    return Model(p["table"], p["bias"], p["weight"], float(p["offset"]), (1.0, 0.0), (2.0,) * CLASSES)


def calibrate(model: Model, counts: list[tuple[int, int, int, int]]) -> Model:
    """``model`` with scale and thresholds from (class, label, score bin, number) of labelled windows."""
    kind, t, at, n = (np.array(x, np.int64) for x in (zip(*counts) if counts else [()] * 4))
    a, b = 1.0, 0.0
    z, yes, no = (at + 0.5) * BIN, n[t == 1].sum(), n[t == 0].sum()
    if yes and no:  # Platt scaling with smoothed targets, by gradient steps
        goal = np.where(t == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
        for _ in range(300):
            d = sigmoid(a * z + b) - goal
            a, b = (a - 0.1 * float(np.average(d * z, weights=n)) / max(1.0, float(np.average(z * z, weights=n))),
                    b - 0.1 * float(np.average(d, weights=n)))
        if a <= 0:  # the order of the scores stays
            a, b = 1.0, 0.0
    thresholds = []
    for c in range(CLASSES):
        own = np.flatnonzero((t == 1) & (kind == c))
        own = own[np.argsort(-at[own])]
        kept = np.cumsum(n[own])
        if not len(own):
            thresholds.append(None)
            continue
        last = int(at[own[int(np.searchsorted(kept, np.ceil(MIN_RECALL * kept[-1])))]])
        # the lower edge of the bin that makes MIN_RECALL full; the lowest bin has none
        thresholds.append(float(sigmoid(a * (last * BIN) + b)) if last > -BINS else 0.0)
    own = [x for x in thresholds if x is not None]
    return replace(model, scale=(a, b), thresholds=tuple(max(own, default=2.0) if x is None else x for x in thresholds),
                   borrowed=tuple(c for c, x in enumerate(thresholds) if x is None))


def score_counts(texts: list[str], sampled: list[bool], model: Model, contexts: list[bytes]) -> Counter:
    """Number of labelled windows by (class, label, score bin); of the sample's texts the
    held ones alone. Each positive counts a second time with a left context of ``contexts``."""
    out = Counter()
    for text, mine in zip(texts, sampled):
        found = [f for f in labelled(text) if not mine or _held(f[0])]
        if contexts:
            found += [(contexts[zlib.crc32(w[::-1]) % len(contexts)] + w[LEFT:], k, y) for w, k, y in found if y]
        for at in range(0, len(found), 1024):
            some = found[at:at + 1024]
            bins = np.clip(np.floor(_logits(vars(model), _rows([f[0] for f in some])) / BIN), -BINS, BINS - 1).astype(int)
            out.update((k, y, int(i)) for (_, k, y), i in zip(some, bins))
    return out


def scan(texts: list[str | None], model: Model) -> list[dict]:
    """Spans of every text; the candidates of all the texts are scored together."""
    base = [base_spans(t or "") for t in texts]
    more = []
    for i, t in enumerate(texts):
        cands = candidates(t or "")
        more += [(i, c, a, b) for c, new in zip(cands, beyond(cands, base[i])) if new for a, b in parts(*c)]
    spans, taken = [list(b) for b in base], set()
    for at in range(0, len(more), 1024):
        some = more[at:at + 1024]
        rows = _rows([window(texts[i], a, b) for i, _, a, b in some])
        prob = sigmoid(model.scale[0] * _logits(vars(model), rows) + model.scale[1])
        taken |= {(i, c) for (i, c, a, b), s in zip(some, prob) if s >= model.thresholds[_class(texts[i][a:b])]}
    for i, c in taken:
        spans[i].append((*c, 3))
    out = []
    for b, s in zip(base, spans):
        n = [sum(kind == k for _, _, kind in b) for k in range(3)]
        out.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base": _joined(b), "spans": _joined(s)})
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(window, kind, label): the labelled windows of ``docs``."""
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.iloc[:, 0]:
                out += labelled(text)
            yield pd.DataFrame(out, columns=["window", "kind", "label"])
    return docs.select(text_col).where(F.col(text_col).isNotNull()).mapInPandas(run, "window binary, kind int, label int")


def fit(docs: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The network, its weights fitted on the findings of about ``fit.docs`` documents, chosen
    by id hash, calibration and thresholds set on those of all documents."""
    setup(docs.sparkSession)
    n = docs.count()
    share = min(1.0, fit.docs / max(n, 1))
    pick = F.pmod(F.xxhash64(F.lit(fit.seed), F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20))
    order = F.xxhash64(F.lit(fit.seed), "window")
    found = findings(docs.where(pick), text_col)
    # long words outnumber secrets by far: half of the bound is for either label
    halves = [found.where(F.col("label") == y).orderBy(order, "window", "kind").limit(fit.findings // 2) for y in (0, 1)]
    rows = halves[0].unionByName(halves[1]).collect()
    rows = [(bytes(r["window"]), r["kind"], r["label"]) for r in rows]
    sent = docs.sparkSession.sparkContext.broadcast((train(rows, fit), [w[:LEFT] for w, _, y in rows if not y]))

    def run(batches):
        model, contexts = sent.value
        for batch in batches:
            found = score_counts(list(batch.iloc[:, 0]), list(batch.iloc[:, 1]), model, contexts)
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "label", "bin", "n"])
    counts = (docs.select(text_col, pick).where(F.col(text_col).isNotNull())
              .mapInPandas(run, "kind int, label int, bin int, n long").groupBy("kind", "label", "bin").agg(F.sum("n").alias("n")))
    if not 0 < sum(y for w, _, y in rows if not _held(w)) < sum(not _held(w) for w, _, _ in rows):
        return sent.value[0]
    return calibrate(sent.value[0], sorted(map(tuple, counts.collect())))


def secrets(docs: DataFrame, model: Model, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: counts of base spans, and base and all spans as ``kind:start:end`` lists."""
    setup(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scan(list(texts), sent.value), columns=["n_assign", "n_access", "n_hex", "base", "spans"])
    return docs.withColumn(out, of(F.col(text_col)))
