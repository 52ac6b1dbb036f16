"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each
filter sees ``KERNEL`` bytes at every ``STRIDE``-th position; since a byte is one
of 256 values, a filter is a table of one number per (offset, byte), and the
convolution is a sum of table rows. A chunk's features are the filters' maxima over
its positions; a document's are the mean, the maximum and the minimum of its chunks'
features (what is everywhere, anywhere, nowhere missing), combined by a layer of
``HIDDEN`` units into the probability of label 1.

The network is fitted in numpy on a bounded sample of labelled documents
(``Fit.rows`` documents of at most ``Fit.max_bytes`` bytes, those with the smallest
hashes); scoring covers every byte of every document in blocks of ``BLOCK`` chunks.

Null and empty texts are one chunk of padding and get the score of no evidence.
Without labels of both kinds every score is the smoothed share of label 1. Rows
without an id are scored; they are never fitted on. A document with several
labels counts as the larger one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewater.llm.bytecnn import Adam, convolve, sigmoid, table_gradient
from tidewater.llm.common import fresh, setup

CHUNK, OVERLAP = 512, 64
KERNEL, STRIDE, FILTERS, HIDDEN = 4, 2, 24, 24
POSITIONS = (CHUNK - KERNEL) // STRIDE + 1
BLOCK = 64  # chunks convolved at once: about 2 MB of activations
THRESHOLD = 0.3


@dataclass(frozen=True)
class Fit:
    """The bounds and settings of the fit."""
    rows: int = 5000
    max_bytes: int = 16_384
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    table: np.ndarray   # (KERNEL, 256, FILTERS)
    bias: np.ndarray    # (FILTERS,)
    w1: np.ndarray      # (3 * FILTERS, HIDDEN)
    b1: np.ndarray      # (HIDDEN,)
    w2: np.ndarray      # (HIDDEN,)
    b2: float


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, positions): the text in rows of CHUNK bytes, each starting OVERLAP bytes
    before the last one's end, zero-padded; and how many filter positions of each row are real."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]
    real = np.clip((len(text) - np.arange(n) * step + STRIDE - 1) // STRIDE, 0, POSITIONS)
    return rows, real


def _head(p, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden activations, logits) of pooled features."""
    a = np.maximum(x @ p["w1"] + p["b1"], 0)
    return a, a @ p["w2"] + p["b2"]


def score(model: Model, text: bytes | None) -> float:
    text = text or b""
    total, most, least, n = np.zeros(FILTERS), np.zeros(FILTERS), np.full(FILTERS, np.inf), 0
    step = (CHUNK - OVERLAP) * BLOCK
    for at in range(0, max(1, len(text) - OVERLAP), step):
        rows, real = chunks(text[at:at + step + OVERLAP])
        top, _ = convolve(model.table, model.bias, rows, real, STRIDE)
        total += top.sum(axis=0)
        most, least = np.maximum(most, top.max(axis=0)), np.minimum(least, top.min(axis=0))
        n += len(rows)
    _, z = _head(vars(model), np.concatenate([total / n, most, least])[None])
    return float(sigmoid(z)[0])


def train(texts: list[bytes], labels: list[int], fit: Fit = Fit()) -> Model:
    """Adam on the log loss; the gradient passes each maximum to its position."""
    rng = np.random.default_rng(fit.seed)
    y = np.asarray(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Adam({"table": rng.normal(0, 0.1, (KERNEL, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
                "w1": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN),
                "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.array(np.log(prior / (1 - prior)))})
    p = net.p
    if 0 < y.sum() < len(y):
        cut = [chunks(t) for t in texts]
        for epoch in range(fit.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), fit.batch):
                ids = order[at:at + fit.batch]
                rows, real = (np.concatenate([cut[i][j] for i in ids]) for j in (0, 1))
                sizes = np.array([len(cut[i][1]) for i in ids])
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                doc = np.repeat(np.arange(len(ids)), sizes)
                top, where = convolve(p["table"], p["bias"], rows, real, STRIDE)
                most, least = np.maximum.reduceat(top, first), np.minimum.reduceat(top, first)
                x = np.concatenate([np.add.reduceat(top, first) / sizes[:, None], most, least], axis=1)
                a, z = _head(p, x)
                err = (sigmoid(z) - y[ids]) / len(ids)
                da = err[:, None] * p["w2"] * (a > 0)
                mean_g, most_g, least_g = np.split(da @ p["w1"].T, 3, axis=1)
                dtop = mean_g[doc] / sizes[doc, None] + most_g[doc] * (top == most[doc]) + least_g[doc] * (top == least[doc])
                dtop *= top > 0
                net.update({"w2": a.T @ err, "b2": err.sum(), "w1": x.T @ da + 1e-5 * p["w1"], "b1": da.sum(axis=0),
                            "bias": dtop.sum(axis=0), "table": table_gradient(p["table"], rows, where, dtop, STRIDE)},
                           fit.rate * (1 - epoch / fit.epochs))
    else:
        p["w2"][:] = 0
    return Model(p["table"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"]))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents whose labels are never fitted on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The network fitted on at most ``fit.rows`` labelled documents outside the held-out fold."""
    by_hash = F.xxhash64(F.lit(fit.seed), "id")
    pool = labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality is not null")
    pool = pool.where(~held_out("id")).groupBy("id").agg(F.max("quality").alias("quality"))
    # twice the rows: some ids have no document or one that is too long
    chosen = pool.orderBy(by_hash, "id").limit(2 * fit.rows)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    found = (docs.select(F.col(id_col).alias("id"), body.alias("body")).where(F.octet_length("body") <= fit.max_bytes)
             .join(F.broadcast(chosen), "id").orderBy(by_hash, "id", "body").limit(fit.rows).collect())
    return train([bytes(r["body"]) for r in found], [int(r["quality"] > 0) for r in found], fit)


def scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability of label 1."""
    setup(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([score(sent.value, t) for t in texts], dtype="float64")
    return docs.withColumn(out, of(F.col(text_col).cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at the threshold or above, with their columns."""
    name = fresh(docs, "score")
    return scores(docs, fit(docs, labels), out=name).where(F.col(name) >= threshold).drop(name)
