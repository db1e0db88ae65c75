"""Quality scores: random-indexing word vectors, pooled per document, through a two-layer network.

Words fall into hash buckets; each bucket has a sparse ternary index vector drawn from its number. A bucket's
word vector is its index vector plus the index vectors of the words that stand next to it in a bounded sample
of labelled documents. A document is pooled as the mean and the spread of its word vectors. A two-layer network
in numpy gives a logit, whose temperature is fitted on a part of the sample that training does not see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, map_arrow, table

#: Words, single symbols, and line breaks.
PIECE = re.compile(r"\w+|[^\w\s]|\n")
BUCKETS, DIM, NONZERO, HIDDEN = 1 << 14, 48, 6, 32
#: Stands in the stream after a word that repeats the word before it.
REPEAT = "\0repeat"


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket: always the same ones."""
    rng = np.random.default_rng(20_240_601)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS)
    return out / np.sqrt(NONZERO)


class Bucketer:
    """Text to bucket numbers, with a bounded cache."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        words = PIECE.findall(text.lower()) if text else []
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        repeat, out, last = zlib.crc32(REPEAT.encode()) % BUCKETS, [], None
        for w in words:
            k = seen.get(w)
            if k is None:
                k = seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            out.append(k)
            if w == last and w != "\n":
                out.append(repeat)
            last = w
        return np.array(out, np.int64)


def word_vectors(streams: list[np.ndarray], window: int = 2) -> np.ndarray:
    """Index vector plus the mean context vector of each bucket."""
    base = index_vectors()
    context, seen = np.zeros((BUCKETS, DIM), np.float64), np.zeros(BUCKETS)
    for ids in streams:
        for d in range(1, window + 1):
            if len(ids) > d:
                np.add.at(context, ids[d:], base[ids[:-d]])
                np.add.at(context, ids[:-d], base[ids[d:]])
                seen += np.bincount(ids[d:], minlength=BUCKETS) + np.bincount(ids[:-d], minlength=BUCKETS)
    return (base + 0.5 * context / np.maximum(seen, 1)[:, None]).astype(np.float32)


def pool(streams: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, and the log length, of each document."""
    out = np.zeros((len(streams), 2 * DIM + 1), np.float32)
    for i, ids in enumerate(streams):
        if len(ids):
            kinds, n = np.unique(ids, return_counts=True)
            v, w = vectors[kinds], (n / len(ids)).astype(np.float32)[:, None]
            mean = (v * w).sum(0)
            out[i, :DIM] = mean
            out[i, DIM:-1] = np.sqrt(np.maximum((v * v * w).sum(0) - mean * mean, 0))
        out[i, -1] = np.log1p(len(ids)) / 10
    return out


@dataclass
class Network:
    """Standardised input, a tanh layer, a logit; prior is the share of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on three quarters of the rows, temperature on every fourth. With one class only, or no rows, the
    network is constant at the smoothed share of label 1."""
    dim = 2 * DIM + 1
    prior = float((y.sum() + 1) / (len(y) + 2))
    flat = Network(np.zeros(dim), np.ones(dim), np.zeros((dim, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), 1.0, prior)
    if len(y) < 8 or y.min() == y.max():
        return flat
    x = x.astype(np.float64)
    held = np.arange(len(y)) % 4 == 3
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    a, t = (x[~held] - mean) / scale, y[~held].astype(np.float64)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            rows = order[at : at + 128]
            xb, tb = a[rows], t[rows]
            hid = np.tanh(xb @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(hid @ p[2] + p[3]))) - tb) / len(rows)
            back = np.outer(g, p[2]) * (1 - hid * hid)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), hid.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0, prior)
    z, t = net.logit(x[held]), y[held]
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, z / s) - t * z / s) for s in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_pieces: int = 20_000_000, id_col: str = "doc_id") -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most about max_rows labelled documents with max_pieces words and signs in
    all, chosen by a hash of the id. A document with several labels takes their mean, 0.5 counting as 1."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = marks.count()
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(1, n)))
    chosen = F.broadcast(marks.where(part).limit(2 * max_rows))  # some max_rows short rows
    rows = docs.join(chosen, id_col).select(id_col, "y", F.coalesce("text", F.lit("")).alias("text"))

    def streams(batches: Iterator[dict]) -> Iterator[dict]:
        bucket = Bucketer()
        for b in batches:
            yield {"id": b[id_col], "y": b["y"], "ids": [bucket.ids(t).astype(np.uint16).tobytes() for t in b["text"]]}

    got = map_arrow(rows, streams, "id bigint, y int, ids binary")
    found, size = [], 0
    for r in got.orderBy(F.xxhash64("id"), "id", "ids").toLocalIterator():
        found.append((np.frombuffer(r.ids, np.uint16).astype(np.int64), r.y))
        size += len(r.ids) // 2
        if size > max_pieces:
            break
    ids, y = [x[0] for x in found], np.array([x[1] for x in found], np.float64)
    vectors = word_vectors(ids)
    return vectors, train(pool(ids, vectors), y)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id") -> DataFrame:
    """id_col and score (0 to 1) of every row of docs.

    Null and empty texts score as a document without words. Repeated rows stay; an empty table gives an empty
    result; with no labels to learn from every score is 0.5. Only the text is an input; texts are read whole.
    One narrow pass, so a lost executor costs only its own tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        vectors, net = shared.value
        bucket = Bucketer()
        for b in batches:
            for part in chunks(b, 256):
                yield {id_col: part[id_col], "score": net.score(pool([bucket.ids(t) for t in part["text"]], vectors))}

    return map_arrow(docs.select(id_col, "text"), run, docs.select(id_col, F.lit(0.0).alias("score")).schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
