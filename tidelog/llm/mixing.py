"""Mixing to target weights with soft membership.

A classifier learned from the labels table gives each document a posterior over domains (high quality, low
quality, toxic). Nonnegative document rates are then fitted by projected-gradient least squares so that the
expected tokens of each domain, the sum of rate * tokens * posterior, match the targets. Rates are measured by
their documents' tokens, so the gradient of a rate is its posterior times the residual; each step projects onto
rates >= 0. Steps are scaled by the domains' second moments over the documents with a positive rate and shortened until
the residual shrinks; where that fails the plain step follows, whose length is the inverse of the largest curvature and
with which projected gradient always descends. The fit ends at the tolerance, or where no step descends any more.
A rate depends only on the posterior and the steps so far, so every pass over the documents is one sum of a
few numbers and no rate is stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, save, table
from .quality import Bucketer

DOMAINS = ("high", "low", "toxic")
#: Target share of the tokens of each domain.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
BUCKETS = 1 << 14


@dataclass
class Classifier:
    """Softmax over the distinct buckets of a text."""

    w: np.ndarray
    b: np.ndarray

    def posterior(self, kinds: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.w[k].sum(0) for k in kinds]) + self.b if kinds else np.zeros((0, len(self.b)))
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True) if len(z) else z


def train(kinds: list[np.ndarray], y: np.ndarray, epochs: int = 12, seed: int = 5) -> Classifier:
    """Adagrad, one document at a time; features are scaled by the root of their number. Starts from the
    smoothed shares of the domains, which are all that is left without rows."""
    d = len(DOMAINS)
    shares = (np.bincount(y.astype(int), minlength=d) + 1) / (len(y) + d)
    w, b = np.zeros((BUCKETS, d)), np.log(shares)
    gw, rng = np.full((BUCKETS, d), 1e-2), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            k = kinds[i]
            z = w[k].sum(0) + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            if np.abs(p).max() < 0.02:
                continue
            gw[k] += p * p
            w[k] -= 0.1 * p / np.sqrt(gw[k])
    return Classifier(w.astype(np.float32), b.astype(np.float32))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 5_000, id_col: str = "doc_id") -> Classifier:
    """Fit on about max_rows labelled documents chosen by a hash of the id. Rows without both labels are left
    out; of several labels of a document the largest toxic and the smallest quality count, of several texts of an
    id the first in order."""
    fine = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    domain = F.when(F.max("toxic") >= 1, 2).when(F.min("quality") >= 1, 0).otherwise(1)
    marks = fine.groupBy(id_col).agg(domain.alias("y"))
    n = marks.count()
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("mixing")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(1, n)))
    chosen = F.broadcast(marks.where(part).limit(2 * max_rows))  # some max_rows short rows
    rows = docs.where(F.col("text").isNotNull()).join(chosen, id_col).groupBy(id_col).agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def kinds(batches: Iterator[dict]) -> Iterator[dict]:
        bucket = Bucketer()
        for b in batches:
            yield {"id": b[id_col], "y": b["y"], "k": [np.unique(bucket.ids(t) % BUCKETS).astype(np.uint16).tobytes() for t in b["text"]]}

    got = sorted(((r.id, r.k, r.y) for r in map_arrow(rows, kinds, "id bigint, y int, k binary").toLocalIterator()), key=lambda r: (r[0], r[1]))
    return train([np.frombuffer(r[1], np.uint16).astype(np.int64) for r in got], np.array([r[2] for r in got], np.int64))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """All columns of docs, then n_tokens (words at white space) and posterior (array by DOMAINS)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m, bucket = shared.value, Bucketer()
        for b in batches:
            for part in chunks(b, 512):
                p = m.posterior([np.unique(bucket.ids(t) % BUCKETS) for t in part["text"]])
                yield part | {"n_tokens": [len((t or "").split()) for t in part["text"]], "posterior": list(p.astype(np.float64))}

    schema = docs.withColumns({"n_tokens": F.lit(0).cast("bigint"), "posterior": F.array(F.lit(0.0))}).schema
    return map_arrow(docs, run, schema)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each row of posteriors after the steps: from 1, projected onto >= 0 each time."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(r + p @ s, 0)
    return r


def fit_rates(scored: DataFrame, targets: dict[str, float], iterations: int = 40, tolerance: float = 1e-5) -> tuple[list[np.ndarray], dict]:
    """Steps that bring the expected domain tokens to the target shares of all tokens, and what they reach: shares,
    and the largest gap between a domain's share and its target, both measured after the last step."""
    d = len(DOMAINS)
    want = np.array([targets[k] for k in DOMAINS], float)
    want = want / want.sum()

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Domain tokens, second moments of the documents with a rate and of all, all tokens."""

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            have, free, every, size = np.zeros(d), np.zeros((d, d)), np.zeros((d, d)), 0.0
            for b in batches:
                if b["n_tokens"]:
                    p, t = np.array(b["posterior"]), np.array(b["n_tokens"], float)
                    r = rates(p, steps)
                    have += (r * t) @ p
                    free += (p * (t * (r > 0))[:, None]).T @ p
                    every += (p * t[:, None]).T @ p
                    size += t.sum()
            yield {"v": [np.concatenate([have, free.ravel(), every.ravel(), [size]])]}

        n = d + 2 * d * d + 1
        row = map_arrow(scored.select("n_tokens", "posterior"), run, "v array<double>").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(n))).first()
        s = np.array([x or 0.0 for x in row])
        return s[:d], s[d : d + d * d].reshape(d, d), s[d + d * d : -1].reshape(d, d), s[-1]

    steps: list[np.ndarray] = []
    have, free, every, size = totals(steps)
    while size and len(steps) < iterations:
        miss = want * size - have
        if np.abs(miss).max() / size < tolerance:
            break
        scaled = np.linalg.solve(free + 1e-9 * np.eye(d) * max(1.0, np.trace(free)), miss)
        plain = miss / np.linalg.eigvalsh(every)[-1]
        for step in (scaled, scaled / 4, scaled / 16, plain):
            tried = totals([*steps, step])
            rest = want * size - tried[0]
            if rest @ rest < (1 - 1e-3) * (miss @ miss):
                break
        else:
            break
        steps.append(step)
        have, free = tried[:2]
    if not size:
        return [], {"steps": 0, "tokens": 0.0, "shares": want * 0, "gap": 0.0}
    return steps, {"steps": len(steps), "tokens": size, "shares": have / size, "gap": float(np.abs(want - have / size).max())}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", allowed_gap: float = 0.01) -> DataFrame:
    """All columns of docs, then n_tokens, p_high, p_low, p_toxic, rate, target_gap and copies.

    copies is rate rounded up or down by a hash of the id, so that the expected number of copies is the rate.
    target_gap, the same in every row, is the largest difference between a domain's expected share of all tokens and
    its target; beyond allowed_gap (posteriors that no rates can bring to the targets, as from labels of one class) a
    warning says so. Null and empty texts have no tokens, the prior as posterior, and a rate like any other. Repeated
    rows stay. With empty labels all posteriors are the same and rates move together; an empty table gives an empty
    result. Columns of docs with the names of the new ones are replaced. Posteriors lie in the shared folder.
    """
    new = ["n_tokens", "posterior", "rate", "copies", "target_gap", *(f"p_{k}" for k in DOMAINS)]
    scored = save(posteriors(docs.drop(*new), fit_classifier(docs, labels, id_col=id_col)), "posteriors")
    steps, report = fit_rates(scored, targets)
    if report["gap"] > allowed_gap:
        warnings.warn(f"no rates reach the targets: the largest gap of a share is {report['gap']:.3f}", stacklevel=2)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            p = np.array(b.pop("posterior")).reshape(-1, len(DOMAINS))
            yield b | {f"p_{k}": p[:, i] for i, k in enumerate(DOMAINS)} | {"rate": rates(p, steps)}

    schema = scored.drop("posterior").withColumns({**{f"p_{k}": F.lit(0.0) for k in DOMAINS}, "rate": F.lit(0.0)}).schema
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = map_arrow(scored, run, schema, 1_024)
    return out.withColumn("target_gap", F.lit(report["gap"])).withColumn("copies", F.floor(F.col("rate") + chance).cast("bigint"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, table(spark, sf_dir, "labels")).drop("text")
