"""Nearest neighbours by a navigable small-world graph per shard, merged over the shards.

Distinct vectors are dealt into shards of about ``shard_rows`` by hash, vectors of very different magnitude apart.
Each shard becomes, once, a hierarchical graph of flat neighbour arrays and lies so in the shared folder: every layer's
nodes link to a diverse choice of their nearest nodes in that layer, and back, and bridges between the nearest nodes of
separate parts make every layer connected. A block of queries walks a shard's graph all at once, with a beam on every
layer; what the beam holds is measured again on the original vectors. The shards' results are merged per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, save, table

#: Links of a node per layer (twice as many in the lowest); one node in FAN of a layer is in the next; bridges of a node.
LINKS, FAN, BRIDGES = 16, 16, 8
#: Nearest nodes from which the links are chosen.
CANDIDATES = 64
#: Queries that walk a graph together; rows of distances computed at once while building.
BLOCK = 512
#: Queries of up to so many bytes are sent to every task; beyond it their blocks are shuffled to the shards.
SENT_BYTES = 32 << 20
#: Nodes that the beam keeps on the upper layers.
UPPER = 48
#: Bits of magnitude in a band: shards hold vectors whose largest components are within a factor 2**BAND.
BAND = 32


@dataclass
class Graph:
    """Vectors, shifted and scaled, and per layer a table of neighbour numbers, -1 where there are fewer."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]  # (node numbers, neighbours by row: positions in the layer)
    shift: np.ndarray
    scale: float

    def place(self, v: np.ndarray) -> np.ndarray:
        return (v * self.scale - self.shift).clip(-1e150, 1e150)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the last axis, without overflow or underflow in between."""
    with np.errstate(over="ignore"):
        gap = np.abs(a - b)
    most = gap.max(-1, keepdims=True, initial=0)
    plain = (most < 1e150) & (most > 1e-150)
    unit = np.where(plain, 1.0, np.where((most > 0) & np.isfinite(most), most, 1.0))
    return np.sqrt(((gap / unit) ** 2).sum(-1)) * unit[..., 0]


def _parts(links: np.ndarray) -> np.ndarray:
    """The part of each node: the smallest node that its links, taken both ways, reach."""
    n = len(links)
    a, c = np.nonzero(links >= 0)
    b, part = links[a, c], np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, a, part[b])
        np.minimum.at(low, b, part[a])
        low = low[low]
        if (low == part).all():
            return part
        part = low


def _bridge(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """links with bridges: each part gets one to the nearest node outside, round by round, until there is one part."""
    n = len(x)
    bridges, used, room = np.full((n, BRIDGES), -1, np.int32), np.zeros(n, int), BRIDGES
    while True:
        part = _parts(np.concatenate([links, bridges], 1))
        if (part == 0).all():
            return np.concatenate([links, bridges], 1)
        best: dict[int, tuple] = {}
        for at in range(0, n, BLOCK):
            d = squared(x[at : at + BLOCK], x)
            d[part[at : at + BLOCK, None] == part[None, :]] = np.inf
            d[:, used >= room] = np.inf
            d[used[at : at + BLOCK] >= room] = np.inf
            near = d.argmin(1)
            for i, (j, g) in enumerate(zip(near, d[np.arange(len(d)), near], strict=True)):
                p = int(part[at + i])
                if np.isfinite(g) and (p not in best or (g, at + i, int(j)) < best[p]):
                    best[p] = (g, at + i, int(j))
        if not best:  # no free place: far more parts than nodes have bridges
            bridges, room = np.concatenate([bridges, np.full((n, BRIDGES), -1, np.int32)], 1), room + BRIDGES
        for _, i, j in sorted(best.values()):
            if used[i] < room and used[j] < room:
                bridges[i, used[i]], bridges[j, used[j]] = j, i
                used[[i, j]] += 1


def _layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbour positions of each row of x, with bridges. A candidate is linked unless a chosen one is nearer to it than
    the node is; free places go to the nearest that were passed over. Links back fill what is left."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if width < 1:
        return out
    for at in range(0, n, BLOCK):
        d = squared(x[at : at + BLOCK], x)
        rows = np.arange(len(d))
        d[rows, at + rows] = np.inf
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        dist = np.take_along_axis(d, near, 1)
        order = np.lexsort((near, dist), axis=1)
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        chosen = np.zeros(near.shape, bool)
        shadow = np.full(near.shape, np.inf)  # distance from each candidate to the nearest chosen one
        count = np.zeros(len(d), int)
        for k in range(width):
            take = (shadow[:, k] > dist[:, k]) & (count < links)
            chosen[:, k] = take
            count += take
            if k + 1 < width and take.any():
                r = np.flatnonzero(take)
                gap = x[near[r, k + 1 :]] - x[near[r, k]][:, None, :]
                shadow[r, k + 1 :] = np.minimum(shadow[r, k + 1 :], (gap * gap).sum(2))
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :links]
        out[at : at + len(d), : rank.shape[1]] = np.take_along_axis(near, rank, 1)
    # links back, nearest nodes first, into the second half of the row
    source, place = np.nonzero(out >= 0)
    target = out[source, place]
    order = np.lexsort((source, place, target))
    source, target = source[order], target[order]
    at = np.arange(len(target)) - np.searchsorted(target, target)
    fits = at < links
    out[target[fits], links + at[fits]] = source[fits]
    return _bridge(x, out)


def build(vectors: np.ndarray, seed: int = 11) -> Graph:
    """The graph of a shard. Levels are drawn from a fixed seed in the order of the rows."""
    most = np.abs(vectors).max(initial=0)
    scale = float(2.0 ** -np.floor(np.log2(most))) if most > 0 and np.isfinite(most) else 1.0
    x = vectors * scale
    shift = x.mean(0)  # distances keep, the products lose less
    x = np.ascontiguousarray(x - shift)
    level = np.floor(-np.log(np.random.default_rng(seed).random(len(x)) + 1e-300) / np.log(FAN)).astype(int)
    layers = []
    for k in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        layers.append((nodes, _layer(x[nodes], LINKS if k == 0 else LINKS // 2)))
    return Graph(x, layers, shift, scale)


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first over one layer: positions and squared distances of up to beam nodes, from the entries (-1: none)."""
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    ids = np.full((len(q), beam), -1, np.int32)
    dist = np.full((len(q), beam), np.inf)
    open_ = np.zeros((len(q), beam), bool)
    entry = entry[:, :beam]
    r, c = np.nonzero(entry >= 0)
    ids[:, : entry.shape[1]] = entry
    dist[r, c] = ((x[entry[r, c]] - q[r]) ** 2).sum(1)
    open_[r, c] = True
    seen[r, entry[r, c]] = True
    active = rows
    while len(active):
        k = np.where(open_[active], dist[active], np.inf).argmin(1)
        has = open_[active, k]
        active, k = active[has], k[has]
        if not len(active):
            break
        open_[active, k] = False
        near = links[ids[active, k]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        # a node can stand twice in a row: its second place doesn't count
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        twice = np.zeros(near.shape, bool)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        d[r, c] = ((x[near[r, c]] - q[active[r]]) ** 2).sum(1)
        all_d = np.concatenate([dist[active], d], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(all_d, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], 1), keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), dist


def search(g: Graph, queries: np.ndarray, beam: int) -> np.ndarray:
    """Numbers of up to beam nodes near each query (-1 fills up)."""
    q = g.place(queries)
    nodes = g.layers[-1][0]
    entry = np.argsort(squared(q, g.vectors[nodes]), axis=1, kind="stable")[:, :UPPER]  # the top layer is small
    for depth in range(len(g.layers) - 1, 0, -1):
        nodes, links = g.layers[depth]
        found, _ = _walk(g.vectors[nodes], links, q, entry, UPPER)
        below = g.layers[depth - 1][0]
        entry = np.where(found >= 0, np.searchsorted(below, nodes[found]), -1)
    nodes, links = g.layers[0]
    return _walk(g.vectors[nodes], links, q, entry, beam)[0]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(fine, F.lit(False)))


def shards(distinct: DataFrame, counts: dict, shard_rows: int) -> DataFrame:
    """dim, band, shard, index: a pickled graph with its vectors and ids, one row for each shard; a task builds one at a
    time."""
    number = F.create_map(*(F.lit(x) for (d, b), n in counts.items() for x in (f"{d} {b}", -(-n // shard_rows))))[F.concat_ws(" ", "dim", "band")]
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), number)).repartition("dim", "band", "shard").sortWithinPartitions("dim", "band", "shard", F.col("ids")[0])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, vectors, ids = None, [], []

        def done() -> dict:
            x = np.array(vectors, np.float64)
            return {"dim": [now[0]], "band": [now[1]], "shard": [now[2]], "index": [pickle.dumps((build(x), x, ids))]}

        for b in batches:
            for dim, band, shard, v, own in zip(b["dim"], b["band"], b["shard"], b["v"], b["ids"], strict=True):
                if (dim, band, shard) != now:
                    if now is not None:
                        yield done()
                    now, vectors, ids = (dim, band, shard), [], []
                vectors.append(v)
                ids.append(own)
        if now is not None:
            yield done()

    return map_arrow(dealt, run, "dim int, band int, shard bigint, index binary")


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, beam: int = 160, shard_rows: int = 8192, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score: for each row of queries its k nearest rows of points with another id.

    Score is the Euclidean distance of the original vectors in double precision, ties go to the smaller id.
    Null, zero, and not finite vectors and null ids take no part; vectors meet only those of their own length.
    Equal vectors are indexed once and come back as their k + 1 smallest ids, which is all that a result can
    hold of them. A repeated row of points counts once, of queries too. Fewer candidates than k are all
    returned; empty tables give an empty result; other columns are not read. Approximate: a shard's walk keeps
    a beam of nodes. Distinct vectors, graphs (built once) and packed blocks of queries are in the shared folder. Every
    block of queries meets every shard: the work is the number of queries times that of shards, which the method has
    for its price; larger shards lower it, as far as a task's memory holds one.
    """
    magnitude = F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x)))) / BAND).cast("int")
    # a double array is a grouping key; of equal vectors the smallest ids stay, filtered before the shuffle
    ranked = valid_vectors(points, id_col, vector_col).distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = save(grouped.withColumns({"dim": F.size("v"), "band": magnitude}), "vectors")
    asked = save(valid_vectors(queries, id_col, vector_col).distinct().withColumn("dim", F.size("v")), "queries")
    counts = {(r.dim, r.band): r.n for r in distinct.groupBy("dim", "band").agg(F.count("*").alias("n")).collect()}
    asks = {r.dim: r.n for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    counts = {key: n for key, n in counts.items() if key[0] in asks}
    if not counts:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dims = sorted({d for d, _ in counts})
    index = save(shards(distinct.where(F.col("dim").isin(dims)), counts, shard_rows), "graphs")
    blocks = F.create_map(*(F.lit(x) for d in dims for x in (d, -(-asks[d] // block_rows))))[F.col("dim")]
    dealt = asked.where(F.col("dim").isin(dims)).withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    packed = save(dealt.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("asked")), "query-blocks")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for data, block in zip(b["index"], b["asked"], strict=True):
                graph, x, ids = pickle.loads(data)
                q_ids, q_all = [r["id"] for r in block], np.array([r["v"] for r in block], np.float64)
                for at in range(0, len(q_ids), BLOCK):
                    q = q_all[at : at + BLOCK]
                    near = search(graph, q, max(beam, k + 1))
                    gap = np.where(near >= 0, distance(q[:, None, :], x[near]), np.inf)
                    out: list[tuple] = []
                    for name, row, d in zip(q_ids[at : at + BLOCK], near, gap, strict=True):
                        some = np.argsort(d, kind="stable")[: 2 * k + 2]  # at least all within the distance of place k + 1
                        some = np.flatnonzero(d <= d[some[min(k, len(some) - 1)]])
                        got = sorted((float(d[j]), int(p)) for j in some if row[j] >= 0 for p in ids[row[j]] if p != name)[:k]
                        out += ((name, p, s) for s, p in got)
                    yield {"query_id": [r[0] for r in out], "id": [r[1] for r in out], "score": [r[2] for r in out]}

    keys = ["dim", "band", "shard"]
    if sum(asks[d] * (d + 2) * 8 for d in dims) <= SENT_BYTES:
        met = index.join(F.broadcast(packed), "dim")
    else:  # blocks go to the shards, one copy each
        met = packed.join(index.select(keys), "dim").join(index, keys)
    per_shard = map_arrow(met.select("index", "asked"), run, "query_id bigint, id bigint, score double", 1)
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return per_shard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
