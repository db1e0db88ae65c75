"""Line dedup over sharded minimal perfect hashes.

Lines become keys (stripped, A-Z lower-cased, hashed to 128 bits). Document frequencies are summed by key;
keys of two or more documents are dealt into shards by hash, and each shard becomes a minimal perfect hash
over compact arrays of 64-bit fingerprints and counts. Documents hash their lines and probe the arrays; no line is
joined. Shards go to all tasks while their summed size stays under ``max_broadcast``, which costs a task less than
sending its lines' hashes away; beyond it the hashes meet their shard in the shard's own task, the most common keys
being answered where they stand, and the row gets its dropped hashes back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, save, table, text_binary

#: Fixed value: what is stripped from both ends of a line.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Lines that a shard holds on average; bits per key of its first level; levels before the rest is listed.
SHARD_KEYS, GAMMA, LEVELS = 65_536, 2, 24
#: Tallies are handed on when they reach so many keys.
FLUSH = 200_000
#: Where hashes go to shards: a key found in one of so many line entries is answered from a broadcast head (so at
#: most as many keys); the hashes that a task gets, about.
HEAD, TASK_LINES = 20_000, 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z only


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit words per key."""
    raw = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _level_hash(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of packed bits: a key sits at its bit of the first level in which no other key had that bit; its slot
    is the rank of the bit. Keys that collide on every level are listed, sorted, behind the rest."""

    sizes: list[int]  # bits of each level
    words: np.ndarray  # all levels, each padded to whole 64-bit words
    rest: np.ndarray
    prints: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum([-(-n // 64) for n in self.sizes])]).astype(np.int64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.ranks = np.cumsum(ones, dtype=np.int32) - ones  # ones before each word

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> PerfectHash:
        left, sizes, words, placed = np.arange(len(h1)), [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = (_level_hash(h1[left], level) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(at, minlength=64 * -(-size // 64)) == 1
            alone = taken[at]
            sizes.append(size)
            words.append(np.packbits(taken, bitorder="little").view(np.uint64))
            placed.append((left[alone], at[alone]))
            left = left[~alone]
        rest = left[np.argsort(h1[left], kind="stable")]
        self = cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), h1[rest], np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32))
        for level, (keys, at) in enumerate(placed):
            slot = self._slot(level, at)
            self.prints[slot], self.counts[slot] = h2[keys], np.minimum(counts[keys], 0xFFFFFFFF)
        at = len(h1) - len(rest)
        self.prints[at:], self.counts[at:] = h2[rest], np.minimum(counts[rest], 0xFFFFFFFF)
        return self

    def _slot(self, level: int, at: np.ndarray) -> np.ndarray:
        """The rank of bits that are set."""
        word = self.first[level] + (at >> 6)
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[word] + np.bitwise_count(below)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for a key that isn't in the index."""
        out, open_ = np.zeros(len(h1), np.int64), np.arange(len(h1))
        slots = np.full(len(h1), -1, np.int64)
        for level, size in enumerate(self.sizes):
            at = (_level_hash(h1[open_], level) % np.uint64(size)).astype(np.int64)
            hit = (self.words[self.first[level] + (at >> 6)] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slots[open_[hit]] = self._slot(level, at[hit])
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, h1[open_]), len(self.rest) - 1)
            hit = self.rest[at] == h1[open_]
            slots[open_[hit]] = len(self.prints) - len(self.rest) + at[hit]
        found = np.flatnonzero(slots >= 0)
        same = self.prints[slots[found]] == h2[found]
        out[found[same]] = self.counts[slots[found[same]]]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.rest), len(self.prints), *self.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, self.words, self.rest, self.prints, self.counts))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        """The arrays stay views of data."""
        n_sizes, n_words, n_rest, n = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, parts = 32 + 8 * n_sizes, []
        for kind, size in ((np.uint64, n_words), (np.uint64, n_rest), (np.uint64, n), (np.uint32, n)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(np.frombuffer(data, np.int64, n_sizes, 32).tolist(), *parts)


def shard_of(h2: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h2 >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


class Index:
    """The shards as documents probe them."""

    def __init__(self, shards: dict[int, bytes], n_shards: int):
        self.n, self.parts = n_shards, {k: PerfectHash.load(v) for k, v in shards.items()}

    def probe(self, h: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(h), np.int64), shard_of(h[:, 1], self.n)
        for k, part in self.parts.items():
            at = np.flatnonzero(shard == k)
            if len(at):
                out[at] = part.probe(h[at, 0], h[at, 1])
        return out


def line_counts(docs: DataFrame) -> DataFrame:
    """h1, h2, n: in how many documents (rows) each non-empty line key occurs."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tally: Counter = Counter()

        def out() -> dict:
            h = np.frombuffer(b"".join(tally), dtype=">u8").astype(np.int64).reshape(-1, 2)
            got = {"h1": h[:, 0], "h2": h[:, 1], "n": list(tally.values())}
            tally.clear()
            return got

        for b in batches:
            for text in b["text"]:
                keys = {line_key(x) for x in (text or b"").split(b"\n")}
                keys.discard(b"")
                tally.update(map(xxhash.xxh3_128_digest, keys))
                if len(tally) > FLUSH:
                    yield out()
        yield out()

    return map_arrow(docs.select(text_binary()), run, "h1 bigint, h2 bigint, n bigint", 1_024).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """shard, data (a dumped PerfectHash), bytes. A task gets whole shards and builds one at a time."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, parts = None, []

        def done() -> dict:
            h1, h2, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            data = PerfectHash.build(h1, h2, n).dump()
            return {"shard": [now], "data": [data], "bytes": [len(data)]}

        for b in batches:
            shard = np.array(b["shard"], np.int64)
            cols = [np.array(b["h1"], np.int64).view(np.uint64), np.array(b["h2"], np.int64).view(np.uint64), np.array(b["n"], np.int64)]
            for at in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if len(at) and shard[at[0]] != now:
                    if parts:
                        yield done()
                    now, parts = int(shard[at[0]]), []
                parts.append([c[at] for c in cols])
        if parts and now is not None:
            yield done()

    shard = F.expr(f"shiftrightunsigned(h2, 32) % {n_shards}").alias("shard")
    dealt = counts.select("h1", "h2", "n", shard).repartition("shard").sortWithinPartitions("shard")
    return map_arrow(dealt, run, "shard bigint, data binary, bytes bigint")


def _keep(text: bytes | None, dropped: np.ndarray) -> tuple[int, int, str]:
    lines = (text or b"").split(b"\n")
    kept = b"\n".join(x for x, d in zip(lines, dropped, strict=True) if not d)
    return len(lines), int(dropped.sum()), kept.decode()


def _probe_batch(texts: list, index: Index, min_docs: int) -> list[tuple[int, int, str]]:
    keys = [[line_key(x) for x in (t or b"").split(b"\n")] for t in texts]
    flat = [k for ks in keys for k in ks]
    drop = index.probe(key_hashes(flat)) >= min_docs if flat else np.zeros(0, bool)
    drop &= np.fromiter((k != b"" for k in flat), bool, len(flat))
    ends = np.cumsum([len(k) for k in keys])
    return [_keep(t, d) for t, d in zip(texts, np.split(drop, ends[:-1]) if len(keys) else [], strict=True)]


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", max_broadcast: int = 24 << 20, keep_columns: bool = False) -> DataFrame:
    """Drop every line whose key occurs in min_docs documents or more, in all of them.

    Returns id_col, n_lines, n_dropped, kept (the other lines, joined by a line feed); with keep_columns all
    columns of docs, then these three, which replace columns of docs with their names. Null or empty text is one
    empty line, and empty keys are never dropped. Every row is a document of its own, repeated ids too. An empty
    table gives an empty result. Extra columns are not read unless kept. Whole texts. Keys of one document are not
    indexed: they can't be dropped, and a foreign key passes the 64-bit fingerprint of its slot once in 2**64. Line
    counts and shards lie in the shared folder.
    """
    spark = docs.sparkSession
    counts = save(line_counts(docs).where(F.col("n") >= min(2, min_docs)), "line-counts")
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))
    shards = save(build_shards(counts, n_shards), "line-shards")
    size = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    new = {"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint"), "kept": F.lit("")}
    plain = docs.drop(*new) if keep_columns else docs.select(id_col, "text")
    source = plain.withColumn("text", text_binary())
    schema = plain.drop("text").withColumns(new).schema
    if size > max_broadcast:
        return _dedup_by_shard(source, counts, shards, n_shards, min_docs, schema, id_col)
    data = spark.sparkContext.broadcast((n_shards, {r.shard: r.data for r in shards.select("shard", "data").toLocalIterator()}))
    return map_arrow(source, _Prober(data, min_docs), schema, 1_024)


class _Prober:
    """Probes batches against the broadcast shards."""

    def __init__(self, data, min_docs: int):
        self.data, self.min_docs = data, min_docs

    def __call__(self, batches: Iterator[dict]) -> Iterator[dict]:
        n_shards, shards = self.data.value
        index = Index(shards, n_shards)
        for b in batches:
            texts = b.pop("text")
            done = _probe_batch(texts, index, self.min_docs)
            yield b | {"n_lines": [x[0] for x in done], "n_dropped": [x[1] for x in done], "kept": [x[2] for x in done]}


def _dedup_by_shard(source: DataFrame, counts: DataFrame, shards: DataFrame, n_shards: int, min_docs: int, schema, id_col: str) -> DataFrame:
    """The way beyond the broadcast limit. A row is known by the hash of its id and text; equal rows lose the same
    lines. A task gets a shard and a part of the hashes that fall into it, in this order, and probes them in batches."""
    row = F.xxhash64(id_col, "text")
    keyed = source.withColumn("_row", row)
    entries = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    common = counts.where((F.col("n") >= min_docs) & (F.col("n") * HEAD >= entries)).select("h1", "h2").collect()
    head = source.sparkSession.sparkContext.broadcast(frozenset((r.h1, r.h2) for r in common))
    salts = max(1, -(-entries // (TASK_LINES * n_shards)))

    def lines(batches: Iterator[dict]) -> Iterator[dict]:
        known = head.value
        for b in batches:
            out: dict = {k: [] for k in ("_row", "h1", "h2", "shard", "salt")}
            for r, text in zip(b["_row"], b["text"], strict=True):
                h = key_hashes(sorted({line_key(x) for x in (text or b"").split(b"\n")} - {b""}))
                pairs = h.astype(np.int64).tolist()
                keep = [i for i, p in enumerate(pairs) if tuple(p) not in known]
                out["_row"] += [r] * len(keep)
                out["h1"] += [pairs[i][0] for i in keep]
                out["h2"] += [pairs[i][1] for i in keep]
                out["shard"] += shard_of(h[keep, 1], n_shards).tolist()
                out["salt"] += [r % salts] * len(keep)
                if len(out["h1"]) > FLUSH:
                    yield out
                    out = {k: [] for k in out}
            yield out

    def probe(batches: Iterator[dict]) -> Iterator[dict]:
        now, part = None, None
        for b in batches:
            shard = np.array(b["shard"], np.int64)
            for at in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                for i in at:
                    if b["data"][i] is None:
                        break
                    now, part = shard[i], PerfectHash.load(b["data"][i])
                rest = [i for i in at if b["data"][i] is None]
                if part is None or not rest or shard[rest[0]] != now:
                    continue
                h1, h2 = (np.array([b[k][i] for i in rest], np.int64) for k in ("h1", "h2"))
                gone = np.flatnonzero(part.probe(h1.view(np.uint64), h2.view(np.uint64)) >= min_docs)
                yield {"_row": [b["_row"][rest[i]] for i in gone], "h1": h1[gone], "h2": h2[gone]}

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        known = head.value
        for b in batches:
            b.pop("_row")
            done = []
            for text, drop in zip(b.pop("text"), b.pop("_drop"), strict=True):
                keys = [line_key(x) for x in (text or b"").split(b"\n")]
                gone = {(x["h1"], x["h2"]) for x in drop or ()} | known
                pairs = map(tuple, key_hashes(keys).astype(np.int64).tolist())
                done.append(_keep(text, np.array([k != b"" and p in gone for k, p in zip(keys, pairs, strict=True)], bool)))
            yield b | {"n_lines": [x[0] for x in done], "n_dropped": [x[1] for x in done], "kept": [x[2] for x in done]}

    asked = map_arrow(keyed.select("_row", "text"), lines, "_row bigint, h1 bigint, h2 bigint, shard bigint, salt bigint", 1_024).withColumn("data", F.lit(None).cast("binary"))
    none = F.lit(None).cast("bigint")
    offered = shards.select(none.alias("_row"), none.alias("h1"), none.alias("h2"), "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "data")
    met = asked.unionByName(offered).repartition("shard", "salt").sortWithinPartitions("salt", "shard", F.col("data").isNull())
    hits = map_arrow(met, probe, "_row bigint, h1 bigint, h2 bigint")
    drops = hits.groupBy("_row").agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
    return map_arrow(keyed.join(drops, "_row", "left"), cut, schema, 1_024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), 10).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for the rows of op2_line_dedup.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
hot AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (key) GROUP BY doc_id
"""
