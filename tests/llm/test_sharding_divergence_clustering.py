"""Sharding, source divergence and centroid clustering against SQL, plain versions, and awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from test_llm import ROWS, none, odd  # noqa: F401

from tidelog.llm import clustering, divergence, queries, sharding
from tidelog.llm.common import table

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", ["op11_sharding", "op12_source_divergence", "op13_centroid_clustering"])
def test_against_sql(spark, duck, name):
    mine, other = same_rows(Q[name](spark, DATA), duck, SQL[name])
    assert mine and mine == other


def _laws(rows, shards, slack=0):
    """Shares are near equal and slots have no gap."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append((r.slot, r.size))
    total = sum(r.size for r in rows)
    most = max((r.size for r in rows), default=0)
    for got in by.values():
        assert sorted(s for s, _ in got) == list(range(len(got)))
        assert abs(sum(z for _, z in got) - total / shards) <= most + slack
    return by


def test_sharding_with_a_hot_text_and_repeated_rows(spark):
    """A third of the rows is one text, another third one row again and again: both are cut where the law asks it."""
    rows = [(k, "the hot text of all") for k in range(4000)] + [(7, "one row")] * 4000 + [(k, "word " * (k % 90)) for k in range(4000, 8000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    got = sharding.shard_rows(df.repartition(7), 8).collect()
    assert len(got) == len(rows) and len(_laws(got, 8)) == 8
    again = sharding.shard_rows(df.repartition(3), 8).collect()
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # equal texts are neighbours: their slots in a shard have no gap
    slots = collections.defaultdict(list)
    for r in got:
        if r.text == "the hot text of all":
            slots[r.shard].append(r.slot)
    assert all(max(s) - min(s) == len(s) - 1 for s in slots.values())
    loose = sharding.shard_rows(df, 5, tolerance=0.1).collect()
    _laws(loose, 5, 0.1 * sum(r.size for r in loose) / 5)


def test_sharding_rounds(spark):
    """Counts refine only ranges with a splitter, ranges are whole and in order, pieces know their place."""
    rows = spark.range(5000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))).alias("_key"), F.lit(0).cast("bigint").alias("_tie"), (F.col("id") % 50 + 1).alias("_size"))
    levels, ranges = sharding.histogram(rows, 8, 0.0)
    assert len(levels) > 1 and sum(r[4] for r in ranges) == 5000 and ranges == sorted(ranges)
    before, total = 0, sum(r[3] for r in ranges)
    for r in ranges:
        assert r[4] == 1 or before * 8 // total == (before + r[3] - 1) * 8 // total
        before += r[3]
    homes = sharding.pieces(ranges, 8)
    counts = collections.Counter()
    for r, (_, _, _, piece, shard, base) in zip(ranges, homes, strict=True):
        counts[piece] += r[4]
    assert {h[4] for h in homes} == set(range(8)) and all(h[5] == 0 for i, h in enumerate(homes) if i == 0 or homes[i - 1][4] != h[4])
    assert max(counts.values()) < 5000 / 8


def test_sharding_odd(spark, odd, none, tmp_path):  # noqa: F811
    named = odd.withColumn("shard", F.lit("z"))
    got = sharding.shard_rows(named, 3).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in ROWS)
    assert all(r.score == "x" and isinstance(r.shard, int) for r in got)
    _laws(got, 3)
    assert sharding.shard_rows(none).count() == 0
    sharding.write_shards(sharding.shard_rows(odd, 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
    crc = {r.doc_id: r.text_crc32 for r in Q["op11_sharding"](spark, DATA).collect()}
    assert all(crc[r.doc_id] == zlib.crc32((r.text or "").encode()) for r in table(spark, DATA, "documents").collect())


def _plain_divergences(docs, least, top):
    df, n, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        df.update((lang, t) for t in set(w))
        n.update((lang, source, t) for t in w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), c in df.items() if la == lang and c >= least]
        sources = [s for la, s in groups if la == lang]
        count = {s: [n[lang, s, t] for t in kept] for s in sources}
        every = [sum(c) for c in zip(*count.values(), strict=True)]
        smooth = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = {s: smooth(c) for s, c in count.items()}, smooth(every)
        for s in sources:
            pair = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            term = [(t, f(a, b)) for t, c, a, b in zip(kept, count[s], p[s], q, strict=True) if c > 0 and a > b]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


def test_divergence_against_plain(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "The", "Straße", "STRASSE", "É", "é", "don't", "a1b", "日本", "x_y", "tab\tnl\n", "\x00nul", "zz"]
    docs = [(["en", "de", None, ""][rng.integers(4)], ["s1", "s2", "S3", None, ""][rng.integers(5)], " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for _ in range(300)]
    docs += [("en", "hot", "the the the hot")] * 150 + [("fr", "lone", "un"), ("it", "a", None), ("it", "b", "12 34"), ("en", "none", None)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("n", F.lit("x")).withColumn("term", F.lit(1))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(divergence.divergences(df, 10, 4)) == _plain_divergences(docs, 10, 4)
    monkeypatch.setattr(divergence, "SENT_GROUPS", 0)
    assert rows(divergence.divergences(df, 3, 10)) == _plain_divergences(docs, 3, 10)
    assert divergence.divergences(df.limit(0)).count() == 0


def test_divergence_large_counts(spark):
    """Counts beyond 2^63 / 1e9 stay exact."""
    row = spark.range(1).select(divergence.probability(F.lit(10**13), F.lit(3 * 10**13), F.lit(7)).alias("p"), divergence.gap(F.lit(10**9).cast("bigint"), F.lit(1).cast("bigint")).alias("f")).first()
    assert (row.p, row.f) == (1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14), (10**9 - 1) ** 2 // (10**9 + 1))


def _plain_lloyd(vectors, k, rounds):
    h = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    c = [v for _, v in sorted(((h(i), v) for i, v in whole if i is not None))[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in whole]
        if turn == rounds:
            return sorted((i or -1, j, d, c[j]) for (i, _), (d, j) in zip(whole, near, strict=True))
        for j in range(len(c)):
            mine = [v for (_, v), (_, at) in zip(whole, near, strict=True) if at == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]


def test_clustering_against_plain(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 3)) * 2)] + [(5, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, -1.0])] + [(k, [0.25, -0.25, 0.5]) for k in range(200, 260)]
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").withColumn("cluster", F.lit("x"))
    for k, rounds in ((7, 3), (500, 1), (1, 0)):
        for parts in (1, 5):
            got = clustering.cluster_vectors(df.repartition(parts), k, rounds, dims=3).collect()
            assert sorted((r.vec_id or -1, r.cluster, r.distance, r.centroid) for r in got) == _plain_lloyd(good, k, rounds)
            assert {r.inertia for r in got} == {sum(r.distance for r in got)}
            assert all(r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)
    assert clustering.cluster_vectors(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="leave a long"):
        clustering.cluster_vectors(huge, dims=3).collect()


def test_terms_are_counted_in_their_task(monkeypatch):
    """The runs of letters as the pattern says, and the same sums however often a task passes counts on."""
    import collections
    import re

    from tidelog.llm import divergence

    text = "Ünï-code A1b2 naïve\x00x\x7f y z \U0001f600end İK DON'T don't\n"
    want = [m.encode() for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    assert divergence.terms(text.encode()) == want and divergence.terms(None) == []
    batches = [{"lang": ["a", "b"], "source": ["s", "s"], "text": [text.encode(), f"x y x w{k}".encode()]} for k in range(50)]
    for most in (1, 20, 10_000):
        monkeypatch.setattr(divergence, "MOST_HELD", most)
        n, df = collections.Counter(), collections.Counter()
        for out in divergence._counted(iter(batches)):
            for lang, term, a, b in zip(out["lang"], out["term"], out["n"], out["df"], strict=True):
                n[lang, term] += a
                df[lang, term] += b
        assert n["b", b"x"] == 100 and df["b", b"x"] == 50 and n["b", b"w7"] == 1 and sum(n.values()) == 50 * (4 + len(want))
