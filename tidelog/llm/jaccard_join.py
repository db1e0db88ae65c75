"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of shingles of so many words (3 for the query, 5 for the pipeline); documents with equal sets form a class. All shingles have one global
order: those of a fixed part of the hash space whose frequency was counted and is low come first, the rest of
the space by hash next, the counted frequent ones last by frequency. Of a set of n shingles that must share t
with a partner, the first n - t + l hold at least l common ones; l grows with the estimated candidate cost of the
prefix, and a pair must share min(l, l') prefix shingles before it is verified exactly. Every set also has a parity
sketch; the bits in which two sketches differ are never more than the shingles in which the sets differ, so that
pairs beyond the allowed difference are left out without loss before any set is shipped.

Links become components without listing all pairs of a group. Short posting lists are joined within; in long
lists a few pivots meet the others, links are merged into components, and only members outside the list's largest
component become further pivots, until every remaining pair of a list lies in one component or has been tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean, done_with, map_arrow, save, save_by, table, text_binary

#: The query's shingle length and similarity; other callers name theirs.
WORDS, PERCENT = 3, 90
#: The counted part of the hash space: hashes below 2**64 / POOL.
POOL = 6
#: A counted shingle is frequent from so many documents on; the threshold rises until at most HOT are (16 bytes each).
FREQUENT, HOT = 12, 1 << 20
#: A posting list up to this length is joined within at once.
SHORT = 16
#: Pivots of a list in the first round (so a short one is done in it); each round takes four times as many.
PIVOTS = 16
MOST_MATCHES = 6
#: Texts or pairs of sets that a Python worker unpacks at a time.
ROWS = 512
#: 64-bit words of a parity sketch.
SKETCH = 4
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words."""
    found = text.lower().split() if text else []  # bytes: A-Z only, and white space x20, x09-x0D
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.full(max(1, len(h) - words + 1), min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        part = h[k : k + len(out)]
        out = (out ^ part) * _M1
        out = (out ^ (out >> np.uint64(29))) * _M2
    out = (out ^ (out >> np.uint64(32))) * _M3
    return np.unique(out ^ (out >> np.uint64(31)))


def overlap_needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any partner that reaches the similarity."""
    return -(-n * percent // 100)


def parity(h: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: each of its bits counts the shingles that fall on it, modulo 2."""
    odd = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Order:
    """The global order, from the counted frequent shingles."""

    def __init__(self, hot: np.ndarray, freq: np.ndarray, mean: float):
        self.hot, self.freq, self.mean, self.edge = hot, freq, mean, np.uint64((1 << 64) // POOL)

    def frequency(self, h: np.ndarray) -> np.ndarray:
        """Known frequency of frequent shingles, 0 of others."""
        if not len(self.hot):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, self.freq[at], 0)

    def prefix(self, h: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
        """The prefix of a sorted set and its number of matches l."""
        n = len(h)
        freq = self.frequency(h)
        rank = np.where(freq > 0, 2, np.where(h < self.edge, 0, 1))
        order = np.lexsort((h, freq, rank))
        least = n - overlap_needed(n, percent) + 1
        # uncounted shingles count as twice the mean of the infrequent
        cost = np.where(freq > 0, freq, np.where(h < self.edge, self.mean, 2 * self.mean))[order[:least]].sum()
        l = 1 + int(min(MOST_MATCHES - 1, np.log2(1 + cost / 4), overlap_needed(n, percent) - 1, max(0, n // 8)))
        return h[order[: least + l - 1]], l


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), text_binary())


def count_pool(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """h, n: document frequency of the shingles in the counted part of the hash space."""
    edge = np.uint64((1 << 64) // POOL)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = [s[s < edge] for s in (shingle_set(t, words) for t in b["text"])]
            h, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield {"h": h.view(np.int64), "n": n.astype(np.int32)}

    return map_arrow(docs.select("text"), run, "h bigint, n int", ROWS).groupBy("h").agg(F.sum("n").alias("n"))


def global_order(docs: DataFrame, words: int = WORDS) -> Order:
    """Counts the pool of all documents; the frequent shingles come to the driver, at most HOT of them."""
    counts = save(count_pool(docs, words).where("n > 1"), "pool")
    least = FREQUENT
    while counts.where(F.col("n") >= least).count() > HOT:
        least *= 2
    rows = [(r.h, r.n) for r in counts.where(F.col("n") >= least).toLocalIterator()]
    hot = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    freq = np.array([r[1] for r in rows], np.int64)
    by = np.argsort(hot)
    rest = counts.where(F.col("n") < least).agg(F.avg("n").alias("m")).first().m
    return Order(hot[by], freq[by], float(rest or 1))


def prefixes(docs: DataFrame, order: Order, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc, n, key (digest of the set), l, prefix, bits (parity sketch)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        o = shared.value
        for b in batches:
            out: dict = {"doc": b["doc"], "n": [], "key": [], "l": [], "prefix": [], "bits": []}
            for text in b["text"]:
                h = shingle_set(text, words)
                p, l = o.prefix(h, percent) if len(h) else (h, 0)
                out["n"].append(len(h))
                out["key"].append(xxhash.xxh3_128_digest(h.tobytes()))
                out["l"].append(l)
                out["prefix"].append(p.view(np.int64))
                out["bits"].append(parity(h))
            yield out

    return map_arrow(docs, run, "doc bigint, n int, key binary, l int, prefix array<bigint>, bits array<bigint>", ROWS)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, c: the smallest id reachable in links (a, b), for every id of nodes.

    Neighbours' smallest labels are taken and labels followed to their own labels, so that chains halve each
    round; every round is a table in the shared folder."""
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").select("id", "c", F.least("c", "m").alias("m"))
        jump = label.select(F.col("id").alias("m"), F.col("c").alias("j"))
        new = save(step.join(jump, "m", "left").select("id", F.col("c").alias("old"), F.least("m", F.coalesce("j", "m")).alias("c")), "labels")
        label = new.select("id", "c")
        if not new.where("old <> c").limit(1).count():
            break
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("c", "id").alias("c"))


def build_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, long, n, bits and its packed set s of the documents in wanted (doc, long; a row each), rebuilt from the texts.
    What is wanted grows with the corpus, so it is never broadcast."""

    def sets(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            built = [max((shingle_set(t, words) for t in texts), key=lambda s: (len(s), xxhash.xxh3_128_digest(s.tobytes()))) for texts in b["texts"]]
            yield {"doc": b["doc"], "long": b["long"], "n": [len(s) for s in built], "bits": [parity(s) for s in built], "s": [s.tobytes() for s in built]}

    one = docs.join(wanted.hint("merge"), "doc").groupBy("doc").agg(F.first("long").alias("long"), F.collect_set("text").alias("texts"))
    return map_arrow(one, sets, "doc bigint, long boolean, n int, bits array<bigint>, s binary", ROWS)


def members(sets: DataFrame) -> DataFrame:
    """doc, n, h: a row for each shingle of the sets."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for doc, n, packed in zip(b["doc"], b["n"], b["s"], strict=True):
                yield {"doc": np.full(n, doc), "n": np.full(n, n, np.int32), "h": np.frombuffer(packed, np.int64)}

    return map_arrow(sets.select("doc", "n", "s"), run, "doc bigint, n int, h bigint", ROWS)


def verify(built: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets (built, in buckets by doc) reach the similarity. Only pairs, and the sets they name,
    are shuffled."""

    def check(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield {"a": [v for v, k in zip(batch["a"], keep, strict=True) if k], "b": [v for v, k in zip(batch["b"], keep, strict=True) if k]}

    left = pairs.join(built.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
    full = left.join(built.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    return map_arrow(full.select("a", "b", "sa", "sb"), check, "a bigint, b bigint", ROWS)


def _fits(x: Column, y: Column, percent: int = PERCENT) -> Column:
    """Sizes that can reach the similarity."""
    return (x * 100 >= y * percent) & (y * 100 >= x * percent)


def _reaches(n: Column, i: Column, m: Column, j: Column, percent: int = PERCENT) -> Column:
    """Whether sets of n and m whose first common shingle stands at i and j can still reach the similarity: only
    what stands there and behind can be common."""
    return F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent


def _near(n: Column, x: Column, m: Column, y: Column, percent: int = PERCENT) -> Column:
    """Whether sets of n and m with the parity sketches x and y can reach the similarity: a sketch bit differs only
    if the sets do in a shingle that falls on it."""
    differ = reduce(Column.__add__, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH)))
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def link_components(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc, n_shingles, rep (the smallest id with the same set) and component_id of every id of docs. Sets of
    shingles of so many words are linked from a Jaccard similarity of percent / 100 on.

    Null and empty texts have no shingles and link with nothing, null ids are left out. Rows that repeat an id
    give one row: that of its largest set (by size, then digest). An empty table gives an empty result; other columns are not read; texts are read whole.
    """
    spark, texts = docs.sparkSession, _keyed(docs, id_col)
    found = save(prefixes(texts, global_order(texts, words), words, percent), "prefixes")
    base = save(found.groupBy("doc").agg(F.max(F.struct("n", "key")).alias("x")).select("doc", "x.*"), "documents")
    classes = save(base.where("n > 0").groupBy("key").agg(F.min("doc").alias("doc")), "classes")
    reps = found.join(classes, ["doc", "key"]).dropDuplicates(["doc", "key"])
    # one shuffle by shingle; n, place and l of a row in one number
    packed = (F.shiftleft(F.col("n").cast("bigint"), 35) + F.shiftleft(F.col("pos").cast("bigint"), 3) + F.col("l")).alias("p")
    one = reps.select("doc", "n", "l", F.posexplode("prefix").alias("pos", "h")).select("h", "doc", packed)
    sized = one.withColumn("size", F.count("*").over(Window.partitionBy("h"))).where("size > 1")
    unpacked = [F.shiftright("p", 35).cast("int").alias("n"), F.shiftright("p", 3).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), F.col("p").bitwiseAND(F.lit(7)).cast("int").alias("l")]
    lists = save(sized.select("h", "doc", *unpacked, "size"), "lists")
    clean(spark)
    long = save(lists.where(F.col("size") > SHORT).groupBy("doc").agg(F.count("*").cast("int").alias("hot")), "long-documents")
    nodes = save(found.join(classes, ["doc", "key"]).dropDuplicates(["doc"]).select("doc", "bits").join(long, "doc", "left").select("doc", "bits", F.coalesce("hot", F.lit(0)).alias("hot")), "nodes")
    done_with(found)

    # short lists: shared prefix shingles are counted over them; as many more may lie in the long lists as both
    # documents have there
    short = lists.where(F.col("size") <= SHORT)
    packs = short.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("doc", "n", "l", "pos"))).alias("m"))
    ordered = packs.select(F.posexplode("m").alias("i", "x"), "m")
    near = F.filter(F.expr("slice(m, i + 2, size(m))"), lambda y: _fits(F.col("x.n"), y["n"], percent))
    cold = (
        ordered.select("x", F.explode(near).alias("y"))
        .groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        .agg(F.count("*").alias("shared"), F.min(F.least("x.l", "y.l")).alias("need"), F.min("x.pos").alias("i"), F.min("y.pos").alias("j"))
    )
    able = cold.where(_reaches(F.col("na"), F.col("i"), F.col("nb"), F.col("j"), percent))
    side = lambda c: nodes.select(F.col("doc").alias(c), F.col("bits").alias(f"x{c}"), F.col("hot").alias(f"hot{c}"))
    enough = F.col("shared") + F.least("hota", "hotb") >= F.col("need")
    sketched = able.join(side("a"), "a").join(side("b"), "b").where(enough & _near(F.col("na"), F.col("xa"), F.col("nb"), F.col("xb"), percent))
    pairs = save(sketched.select("a", "b"), "pairs")
    done_with(lists)
    ids = nodes.select(F.col("doc").alias("id"))
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    wanted = ends.withColumn("long", F.lit(False)).union(long.select("doc", F.lit(True))).groupBy("doc").agg(F.max("long").alias("long"))
    # one shuffle of the texts for the pairs of short lists and for the documents in long ones
    sets = save_by(build_sets(texts, wanted, words), "doc", "sets")
    clean(spark)
    # pairs grow with the corpus, so they meet the sets by a shuffle at every size
    links = save(verify(sets, pairs.hint("merge"), percent), "links")
    comp = save(components(ids, links), "components")
    comp = _long_lists(sets.where("long"), comp, percent)
    done_with(sets)
    c = base.join(classes.withColumnRenamed("doc", "rep"), "key", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    return c.select("doc", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("rep", "doc").alias("rep"), F.coalesce("c", "rep", "doc").alias("component_id"))


def _long_lists(sets: DataFrame, comp: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links among the documents that stand in long lists. All their shingles are counted and ordered anew by
    frequency among them, so that what is a document's own comes first and positions bound the overlap well."""
    # one shuffle by shingle gives the frequency, one by document the places
    known = members(sets).withColumn("f", F.count("*").over(Window.partitionBy("h"))).where("f > 1")
    own = Window.partitionBy("doc")
    pos = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "h")) - 1
    least = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    places = save(known.withColumn("pos", pos.cast("int")).where(F.col("pos") < least).select("h", "doc", "n", "pos"), "places")
    clean(sets.sparkSession)
    long = save(places.join(sets.select("doc", "bits"), "doc"), "long")
    done_with(places)
    return _pivot_rounds(sets.select("doc", "s"), long, comp, percent)


def _pivot_rounds(sets: DataFrame, long: DataFrame, comp: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Resolves the lists; see the module's head. Members of a list have a fixed turn in it, and pivots are those of the
    next turns. A list's main component is the one that was largest behind the first round, with what it has merged with:
    who is outside it now has been outside it in each round before, so that its turn tells whether it has been a pivot."""
    turn = Window.partitionBy("h").orderBy(F.xxhash64("doc"), "doc")
    long = save(long.withColumn("turn", F.row_number().over(turn)), "turns")
    most = long.agg(F.max("turn").alias("m")).first().m or 0
    main, before, width, tested = None, 0, PIVOTS, None
    while before < most:
        now = long.join(comp.withColumnRenamed("id", "doc"), "doc")
        if main is None:
            apart = now.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
            open_, may = now.join(apart, "h"), F.lit(True)
        else:
            open_, may = now.join(main.join(comp.select("id", F.col("c").alias("main")), "id").drop("id"), "h"), F.col("c") != F.col("main")
        ripe = may & (F.col("turn") > before) & (F.col("turn") <= width)
        chosen = save(open_.where(ripe).select("h", F.col("doc").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("c").alias("pc"), F.col("bits").alias("pb")), "pivots")
        # every pair meets in the list of its first common shingle; in another list it may be left out
        able = _reaches(F.col("n"), F.col("pos"), F.col("pn"), F.col("pp"), percent) & _near(F.col("n"), F.col("bits"), F.col("pn"), F.col("pb"), percent)
        if chosen.limit(1).count():
            asked = open_.join(chosen, "h").where((F.col("c") != F.col("pc")) & able)
            pairs = asked.select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b")).distinct()
            pairs = save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.union(pairs)
            if pairs.limit(1).count():
                new = save(verify(sets, pairs, percent), "links")
                old = comp.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
                comp = save(components(comp, old.union(new)), "components")
        if main is None:
            sizes = long.join(comp.withColumnRenamed("id", "doc"), "doc").groupBy("h", "c").agg(F.count("*").alias("k"))
            largest = sizes.groupBy("h").agg(F.max(F.struct("k", "c")).alias("x"), F.count("*").alias("parts"))
            main = save(largest.where("parts > 1").select("h", F.col("x.c").alias("id")), "mains")
        before, width = width, width + 4 * (width - before)
    return comp


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")
