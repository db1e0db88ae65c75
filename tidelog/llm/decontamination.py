"""Benchmark decontamination with DataFrame functions only.

Texts become 5-word shingle hashes. A document takes part if it holds an anchor of an item: of an item's L
shingles any L - ceil(0.8 L) + 1, since a window that is similar enough can miss fewer. Its item-sized windows
that can still reach the similarity get a SimHash; windows and items that share a block of bits (one block more
than the radius, so no pair within the radius is missed) and lie within the radius are verified by the exact
weighted Jaccard similarity of their shingles, the weight being the number of occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 a bit of the fingerprints differs with probability 0.15: 24 of 64 is 5 deviations above the mean.
RADIUS = 24
#: Most benchmark shingles that go into a plan as literals; more of them are joined instead.
LITERALS = 20_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hash of every 5 words in a row; of all words if they are fewer; empty without words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))))
    return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def once(value: Column) -> Column:
    """A generator of one row: what stands above uses its result, where a projection would be copied into
    every place (and every round of a lambda function) that names it."""
    return F.explode(F.array(value))


def simhash(hashes: Column) -> Column:
    """64 bits: each is 1 if most shingles, by occurrences, have it."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b))
    bit = lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The bits in radius + 1 blocks, as (block, value)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *(
            F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("value"))
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
    )


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """item, hs (shingles), size, need (least overlap), anchors, weights, fp. Null ids and items without a word
    are left out; equal ids with other texts are items of their own."""
    words = benchmark.where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).select(F.col(item_col).cast("bigint").alias("item"), once(words_of(F.col("text"))).alias("w"))
    hs = save(words.select("item", shingles(F.col("w")).alias("hs")).distinct(), "item-shingles")
    need = F.ceil(F.lit(SIMILARITY) * F.size("hs") - 1e-9).cast("int")
    return (
        hs.where(F.size("hs") > 0)
        .withColumn("size", F.size("hs"))
        .withColumn("need", need)
        .withColumn("anchors", F.array_distinct(F.slice(F.array_sort("hs"), F.lit(1), F.col("size") - F.col("need") + 1)))
        .withColumn("weights", F.transform(F.array_distinct("hs"), lambda h: F.struct(h.alias("h"), F.size(F.filter("hs", lambda x: x == h)).alias("n"))))
        .withColumn("fp", simhash(F.col("hs")))
        .withColumn("copy", F.xxhash64("hs"))
    )


def _values(df: DataFrame, column: str) -> list[int] | None:
    """The distinct hashes of an array column, or None if there are more than LITERALS."""
    got = df.select(F.explode(column).alias("h")).distinct().limit(LITERALS + 1).collect()
    return [r.h for r in got] if len(got) <= LITERALS else None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", radius: int = RADIUS) -> DataFrame:
    """id_col, item_col, similarity, start_word, n_words, text_hash: the best window of each document and item that
    reach the similarity.

    Null, empty and wordless texts and null ids match nothing; a document shorter than an item is one window.
    Rows that repeat an id with its text count once. Empty tables give an empty result. Other columns are not
    read; texts are read whole. Matched documents and their hits lie in the shared folder.
    """
    items = save(benchmark_items(benchmark, item_col), "items")
    texts = docs.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64("text").alias("t"), once(words_of(F.col("text"))).alias("w"))
    hashed = texts.select("doc", "t", once(shingles(F.col("w"))).alias("hs"))
    anchors, every = _values(items, "anchors"), _values(items, "hs")
    at = lambda: F.transform("hs", lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    if anchors is not None and every is not None:
        matched = hashed.where(F.exists("hs", lambda h: h.isin(anchors)))
        matched = matched.withColumn("hits", F.filter(at(), lambda x: x["h"].isin(every)))
    else:  # a benchmark of any size: its shingles are joined
        keys = items.select(F.explode("anchors").alias("h")).distinct()
        ids = hashed.select("doc", "t", F.explode("hs").alias("h")).join(keys, "h", "left_semi").select("doc", "t").distinct()
        matched = hashed.join(ids, ["doc", "t"], "left_semi").withColumn("hits", at())
    matched = save(matched.dropDuplicates(["doc", "t"]), "matched")
    spots = items.select("item", "copy", "size", "need", F.explode(F.array_distinct("hs")).alias("h"))
    hits = matched.select("doc", "t", F.explode("hits").alias("x")).select("doc", "t", "x.pos", "x.h").join(spots, "h")
    by_item = hits.groupBy("doc", "t", "item", "copy", "size", "need").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    # a window can begin at a hit without losing overlap; it must hold at least `need` hits
    last = F.greatest(F.col("m") - F.col("size"), F.lit(0))
    starts = F.array_distinct(
        F.transform(
            F.filter(F.transform("p", lambda x, i: F.struct(x.alias("s"), F.get("p", i + F.col("need") - 1).alias("e"))), lambda x: x["e"].isNotNull() & (x["e"] < x["s"] + F.col("size"))),
            lambda x: F.least(x["s"], last),
        )
    )
    windows = (
        by_item.where(F.size("p") >= F.col("need"))
        .join(matched.select("doc", "t", "hs", F.size("hs").alias("m")), ["doc", "t"])
        .withColumn("starts", starts)
        .withColumn("win", F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(F.col("hs"), s + 1, F.col("size")).alias("wh")))))
        .select("doc", "t", "item", "copy", "win.start", "win.wh")
        .withColumn("fp", simhash(F.col("wh")))
    )
    windows = save(windows, "windows")
    asked = windows.select("doc", "t", "item", "copy", "start", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.*").drop("b")
    offered = items.select("item", "copy", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.*").drop("b")
    near = (
        asked.join(offered, ["item", "copy", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("doc", "t", "item", "copy", "start")
        .distinct()
    )
    common = F.aggregate("weights", F.lit(0), lambda a, x: a + F.least(x["n"], F.size(F.filter("wh", lambda h: h == x["h"]))))
    scored = (
        near.join(windows.drop("fp"), ["doc", "t", "item", "copy", "start"])
        .join(items.select("item", "copy", "size", "weights"), ["item", "copy"])
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / (F.size("wh") + F.col("size") - F.col("common")))
        .where(F.col("common") * 10 >= 8 * (F.size("wh") + F.col("size") - F.col("common")))
    )
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), F.size("wh").alias("n"))).alias("best")
    return scored.groupBy("doc", "item", "t").agg(best).select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("start_word"),
        (F.col("best.n") + WORDS - 1).alias("n_words"),
        F.col("t").alias("text_hash"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
