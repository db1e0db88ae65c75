"""Source divergence audit: a term's counts by source as one wide vector, pair contributions by array functions.

All arithmetic is exact: probabilities are integers of 1e-9, and quotients are floors.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, map_arrow, save, table, text_binary
from .decontamination import once

ONE = 1_000_000_000
#: Counts below it stay longs when multiplied by ONE.
FEW = 2**63 // ONE - 2
#: Bytes of text to lower case and blanks: what is left between blanks are the runs of letters, since code points beyond
#: ASCII have no byte below 0x80.
LETTERS = bytes(b | 32 if chr(b) in string.ascii_uppercase else b if b >= 128 or chr(b) in string.ascii_lowercase else 32 for b in range(256))
#: Most terms that a task holds before it passes their counts on.
MOST_HELD = 300_000
#: Most groups of a language and source whose totals are sent to every task (16 bytes and a name each); more are joined.
SENT_GROUPS = 100_000
#: Copies of a language's totals where they are joined.
SALTS = 32


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters of a text in UTF-8, A-Z lower-cased."""
    return (text or b"").translate(LETTERS).split()


def _counted(batches: Iterator[dict]) -> Iterator[dict]:
    """Counts by lang and source, passed on whenever there are many: a task's memory doesn't grow with its texts."""
    said: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[dict]:
        for (lang, source), (n, df) in said.items():
            items = list(n)
            for part in chunks({"term": items, "n": [n[x] for x in items], "df": [df[x] for x in items]}, 10_000):
                yield {"lang": [lang] * len(part["n"]), "source": [source] * len(part["n"]), **part}
        said.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            words = terms(text)
            n, df = said[lang, source]
            n.update(words)
            df.update(set(words))
        if sum(len(n) for n, _ in said.values()) >= MOST_HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): added up in each task before the shuffle."""
    rows = docs.select("lang", "source", text_binary())
    said = map_arrow(rows, _counted, "lang string, source string, term binary, n bigint, df bigint", 1000)
    # bytes of one text's letters are whole code points
    term = F.decode("term", "UTF-8").alias("term")
    return said.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).select("lang", "source", term, "n", "df")


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 kept)), by decimals of 38 digits where the product is no long."""
    wide = lambda c: c.cast("decimal(20,0)")
    many = F.call_function("div", wide(n + 2) * F.lit(ONE).cast("decimal(10,0)"), wide(total + 2 * kept))
    return F.when(n < FEW, F.call_function("div", (n + 2) * F.lit(ONE), total + 2 * kept)).otherwise(many) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); squares are below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank, for every group of a lang and a source in docs (text, lang, source).

    A lang keeps the terms in at least least_docs of its documents. Part `pair`: how far the group's smoothed term
    distribution is from that of each other source of the lang, all ranks. Part `term`: the terms by which the group
    exceeds its lang most, the top ranks. Ties go to the smaller item by UTF-8 bytes.

    Null text, lang and source are empty strings. A group without terms, and a lang that keeps none, have their
    pairs; a lang with one source has none. Repeated rows are documents of their own. An empty table gives an
    empty result; texts are read whole; other columns are not read, whatever their names. A lang's sources are one array:
    memory of a row grows with their number, of which the result holds the square. Counts, vectors and totals lie
    in the shared folder.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sources = save(rows.select("lang", "source").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")), "sources")
    small = (sources.agg(F.sum(F.size("sources"))).first()[0] or 0) <= SENT_GROUPS
    join = _join(small)
    counts = save(term_counts(rows), "term-counts")
    by_term = counts.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"), F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = by_term.where(F.col("df") >= least_docs)
    wide = F.transform("sources", lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("bigint")))
    vectors = save(join(kept, sources).select("lang", "term", "n", wide.alias("v")), "term-vectors")
    each = vectors.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"), F.count("*").alias("kept"))
    of_sources = each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("totals"), F.max("kept").alias("kept"), F.sum("x").alias("total"))
    langs = save(sources.join(of_sources, "lang", "left"), "langs")
    p = F.transform("v", lambda n, i: probability(n, F.get("totals", i), F.col("kept")))
    scored = join(vectors, langs).select("lang", "term", "v", once(p).alias("p"), probability(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    return _pairs(scored, langs).unionByName(_terms(scored, langs, join, top))


def _join(small: bool) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """How rows meet the one row of their lang: sent to every task if all groups together are few; else shuffled, a
    lang's rows over several tasks."""
    if small:
        return lambda df, one: df.join(F.broadcast(one), "lang")
    salt = F.pmod(F.xxhash64(*map(F.col, ("term",))), F.lit(SALTS))
    return lambda df, one: df.withColumn("_salt", salt).join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["lang", "_salt"]).drop("_salt")


def _pairs(scored: DataFrame, langs: DataFrame) -> DataFrame:
    """Each term gives every pair of sources its part; parts are added up before the shuffle. A pair is the same
    both ways."""
    first = scored.where(F.size("p") > 1).select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
    part = F.transform(F.expr("slice(p, i + 2, size(p))"), lambda x, k: F.struct((F.col("i") + 1 + k).alias("j"), gap(F.get("p", F.col("i")), x).alias("f")))
    sums = first.select("lang", "i", F.explode(part).alias("x")).groupBy("lang", "i", "x.j").agg(F.sum("x.f").alias("f"))
    left = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    both = left.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).where("a <> b")
    both = both.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(sums, ["lang", "i", "j"], "left")
    return _ranked(both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0).cast("bigint")).alias("value")))


def _terms(scored: DataFrame, langs: DataFrame, join: Callable, top: int) -> DataFrame:
    over = scored.select("lang", "term", "q", F.posexplode(F.arrays_zip("v", "p")).alias("i", "x")).where("x.v > 0 AND x.p > q")
    best = _ranked(over.select("lang", "i", "term", gap(F.col("x.p"), F.col("q")).alias("value")), ("lang", "i"), "term").where(F.col("rank") <= top)
    named = join(best, langs.select("lang", "sources"))
    return named.select("lang", F.get("sources", F.col("i")).alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _ranked(df: DataFrame, keys: tuple = ("lang", "source"), item: str = "item") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), item)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of op12_source_divergence.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_n AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM full_n),
lang_n AS (SELECT lang, term, sum(n) AS n FROM full_n GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM lang_n),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
