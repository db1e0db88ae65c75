"""run() against the stages' plain meaning on the small table."""

import collections
import re

from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm.common import table


def test_run(spark):
    docs = table(spark, DATA, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    out = corpus_pipeline.run(spark, DATA)
    after = {r.doc_id: r for r in out.collect()}
    assert 0 < len(after) < len(before) and out.columns[: len(docs.columns)] == docs.columns
    lines = lambda t: re.split("\n", t)
    assert all(set(lines(r.text)) <= set(lines(before[d].text)) and r.n_chars == len(r.text) for d, r in after.items())
    bad = {r.doc_id for r in corpus_pipeline.contaminated(docs, table(spark, DATA, "benchmark")).collect()}
    assert bad and not bad & set(after)
    texts = [r.text for r in after.values() if r.text]
    assert len(texts) == len(set(texts))


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "of the and that with some words", "en", None, 3), (3, "of the and that with some words", "en", None, 3), (None, "the of and", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, DATA)
            assert out.count() <= docs.count() and out.columns[:5] == df.columns, name
    # columns that clash with those of the operators keep their values, in every stage but the last
    names = ("lang_pred", "score", "n_lines", "n_dropped", "kept", "text_hash", "gone", "doc", "removed", "component_id", "item", "copies", "rate")
    wide = table(spark, DATA, "documents").withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        rows = out.collect()
        assert out.columns == wide.columns and rows and all(r[n] == f"own {n}" for r in rows for n in names), name
    assert corpus_pipeline.mixing(spark, wide, DATA).count() > 0
    assert corpus_pipeline.near_copies(spark, df, DATA).where(F.col("doc_id").isNull()).count() == 1


def test_near_copies_against_brute_force(spark):
    """Five-word shingles at 0.8, also where ten words of a hundred are appended, changed or inserted."""
    docs = table(spark, DATA.replace("sf0.001", "sf0.01"), "documents")
    base = [f"w{i}" for i in range(100)]
    planted = [base, [*base, *(f"a{i}" for i in range(10))], [*base[:90], *(f"c{i}" for i in range(10))], [*base[:40], "new", *base[40:70], "words", *base[70:]], base[:70]]
    rows = [(10**9 + k, " ".join(w)) for k, w in enumerate(planted)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sets = {}
    for d, text in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    lists, pairs, parent = collections.defaultdict(list), [], {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = collections.Counter(o for s in sets[d] for o in lists[s])
        for s in sets[d]:
            lists[s].append(d)
        pairs += [(o, d) for o, n in shared.items() if 100 * n >= 80 * (len(sets[o]) + len(sets[d]) - n)]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, DATA).collect()}
    assert got == {d for d in sets if find(d) == d}
    assert 10**9 in got and not {10**9 + 1, 10**9 + 2, 10**9 + 3} & got and 10**9 + 4 in got


def test_stages_chained_without_writing(spark):
    """A stage's result stays readable while another run's stages, and the next ones of its own, are called."""
    docs = table(spark, DATA, "documents")
    kept = corpus_pipeline.near_copies(spark, docs, DATA)
    other = corpus_pipeline.near_copies(spark, docs, DATA.replace("sf0.001", "sf0.01"))
    last = corpus_pipeline.benchmark(spark, kept, DATA)
    n = kept.count()
    assert 0 < last.count() < n < docs.count() and other.count() == n
