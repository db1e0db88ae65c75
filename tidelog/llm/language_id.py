"""Language identification: known words first, then shorter and shorter character n-grams.

Fitting takes a bounded sample of labelled rows (``per_lang`` documents of each language, chosen by a hash of
the id), counts words by language, and keeps the most frequent words and n-grams, each with its log frequency
per language. A word of a text that the table knows scores by itself; an unseen word scores by the longest of
its 5- to 1-grams that are known. The sums over a text become a posterior.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, save, table

#: Runs of letters; other alphanumerics (digits of any script) end a word.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 5
#: Words and n-grams that each language has in the model, however frequent those of others are.
OWN = 500


@dataclass
class Model:
    """langs, prior, and the rows of logs (log frequencies by language) by word and by n-gram."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def rows(self, word: str) -> list[int]:
        """The row of a known word, or the rows of an unseen word's longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        marked, grams = f"<{word}>", self.grams
        for n in range(min(LONGEST, len(marked)), 0, -1):
            found = [grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in grams]
            if found:
                return found
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        freq = Counter(WORD.findall(text.lower()))
        if not any(any(map(str.isalpha, w)) for w in freq):
            return UNKNOWN, 0.0
        at: list[int] = []
        weights: list[float] = []
        n, words = 0, self.words
        for w, c in freq.items():
            known = words.get(w)
            if known is not None:
                at.append(known)
                weights.append(c)
            elif found := self.rows(w):
                at += found
                weights += [c / len(found)] * len(found)
            else:
                continue
            n += c
        total = self.prior + (np.array(weights) @ self.logs[at] if at else 0)
        total -= total.max()
        # words of one text depend on each other: long texts count as 100 words
        p = np.exp(total * min(1.0, 100 / max(1, n)))
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def tables(word_counts: dict[str, dict[str, int]], docs_per_lang: dict[str, int], n_words: int, n_grams: int) -> Model:
    """A model from {lang: {word: count}}."""
    langs = sorted(word_counts)

    def logs(counts: dict[str, dict[str, int]], keep: int, least: int) -> dict[str, np.ndarray]:
        by: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for k, lang in enumerate(langs):
            for x, c in counts[lang].items():
                by[x][k] += c
        fit = [x for x, v in by.items() if v.sum() >= least]
        top = dict.fromkeys(sorted(fit, key=lambda x: (-by[x].sum(), x))[:keep])
        for lang in langs:  # a small language keeps its own
            top |= dict.fromkeys(sorted((x for x in counts[lang] if by[x].sum() >= least), key=lambda x: (-counts[lang][x], x))[:OWN])
        totals = np.array([max(1, sum(counts[lang].values())) for lang in langs])
        return {x: np.log((by[x] + 0.5) / (totals + 0.5 * len(by))) for x in top}

    grams: dict[str, dict[str, int]] = {}
    for lang in langs:
        g: Counter = Counter()
        for w, c in word_counts[lang].items():
            marked = f"<{w}>"
            for n in range(1, LONGEST + 1):
                for i in range(len(marked) - n + 1):
                    g[marked[i : i + n]] += c
        grams[lang] = g
    docs = np.array([docs_per_lang[lang] for lang in langs], float)
    by_word, by_gram = logs(word_counts, n_words, 2), logs(grams, n_grams, 2)
    matrix = np.array([*by_word.values(), *by_gram.values()]).reshape(-1, len(langs))
    rows = {w: i for i, w in enumerate(by_word)}, {g: len(by_word) + i for i, g in enumerate(by_gram)}
    return Model(langs, np.log((docs + 1) / (docs.sum() + len(langs))), *rows, matrix)


def fit(docs: DataFrame, per_lang: int = 1500, n_words: int = 40_000, n_grams: int = 60_000, max_langs: int = 10_000, id_col: str = "doc_id") -> Model:
    """Fit on labelled rows (id_col, text, lang): about per_lang documents of each of the max_langs most frequent
    languages, and of the words in them that occur twice or more the 4 * n_words most frequent, and the OWN most frequent of
    each language, so that a small one has a model among any number of others. Deterministic. The
    sample and the sizes of the model are bounded by these parameters; whatever is predicted sees whole texts. Columns
    named lang_pred or score don't matter here; :func:`identify` replaces them where it keeps columns."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(id_col, "lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not sizes:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n)))) if sizes else None
    chosen = rows.where((F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share[F.col("lang")])

    def tallies(batches: Iterator[dict]) -> Iterator[dict]:
        by: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                by[lang].update(WORD.findall(text.lower()))
        for lang, c in sorted(by.items()):
            yield {"lang": [lang] * len(c), "word": list(c), "n": list(c.values())}

    counts = map_arrow(chosen.select("lang", "text"), tallies, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    often = save(counts.where("n >= 2"), "word-counts")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    own = often.withColumn("r", rank).where(F.col("r") <= OWN).drop("r")
    for part in (often.orderBy(F.desc("n"), "lang", "word").limit(4 * n_words), own):
        for r in part.toLocalIterator():
            by[r.lang][r.word] = r.n
    return tables(by, sizes, n_words, n_grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", keep_columns: bool = False) -> DataFrame:
    """id_col (or all columns of docs), lang_pred and score of every row.

    With keep_columns, columns of docs named lang_pred and score are replaced.
    Null text, and text without a letter: lang_pred 'und', score 0. Ties go to the first language by name.
    Repeated rows stay, an empty table gives an empty result; with an empty model every row is 'und'. Only the
    text is an input. Whole texts; one narrow pass, so a lost executor costs only its own tasks.
    """
    source = docs if keep_columns else docs.select(id_col, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield {k: v for k, v in b.items() if keep_columns or k != "text"} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).drop(*([] if keep_columns else ["text"])).schema
    return map_arrow(source, run, schema, 512)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
