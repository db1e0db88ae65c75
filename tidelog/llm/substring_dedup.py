"""Repeated passages by unit hashing, grown to their exact ends.

A line is cut into short units where its words say so, so that copies of a passage are cut alike wherever it
starts. Each normalised unit becomes a digest with its rank (document id, text, word). Digests are grouped
globally; the earliest ranked occurrence stays, later ones are repeats. Neighbouring repeats of neighbouring units
of one kept document are a run. Where one run gives way to another, the units on both sides together are a longer
unit with an earliest occurrence of its own: a document can hold a passage whole whose pieces all lie in others before
it. A run grows to both sides, word by word, as far as the text equals the kept document's, so a passage that begins
and ends inside units is found whole. Passages of ``min_words`` words or more are removed; shorter ones (a heading, a
licence line) stay. Offsets are those of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean, done_with, map_arrow, save, save_by, table

#: Scripts that put no blanks between words, as ranges of code points: there each letter counts as a word.
BLANKLESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF))
_BLANKLESS = "".join(f"{chr(a)}-{chr(b)}" for a, b in BLANKLESS)
#: White space that parts words.
WORD = re.compile(f"[{_BLANKLESS}]|[^\x20\x09-\x0d{_BLANKLESS}]+")
#: A line is cut behind the words whose hash is the least among so many on both sides: a unit has RADIUS + 1 words or
#: more, about twice that, unless the line ends; one of PIECE words without a cut is cut there.
RADIUS, PIECE = 4, 24
#: Repeats with gaps up to GAP words are a stretch; a passage has one of STRETCH words (it loses a unit on each side).
GAP, STRETCH = 16, 16
#: Units on each side, in a longer unit across the place where runs change.
ACROSS = (1, 2, 4)
#: Ranges of ids, in each of which the earliest holder of a longer unit is compared with.
RANGES = 4
#: Words compared beside a run at once; a run that still grows is compared over GROW times as many next.
BESIDE, GROW = 16, 8
ASKED = ("w", "n", "kl", "kr")
#: Characters handled at once, longer texts alone; rows handed on at a time.
CHARS, FLUSH = 1 << 18, 20_000
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _lower(text: str) -> str:
    """Lower-cased; a letter whose lower case is longer stays, so that offsets do."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of some texts: text number, offsets in it, line (through all texts) and a 64-bit hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # number of the first word of each text

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        joined = "\n".join([*map(_lower, texts), ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(size) - size
        word = (code > 0x20) | (code < 9) | ((code > 13) & (code < 0x20))
        alone = np.zeros(len(code), bool)
        if code.max(initial=0) >= BLANKLESS[0][0]:
            for a, b in BLANKLESS:
                alone |= (code >= a) & (code <= b)
        before = np.concatenate([[False], word[:-1]])
        fresh = word & (~before | alone | np.concatenate([[False], alone[:-1]]))
        start = np.flatnonzero(fresh)
        if not len(start):
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none, none.astype(np.uint64), np.zeros(len(texts), np.int64))
        number = np.cumsum(fresh) - 1
        at = np.flatnonzero(word)
        length = np.bincount(number[at], minlength=len(start))
        place = (at - start[number[at]]).astype(np.uint64)
        letters = _mix(code[at].astype(np.uint64) * _M[0] + place * _M[2])
        digest = _mix(np.add.reduceat(letters, np.concatenate([[0], np.cumsum(length)[:-1]])) * _M[0])
        text = np.searchsorted(begin, start, "right") - 1
        line = np.searchsorted(np.flatnonzero(code == 10), start)
        return cls(text, start - begin[text], start - begin[text] + length, line, digest, np.searchsorted(text, np.arange(len(texts))))


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, text number, first word in its text, words) of each unit."""
    n = len(words.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # lines lie RADIUS apart, so that a line's cuts depend on the line alone
    at = np.arange(n) + (RADIUS + 1) * (words.line - words.line[0]) + RADIUS
    wide = np.full(at[-1] + RADIUS + 1, np.iinfo(np.uint64).max)
    wide[at] = words.hash
    cut = np.ones(n, bool)
    for d in range(1, RADIUS + 1):
        cut &= (words.hash < wide[at - d]) & (words.hash <= wide[at + d])
    opens = np.concatenate([[True], cut[:-1] | (words.line[1:] != words.line[:-1])])
    since = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    opens |= since % PIECE == 0
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    place = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
    digest = _mix(np.add.reduceat(_mix(words.hash + place * _M[2]), first) * _M[0] + size.astype(np.uint64))
    text = words.text[first]
    return digest.view(np.int64), text, first - words.first[text], size


def _documents(docs: DataFrame, id_col: str) -> DataFrame:
    """doc, t, text and their key k, once in buckets by it: rounds of growth read the texts in place and shuffle only what
    they ask for."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64("text").alias("t"), "text")
    kept = save_by(texts.withColumn("k", _key()).repartition("k"), "k", "texts")
    clean(docs.sparkSession)
    return kept


def _key() -> Column:
    return F.xxhash64("doc", "t")


def _groups(texts: list[str]) -> Iterator[slice]:
    """Neighbours of at most CHARS characters in all."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHARS:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if texts:
        yield slice(first, len(texts))


def unit_rows(texts: DataFrame) -> DataFrame:
    """h, doc, t, w (first word), n (words) of every unit."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            doc, t = np.array(b["doc"], np.int64), np.array(b["t"], np.int64)
            for part in _groups(b["text"]):
                h, i, w, n = units(Words.of(b["text"][part]))
                for a in range(0, max(1, len(h)), FLUSH):
                    x = slice(a, a + FLUSH)
                    yield {"h": h[x], "doc": doc[part][i[x]], "t": t[part][i[x]], "w": w[x].astype(np.int32), "n": n[x].astype(np.int32)}

    return map_arrow(texts, run, "h bigint, doc bigint, t bigint, w int, n int", 256)


def _beside(text: str, asked: list) -> list[dict]:
    """For each (w, n, kl, kr) the hashes of kl words before and kr behind the words w to w + n, with their offsets."""
    words, out = Words.of([text]), []
    h = words.hash.view(np.int64)
    for x in asked:
        w, n = x["w"], x["n"]
        left, right = slice(max(0, w - x["kl"]), w), slice(w + n, w + n + x["kr"])
        beside = {"lh": h[left][::-1], "ls": words.start[left][::-1], "rh": h[right], "re": words.end[right]}
        out.append({k: x[k] for k in ASKED} | {"s": int(words.start[w]), "e": int(words.end[w + n - 1])} | beside)
    return out


def surroundings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """What lies beside the spans asked for (doc, t, w, n, kl, kr): offsets of the span and, nearest first, hashes
    and offsets of kl words before and kr behind it. One join of the texts, grouped by document; no group is larger
    than what its text makes possible. What is asked for grows with the corpus, so it is never broadcast."""
    fields = (*ASKED, "s", "e", "lh", "ls", "rh", "re")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last = None
        for b in batches:
            out: dict = {k: [] for k in ("doc", "t", *fields)}
            for doc, t, text, spans, *asked_of in zip(b["doc"], b["t"], b["text"], b["spans"], b["ad"], b["at"], strict=True):
                if (doc, t) == last or [doc, t] != asked_of:  # a repeated row: once is enough; two documents with one key
                    continue
                last = (doc, t)
                for at in range(0, len(spans), 512):
                    found = _beside(text, spans[at : at + 512])
                    out["doc"] += [doc] * len(found)
                    out["t"] += [t] * len(found)
                    for key in fields:
                        out[key] += [x[key] for x in found]
                    if len(out["doc"]) > 2_000:
                        yield out
                        out = {k: [] for k in out}
            yield out

    spans = asked.groupBy("doc", "t").agg(F.collect_set(F.struct(*ASKED)).alias("spans"))
    grouped = save(spans.select(_key().alias("k"), F.col("doc").alias("ad"), F.col("t").alias("at"), "spans"), "asked")
    clean(texts.sparkSession)
    schema = "doc bigint, t bigint, w int, n int, kl int, kr int, s int, e int, lh array<bigint>, ls array<int>, rh array<bigint>, re array<int>"
    return map_arrow(texts.join(grouped.hint("merge"), "k").select("doc", "t", "text", "spans", "ad", "at"), run, schema, 256)


def _common(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return F.when(differ > 0, differ - 1).otherwise(F.size(a))


def _stretches(hits: list[tuple]) -> Iterator[list[list[tuple]]]:
    """The sorted hits (w, n, kd, kt, kw) of a document as runs, lists of hits that follow each other in it and in the
    kept one; of each stretch that is long enough."""
    stretch: list[list[tuple]] = []
    end = begin = 0
    for x in hits:
        if not stretch or x[0] > end + GAP:
            if end - begin >= STRETCH:
                yield stretch
            stretch, begin = [], x[0]
        now = stretch[-1][-1] if stretch else None
        if now and now[0] + now[1] == x[0] and now[2:4] == x[2:4] and now[4] + now[1] == x[4]:
            stretch[-1].append(x)
        else:
            stretch.append([x])
        end = x[0] + x[1]
    if end - begin >= STRETCH:
        yield stretch


def _across(stretch: list[list[tuple]], min_words: int) -> Iterator[tuple]:
    """(place, key, w, n) of the longer units across each place where one run gives way to the next without a gap.
    Documents that hold such a unit have the same hits there, and so the same key. Two runs that are passages themselves
    need none."""
    words = [sum(x[1] for x in run) for run in stretch]
    for i in range(len(stretch) - 1):
        left, right = stretch[i][-1], stretch[i + 1][0]
        if left[0] + left[1] != right[0] or min(words[i], words[i + 1]) >= min_words:
            continue
        before, after = _beyond(stretch, i, -1), _beyond(stretch, i + 1, 1)
        for a in (k for k in ACROSS if k <= len(before)):
            for b in (k for k in ACROSS if k <= len(after)):
                unit = before[:a][::-1] + after[:b]
                # hash() of whole numbers is the same in every process
                yield right[0], hash(tuple(x[1:] for x in unit)), unit[0][0], unit[-1][0] + unit[-1][1] - unit[0][0]


def _beyond(stretch: list[list[tuple]], i: int, step: int) -> list[tuple]:
    """Up to ACROSS[-1] hits from the end of run i on, away from its neighbour, as long as they touch."""
    out: list[tuple] = []
    while 0 <= i < len(stretch) and len(out) < ACROSS[-1]:
        for x in stretch[i][::-1] if step < 0 else stretch[i]:
            last = out[-1] if out else None
            if len(out) == ACROSS[-1] or last and (x[0] + x[1] != last[0] if step < 0 else last[0] + last[1] != x[0]):
                return out
            out.append(x)
        i += step
    return out


def anchors(found: DataFrame, min_words: int) -> DataFrame:
    """Runs of repeats (doc, t, w, n, kd, kt, kw), of units and of longer units where runs change."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: list[tuple] = []
            for doc, t, hits in zip(b["doc"], b["t"], b["hits"], strict=True):
                for stretch in _stretches(sorted((x["w"], x["n"], x["kd"], x["kt"], x["kw"]) for x in hits)):
                    out += ((doc, t, r[0][0], sum(x[1] for x in r), *r[0][2:], None) for r in stretch)
                    out += ((doc, t, w, n, None, None, place, key) for place, key, w, n in _across(stretch, min_words))
                if len(out) >= FLUSH:
                    yield {k: [x[i] for x in out] for i, k in enumerate(names)}
                    out = []
            yield {k: [x[i] for x in out] for i, k in enumerate(names)}

    names = ("doc", "t", "w", "n", "kd", "kt", "kw", "key")
    grouped = found.groupBy("doc", "t").agg(F.collect_set(F.struct("w", "n", "kd", "kt", "kw")).alias("hits"))
    both = save(map_arrow(grouped, run, "doc bigint, t bigint, w int, n int, kd bigint, kt bigint, kw int, key bigint", 256), "runs")
    wide = both.where("key IS NOT NULL").select("key", "doc", "t", "w", "n", F.col("kw").alias("place"))
    # the earliest holder can end sooner than a later one: one of each range of ids is looked at
    edges = [r.edge for r in wide.select(F.explode(F.percentile_approx("doc", [k / RANGES for k in range(1, RANGES)], 1000)).alias("edge")).collect()]
    wide = wide.withColumn("part", sum(((F.col("doc") > e).cast("int") for e in edges), F.lit(0)))
    first = wide.groupBy("key", "part").agg(F.min(F.struct("doc", "t", "w")).alias("first")).select("key", F.col("part").alias("kept_part"), F.col("first.doc").alias("kd"), F.col("first.t").alias("kt"), F.col("first.w").alias("kw"))
    later = wide.join(first, "key").where("kept_part <= part AND (doc > kd OR doc = kd AND t > kt)")
    # of each place the longest one that a document of the range holds
    later = later.groupBy("doc", "t", "place", "kept_part").agg(F.max_by(F.struct("w", "n", "kd", "kt", "kw"), F.struct("n", "w")).alias("x")).select("doc", "t", "x.*")
    # one of those that lie alike in both documents is enough to grow from
    alike = later.groupBy("doc", "t", "kd", "kt", (F.col("kw") - F.col("w")).alias("shift")).agg(F.min(F.struct("w", "n")).alias("x"))
    return both.where("key IS NULL").drop("key").unionByName(alike.select("doc", "t", "x.w", "x.n", "kd", "kt", (F.col("x.w") + F.col("shift")).alias("kw")))


def grow(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """doc, t, kd, start, end, w, n of every run, grown as far as both texts are equal. Runs that grow into each
    other on the same places of the same kept document become one; those whose end is still open grow on."""
    done, k = None, BESIDE
    ends = runs.select("doc", "t", "kd", "kt", "w", "n", "kw", F.lit(k).alias("kl"), F.lit(k).alias("kr"))
    while True:
        mine, theirs = ["doc", "t", *ASKED], ["kd", "kt", "kw", *ASKED[1:]]
        asked = ends.select(mine).union(ends.select(theirs)).distinct()
        beside = save(surroundings(texts, asked), "beside")
        clean(texts.sparkSession)
        kept = beside.select(*(F.col(a).alias(b) for a, b in zip(mine, theirs, strict=True)), F.col("lh").alias("klh"), F.col("rh").alias("krh"))
        both = ends.join(beside, mine).join(kept, theirs)
        both = both.withColumns({"left": _common(F.col("lh"), F.col("klh")), "right": _common(F.col("rh"), F.col("krh"))})
        start = F.when(F.col("left") > 0, F.get("ls", F.col("left") - 1)).otherwise(F.col("s"))
        end = F.when(F.col("right") > 0, F.get("re", F.col("right") - 1)).otherwise(F.col("e"))
        first, last = F.col("w") - F.col("left"), F.col("w") + F.col("n") + F.col("right")
        more = lambda side, now: (F.col(side) == F.col(now)) & (F.col(now) > 0)
        wide = both.select("doc", "t", "kd", "kt", (F.col("kw") - F.col("w")).alias("shift"), first.alias("a"), last.alias("b"), start.alias("start"), end.alias("end"), more("left", "kl").alias("ol"), more("right", "kr").alias("or"))
        order = Window.partitionBy("doc", "t", "kd", "kt", "shift").orderBy("a", F.desc("b"))
        fresh = (F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
        wide = wide.withColumn("fresh", F.coalesce(fresh, F.lit(1))).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        grown = wide.groupBy("doc", "t", "kd", "kt", "shift", "island").agg(
            F.min("a").alias("w"), F.max("b").alias("b"), F.min("start").alias("start"), F.max("end").alias("end"),
            F.min(F.struct("a", ~F.col("ol"))).getField("col2").alias("sl"), F.max(F.struct("b", ~F.col("or"))).getField("col2").alias("sr"),
        )
        grown = save(grown.select("doc", "t", "kd", "kt", "w", (F.col("b") - F.col("w")).alias("n"), (F.col("w") + F.col("shift")).alias("kw"), "start", "end", "sl", "sr"), "grown")
        done_with(beside)
        shut = grown.where("sl AND sr")
        done = shut if done is None else done.union(shut)
        k *= GROW
        ends = grown.where("NOT (sl AND sr)").select("doc", "t", "kd", "kt", "w", "n", "kw", *(F.when(F.col(c), 0).otherwise(k).alias(o) for c, o in (("sl", "kl"), ("sr", "kr"))))
        if not ends.limit(1).count():
            return done.select("doc", "t", "kd", "start", "end", "w", "n")


def repeated_spans(docs: DataFrame, min_words: int = 51, id_col: str = "doc_id", within: bool = False) -> DataFrame:
    """id_col, start, end, n_words, keep_id (a document that keeps the passage), text_hash.

    A row for each removed span: passages of min_words words or more that an earlier ranked document holds, those
    that overlap as one. With ``within``, what repeats an earlier place of its own document counts too.
    Null and empty texts have no units, null ids are left out; rows that repeat an id with its text count as one
    document, the same id with another text as another, ranked by text hash. Of equal places the first word's
    number ranks. An empty table gives an empty result; other columns are not read; texts are read whole. A very
    common unit is pre-aggregated before the shuffle, and its occurrences join by a splittable shuffle. Texts (once, in
    buckets), first occurrences, runs and grown passages lie in the shared folder.
    """
    texts = _documents(docs, id_col)
    rank = F.struct("doc", "t", "w")
    grouped = unit_rows(texts).groupBy("h").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    first = save(grouped.where("n > 1").select("h", F.col("first.doc").alias("kd"), F.col("first.t").alias("kt"), F.col("first.w").alias("kw")), "first-units")
    clean(docs.sparkSession)
    other = (F.col("doc") != F.col("kd")) | (F.col("t") != F.col("kt"))
    later = unit_rows(texts).join(first, "h").where(other | (F.col("w") > F.col("kw")) if within else other).drop("h")
    runs = save(anchors(later, min_words), "anchors")
    done_with(first)
    fit = grow(texts, runs).where(F.col("n") >= min_words).distinct()
    # overlapping passages of a document become one
    order = Window.partitionBy("doc", "t").orderBy("start", "end", "kd")
    fresh = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = fit.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.max(F.col("w") + F.col("n")) - F.min("w")
    merged = islands.groupBy("doc", "t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), words.alias("n_words"), F.max(F.struct("n", -F.col("kd"))).alias("best"))
    return merged.select(F.col("doc").alias(id_col), "start", "end", F.col("n_words").cast("bigint"), (-F.col("best.col2")).alias("keep_id"), F.col("t").alias("text_hash"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the spans cut out of text, and removed: array<struct<start,end>> in the original's offsets."""
    cuts = spans.groupBy(F.col(id_col), F.col("text_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    keyed = docs.drop("removed").withColumn("_h", F.xxhash64("text"))
    joined = keyed.join(cuts.withColumnRenamed("text_hash", "_h"), [id_col, "_h"], "left").drop("_h")
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    cut = joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept))
    return cut.select(*(c for c in docs.columns if c != "removed"), "removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
