"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EQUIVALENTS = {"mr": "mister", "mrs": "missus", "dr": "doctor", "st": "saint", "ok": "okay", "'em": "them"}
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "with", "for", "that", "but", "or", "as", "at", "by", "from", "into", "upon", "which", "his", "her", "their", "an", "on", "is", "was", "were")


def once(value: Column) -> Column:
    """A generator of one row: lambda functions above it read its result instead of computing it each time."""
    return F.explode(F.array(value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; an error for unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def rate(num: Column, den: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(0.0)


def floor_percentile(values: Column, q: float) -> Column:
    """Of an array: the element at floor(n * q), capped; null if empty. p50 of two values is the larger."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(n - 1, F.floor(n * F.lit(float(q))).cast("int")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^0-9a-z']+"), lambda w: w != "")


def preserves_words(a: Column, b: Column) -> Column:
    return words_of(a) == words_of(b)


def agreement_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_']+", ""))


def wer_words(text: Column) -> Column:
    """Comparable words of a text without digits: punctuation to spaces, equivalents, no 'and' inside a number."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_'\s]", " "), r"\s+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for pair in EQUIVALENTS.items() for x in pair))
    return F.transform(raw, lambda w: F.coalesce(F.try_element_at(table, w), w))


def drop_number_and(words: Column, vocabulary: list[str]) -> Column:
    """words without an 'and' that stands between two number words."""
    known = lambda w: F.coalesce(w.isin(vocabulary), F.lit(False))
    return F.filter(words, lambda w, i: ~((w == "and") & known(F.get(words, i - 1)) & known(F.get(words, i + 1)) & (i > 0)))


def terminal_completeness(text: Column) -> Column:
    """1 behind a sentence mark (quotes and brackets aside), 0 behind other text, 0.5 for none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), r"[\"')\]]+$", "")
    return F.when(bare == "", 0.5).when(bare.rlike(r"[.?!]$"), 1.0).otherwise(0.0)


def label_of(n: Column) -> Column:
    """0, 1, ... to A..Z, AA, AB, ..."""
    letter = lambda k: F.call_function("char", (k % 26 + 65).cast("bigint"))
    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))
    step = lambda acc: F.when(acc["n"] < 0, acc).otherwise(F.struct((F.floor(acc["n"] / 26) - 1).alias("n"), F.concat(letter(acc["n"]), acc["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, lambda acc, _: step(acc))["s"]  # 13 letters hold any bigint


def passing_prefix(words: Column, least: float) -> Column:
    """The longest prefix of words whose confidence is least or more."""
    bad = F.array_position(F.transform(words, lambda w: w["confidence"] >= least), F.lit(False))
    return F.when(bad == 0, words).otherwise(F.slice(words, F.lit(1), (bad - 1).cast("int")))


def common_prefix(old: Column, new: Column) -> Column:
    """The longest prefix of new whose words agree with old's, as new spells them."""
    same = F.zip_with(old, new, lambda a, b: F.coalesce(agreement_key(a) == agreement_key(b), F.lit(False)))
    bad = F.array_position(same, F.lit(False))
    upto = F.when(bad == 0, F.least(F.size(old), F.size(new))).otherwise((bad - 1).cast("int"))
    return F.slice(new, F.lit(1), upto.cast("int"))


def effective_speaker(*candidates: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def log_mean_confidence(logp: Column) -> Column:
    return F.least(F.lit(1.0), F.exp(F.avg(logp)))


def pcm_seconds(pcm: Column, sample_rate: int = 16_000) -> Column:
    return F.octet_length(pcm) / F.lit(2.0 * sample_rate)
