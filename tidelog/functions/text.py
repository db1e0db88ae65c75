"""Numbers in and out of words, and word error rates: plain functions and their pandas UDFs."""

from __future__ import annotations

import re
from itertools import pairwise
from math import isqrt

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import EQUIVALENTS

#: Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "january february march april may june july august september october november december".split()
CURRENCIES = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€"}
#: Words between two of which an "and" is left out.
NUMBER_VOCABULARY = [*UNITS, *TENS, *SCALES, *IRREGULAR.values()]

_OTHER = re.compile(r"[^\w'\s]")
_REPLACED, _SPOKEN = set(EQUIVALENTS), set(NUMBER_VOCABULARY)
_MARKS = ".,!?;:"
_VALUE = {w: n for n, w in enumerate(UNITS)} | {w: 10 * n for n, w in enumerate(TENS, 2)}
_ORDINAL = {w: n for n, w in enumerate(ORDINALS, 1)} | {"thirtieth": 30}
#: Number words by class; a run of one number is read by a pattern over classes.
_CLASS = {w: "u" if n < 10 else "t" for w, n in zip(UNITS, range(20), strict=True)} | dict.fromkeys(TENS, "d") | {"hundred": "h", "thousand": "k", "million": "m", "billion": "b", "and": "a"}
_GROUP = "(?:(?:du?|t|u)(?:ha?(?:du?|t|u)?)?)"
_NUMBER = re.compile(f"(?:{_GROUP}ba?)?(?:{_GROUP}ma?)?(?:{_GROUP}ka?)?{_GROUP}?")


def say_number(n: int) -> str:
    """Cardinal words; no 'and'."""
    out: list[str] = []
    billions, rest = divmod(n, 10**9)
    if billions:
        out += [say_number(billions), "billion"]
    for name in ("million", "thousand", ""):
        group, rest = divmod(rest, SCALES.get(name, 1))
        hundreds, small = divmod(group, 100)
        out += [UNITS[hundreds], "hundred"] if hundreds else []
        if small >= 20:
            out += [TENS[small // 10 - 2], *([UNITS[small % 10]] if small % 10 else [])]
        elif small:
            out.append(UNITS[small])
        out += [name] if group and name else []
    return " ".join(out) or "zero"


def say_ordinal(n: int) -> str:
    *head, last = say_number(n).split()
    last = IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return " ".join([*head, last])


#: A longer run of digits is no number and stays; Python reads no more into one either.
MOST_DIGITS = 4300


def speak_digits(text: str) -> str:
    text = text.replace("%", " percent").replace("$", " dollars ")

    def say(m: re.Match) -> str:
        digits = m[1].replace(",", "")
        if len(digits) > MOST_DIGITS:
            return m[0]
        return say_ordinal(int(digits)) if m[2] else say_number(int(digits))

    return re.sub(r"(\d[\d,]*)(st|nd|rd|th)?", say, text)


def comparable(text: str | None) -> list[str]:
    """The words that a word error rate compares."""
    words = _OTHER.sub(" ", speak_digits((text or "").lower())).split()
    if _REPLACED & set(words):
        words = [EQUIVALENTS.get(w, w) for w in words]
    if "and" in words:
        last = len(words) - 1
        words = [w for i, w in enumerate(words) if not (w == "and" and 0 < i < last and words[i - 1] in _SPOKEN and words[i + 1] in _SPOKEN)]
    return words

def spelled_value(words: list[str]) -> int | None:
    """The one number that words spell, or None: a count-off and an 'and' after no scale are several."""
    classes = "".join(_CLASS.get(w, "?") for w in words)
    if not classes or classes[-1] == "a" or not _NUMBER.fullmatch(classes):
        return None
    if any(c == "d" and words[i] in ("zero",) for (c, _), i in zip(pairwise(classes), range(1, len(words)), strict=True)):
        return None
    total = group = 0
    for w in words:
        if w == "hundred":
            group *= 100
        elif w in SCALES:
            total, group = total + group * SCALES[w], 0
        elif w != "and":
            group += _VALUE[w]
    return total + group


def _bare(token: str) -> str:
    return token.lower().strip(_MARKS)


def _tail(token: str) -> str:
    return token[len(token.rstrip(_MARKS)) :]


def _numbers(tokens: list[str]) -> list[str]:
    """Runs of number words become digits where two words or more spell one number. A run also ends at
    punctuation inside it."""
    out: list[str] = []
    at = 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and _bare(tokens[end]) in _CLASS and (end > at or _bare(tokens[end]) != "and"):
            end += 1
            if _tail(tokens[end - 1]):
                break
        while end > at and _bare(tokens[end - 1]) == "and":
            end -= 1
        run = [_bare(t) for t in tokens[at:end]]
        value = spelled_value(run) if len(run) > 1 else None
        if value is not None:
            out.append(f"{value}{_tail(tokens[end - 1])}")
        else:
            end = max(end, at + 1)
            out += tokens[at:end]
        at = end
    return out


def written_cardinals(text: str) -> str:
    """Numbers of two words or more in digits, everything else as it is."""
    tokens = text.split()
    written = _numbers(tokens)
    return text if written == tokens else " ".join(written)


def _suffix(n: int) -> str:
    return "th" if n % 100 in range(10, 21) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def inverse_normalise(text: str | None) -> str | None:
    """Spoken numbers, dates, percent and money as written ones; anything unclear stays in words."""
    if not (text or "").strip():
        return text
    tokens = _numbers(text.split())
    bare = ["", *map(_bare, tokens), ""]
    for i, (before, word, after) in enumerate(zip(bare, bare[1:], bare[2:], strict=False)):
        if word in _ORDINAL and (before in MONTHS or after in MONTHS):
            tokens[i] = f"{_ORDINAL[word]}{_suffix(_ORDINAL[word])}{_tail(tokens[i])}"
        elif word in UNITS and (after == "percent" or after in CURRENCIES):
            tokens[i] = f"{_VALUE[word]}{_tail(tokens[i])}"
    out = re.sub(r"\b(\d[\d,]*) percent\b", r"\1%", " ".join(tokens))
    return re.sub(rf"\b(\d[\d,]*) ({'|'.join(sorted(CURRENCIES, key=len, reverse=True))})\b", lambda m: CURRENCIES[m[2]] + m[1], out)


def keeps_other_words(before: str, after: str) -> bool:
    """Whether all words but those of numbers are the same."""
    loose = {*_CLASS, *_ORDINAL, *CURRENCIES, "percent"}
    pick = lambda text: [w for w in re.findall(r"[0-9a-z']+", text.lower()) if w not in loose and not any(map(str.isdigit, w))]
    return pick(before) == pick(after)


#: Most bits of a traceback kept at once; beyond it blocks of rows are computed again from checkpoints.
TRACE_BITS = 1 << 26


def _error_rows(reference: list[str], at: dict[str, int], full: int, start: tuple[int, int], kept: list | None = None) -> tuple[int, int]:
    """The differences along a row (up, down) behind the reference words, from those before. kept gets, for each
    word, bits over the hypothesis: cost equal to that before both words; one more than before the reference word."""
    up, down = start
    for r in reference:
        same = at.get(r)
        level = ((((same & up) + up) ^ up) | same | down) & full if same else down
        more = down | full ^ (level | up)
        if kept is not None:
            kept.append((level, more))
        shifted = more << 1 | 1
        up, down = ((level & up) << 1 | ~(level | shifted)) & full, shifted & level
    return up, down


def word_errors(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, deletions, insertions, reference words of a least alignment; of equal costs a
    substitution is preferred to a deletion, a deletion to an insertion. Rows are bit vectors; long texts keep
    one of about sqrt(n) rows and compute the others again on the way back."""
    rows, m = len(reference), len(hypothesis)
    at: dict[str, int] = {}
    for j, h in enumerate(hypothesis):
        at[h] = at.get(h, 0) | 1 << j
    block = max(1, rows if 2 * rows * m <= TRACE_BITS else isqrt(rows))
    full = (1 << m) - 1
    marks = [(full, 0)]
    for k in range(0, rows - block, block):
        marks.append(_error_rows(reference[k : k + block], at, full, marks[-1]))
    i, j, s, d, n = rows, m, 0, 0, 0
    while i and j:
        first = (i - 1) // block * block
        kept: list[tuple[int, int]] = []
        _error_rows(reference[first:i], at, full, marks[first // block], kept)
        while i > first and j:
            level, more = kept[i - 1 - first]
            if reference[i - 1] == hypothesis[j - 1]:
                i, j = i - 1, j - 1
            elif not level >> (j - 1) & 1:
                i, j, s = i - 1, j - 1, s + 1
            elif more >> (j - 1) & 1:
                i, d = i - 1, d + 1
            else:
                j, n = j - 1, n + 1
    return s, d + i, n + j, rows


#: Most bytes of texts that go to a Python worker at once: their words as Python strings take many times more.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lets the batches of whole texts hold BATCH_BYTES, unless the session names a limit of its own."""
    if int(spark.conf.get(_BYTES).rstrip("b")) >= 64 << 20:  # Spark's default
        spark.conf.set(_BYTES, str(BATCH_BYTES))


@F.pandas_udf(T.StringType())
def say_number_udf(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) else say_number(int(x)))


@F.pandas_udf(T.StringType())
def inverse_normalise_udf(text: pd.Series) -> pd.Series:
    return text.map(inverse_normalise)


@F.pandas_udf(T.ArrayType(T.StringType()))
def comparable_udf(text: pd.Series) -> pd.Series:
    return text.map(comparable)


_ERRORS = ("substitutions", "deletions", "insertions", "reference_words")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _ERRORS]))
def word_errors_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = [word_errors(comparable(r), comparable(h)) for r, h in zip(reference, hypothesis, strict=True)]
    return pd.DataFrame(rows, columns=list(_ERRORS))
