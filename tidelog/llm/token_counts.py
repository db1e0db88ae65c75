"""Token counts without token ids: each distinct pre-token is counted once.

Pass 1 tallies pre-tokens per partition and sums the tallies; each distinct pre-token is then encoded once.
Pass 2 tallies each document again. Its frequent pre-tokens (a head of at most HEAD short ones, so of a
proven size) are summed from a broadcast dictionary; the rest are rows that join the counts by shuffle.
A blank-delimited piece that holds a code point of uncertain class is one pre-token of its own here: the library
cuts it further when it is encoded, as it would inside its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, save, table

#: The byte-level pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose Unicode class may differ between the regex module and the tokenizer library.
ODD = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d\u209e\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]"
#: The same pattern for texts of these letters, digits and signs, which the standard module matches faster.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
COMMON = re.compile(f"[\\x09-\\x0d\\x20-\\x7e\u00a1\u00a7\u00a9\u00ab\u00b0\u00bb\u00bf\u2010-\u2027\u20ac{_LETTERS}]*")
COMMON_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
#: Most entries, and most characters of one, in the broadcast dictionary: under 5 MB.
HEAD, HEAD_CHARS = 1 << 16, 32
#: Tallies are handed on when they reach so many entries.
FLUSH = 200_000


@lru_cache(maxsize=2)
def _tools(path: str):
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    special = [t["content"] for t in spec.get("added_tokens", [])]
    flagged = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    whole = regex.compile(rf" ?\S*?{ODD}\S*|{PATTERN}")
    return tok, regex.compile(PATTERN), regex.compile(ODD), whole, cut, plain and not flagged


def pretokens(text: str, path: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and the added tokens found in it (all tokens of the text for a tokenizer of
    another kind than byte-level, which is not cut into pre-tokens here)."""
    tok, pattern, odd, whole, cut, plain = _tools(path)
    if not plain:
        return [], len(tok.encode(text, add_special_tokens=False).ids)
    parts = cut.split(text) if cut and cut.search(text) else [text]
    out: list[str] = []
    for part in parts:
        if COMMON.fullmatch(part):
            out += COMMON_PATTERN.findall(part)
        else:
            out += (whole if odd.search(part) else pattern).findall(part)
    return out, len(parts) - 1


def pretoken_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row for each distinct pre-token: token, freq (in all texts), n (its tokens)."""

    def tallies(batches: Iterator[dict]) -> Iterator[dict]:
        total: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                total.update(pretokens(text, path)[0])
                if len(total) > FLUSH:
                    yield {"token": list(total), "freq": list(total.values())}
                    total.clear()
        yield {"token": list(total), "freq": list(total.values())}

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        tok = _tools(path)[0]
        for b in batches:
            found = tok.encode_batch_fast(b["token"], add_special_tokens=False)
            yield {"token": b["token"], "freq": b["freq"], "n": [len(x.ids) for x in found]}

    texts = docs.where(F.col("text").isNotNull()).select("text")
    freq = map_arrow(texts, tallies, "token string, freq bigint").groupBy("token").agg(F.sum("freq").alias("freq"))
    return map_arrow(freq, pieces, "token string, freq bigint, n bigint")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row of docs (id_col, text, any others).

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay as many rows; equal ids with other
    texts are counted apart; an empty table gives an empty result; other columns are not read. Texts are
    never cut. Recovery: the pre-token table is in the shared folder, everything else recomputes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), "text")
    counts = save(pretoken_counts(docs, path), "pretokens")
    top = counts.where(F.length("token") <= HEAD_CHARS).orderBy(F.desc("freq"), "token").limit(HEAD).select("token", "n")
    head = spark.sparkContext.broadcast({r.token: r.n for r in top.toLocalIterator()})

    def per_doc(batches: Iterator[dict]) -> Iterator[dict]:
        known = head.value
        for b in batches:
            out: dict = {k: [] for k in ("id", "h", "rows", "n_bytes", "base", "token", "freq")}
            for ident, h, text in zip(b["id"], b["h"], b["text"], strict=True):
                found, base = pretokens(text or "", path)
                tail = []
                for t, f in Counter(found).items():
                    n = known.get(t)
                    if n is None:
                        tail.append((t, f))
                    else:
                        base += n * f
                # a document's own row joins nothing: "\0" starts no pre-token of the table by itself
                for t, f in [(None, 0), *tail]:
                    first = t is None
                    out["id"].append(ident)
                    out["h"].append(h)
                    out["rows"].append(int(first))
                    out["n_bytes"].append(len(text.encode()) if first and text else 0)
                    out["base"].append(base if first else 0)
                    out["token"].append(f"\0own {ident} {h}" if first else t)
                    out["freq"].append(f)
                if len(out["id"]) > FLUSH:
                    yield out
                    out = {k: [] for k in out}
            yield out

    schema = "id bigint, h bigint, rows bigint, n_bytes bigint, base bigint, token string, freq bigint"
    keyed = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    rows = map_arrow(keyed, per_doc, schema).join(counts.select("token", "n"), "token", "left")
    return (
        rows.groupBy("id", "h")
        .agg(F.sum("rows").alias("m"), F.sum("n_bytes").alias("b"), F.sum(F.col("base") + F.col("freq") * F.coalesce("n", F.lit(0))).alias("t"))
        .select(
            F.col("id").alias(id_col),
            F.expr("b div m").alias("n_bytes"),
            F.expr("t div m").alias("n_tokens"),
            F.explode(F.expr("sequence(1L, m)")).alias("copy"),
        )
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
