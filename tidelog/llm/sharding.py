"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

Rows have a place in one order: by a hash of the text (equal texts are neighbours), then by one of the id. Each
round counts the exact bytes and rows of all partitions between candidate boundaries; only ranges that still hold a
splitter (or too much for one task) get closer candidates in the next round. When every splitter meets the
tolerance, rows are exchanged once, straight to pieces of shards whose place in the shard is known by then.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

#: Bits of a place: hashes of text and id, and for rows that have both in common the place where they lie.
KEY_BITS, TIE_BITS = 63, 31
#: Bits of the first round's candidates.
FIRST_BITS = 12
#: Most counts that a round gives the driver, and so most rows of a table that is sent to every task.
MOST_COUNTS = 1 << 16
#: A piece, what one task sorts, aims at so many bytes; a shard has at least and at most so many pieces.
PIECE_BYTES, FEWEST, MOST_PIECES = 64 << 20, 64, 4096


def _hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _numbers(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of counts that the driver holds; its bound is MOST_COUNTS."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _named(rows: list[tuple], *names: str) -> list[dict]:
    return [dict(zip(names, r, strict=True)) for r in rows]


def _range(level: tuple[int, int]) -> tuple[Column, Column]:
    """The range that a row lies in where boundaries are so many bits apart."""
    return F.shiftright(F.col("_key"), level[0]), F.shiftright(F.col("_tie"), level[1])


def histogram(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Levels, and ranges in order as (key, tie, level, bytes, rows) that no splitter cuts any more: each lies in one
    shard, up to tolerance times a shard's bytes."""
    spark, levels = rows.sparkSession, [(KEY_BITS - FIRST_BITS, TIE_BITS)]

    def count(inside: list[tuple] | None) -> list[tuple]:
        part = rows
        if inside is not None:
            k, t = _range(levels[-2])
            near = _numbers(spark, _named(inside, "k", "t"), "k:bigint,t:bigint")
            part = rows.withColumns({"k": k, "t": t}).join(F.broadcast(near), ["k", "t"], "left_semi")
        k, t = _range(levels[-1])
        sums = part.groupBy(k.alias("k"), t.alias("t")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
        a, b = levels[-1]
        return [(r.k << a, r.t << b, len(levels) - 1, r.bytes, r.n) for r in sums.collect()]

    ranges = sorted(count(None))
    total = sum(r[3] for r in ranges)
    splitters = [-(-i * total // shards) for i in range(1, shards)]
    piece = _piece_bytes(total, shards)
    while levels[-1] != (0, 0):
        wide, before, i = [], 0, 0
        for r in ranges:
            while i < len(splitters) and splitters[i] <= before:
                i += 1
            cut = i < len(splitters) and splitters[i] < before + r[3] and r[3] > tolerance * total / shards
            if r[2] == len(levels) - 1 and r[4] > 1 and (cut or r[3] > 2 * piece):
                wide.append(r)
            before += r[3]
        if not wide:
            break
        bits = min(8, max(1, (MOST_COUNTS // len(wide)).bit_length() - 1))
        a, b = levels[-1]
        levels.append((max(0, a - bits), b) if a else (0, max(0, b - bits)))
        gone = set(wide)
        ranges = sorted([r for r in ranges if r not in gone] + count([(r[0] >> a, r[1] >> b) for r in wide]))
    return levels, ranges


def _piece_bytes(total: int, shards: int) -> int:
    each = min(MOST_PIECES, max(FEWEST, total // shards // PIECE_BYTES))
    return max(1, total // shards // each)


def pieces(ranges: list[tuple], shards: int) -> list[tuple]:
    """(key, tie, level, piece, shard, base) of each range: neighbours of one shard go together up to a piece's bytes;
    base is the number of the shard's rows before the piece."""
    total = sum(r[3] for r in ranges)
    most, out = _piece_bytes(total, shards), []
    before = piece = held = base = seen = 0
    now = -1
    for key, tie, level, size, n in ranges:
        shard = before * shards // total
        if shard != now:
            piece, now, held, base, seen = piece + 1, shard, 0, 0, 0
        elif held and held + size > most:
            piece, held, base = piece + 1, 0, seen
        out.append((key, tie, level, piece, shard, base))
        before, held, seen = before + size, held + size, seen + n
    return out


def shard_rows(docs: DataFrame, shards: int = 8, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes of the text and 1), shard and slot (gapless from 0 in the shard).

    Law: the shards' bytes are near equal. A row whose order leaves `before` bytes in front of it lies in shard
    before * shards // total, so a shard differs from its share by one row at most; tolerance, a part of a shard's
    bytes, lets rounds end sooner. Equal texts are neighbours in the order: only a splitter, or a piece's end, cuts
    such a group. The order depends on text and id alone; rows that have both in common are dealt by where they lie.

    A null text counts as an empty one, a null id as an empty id. Repeated rows all stay. An empty table gives an empty
    result, a text of any size is one row. Columns of docs named like the three are replaced, others are kept. A
    copy of docs lies in the shared folder, so that all rounds and the exchange see the same rows.
    """
    spark = docs.sparkSession
    plain = docs.drop("size", "shard", "slot")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + 1
    key = F.shiftleft(F.shiftright(_hash32(F.col(text_col)), 1), 32).bitwiseOR(_hash32(F.col(id_col).cast("string")))
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    placed = save(plain.withColumns({"_size": size, "_key": key, "_tie": tie}), "placed")
    levels, ranges = histogram(placed.select("_key", "_tie", "_size"), shards, tolerance)
    if not ranges:
        return placed.select(*plain.columns, F.col("_size").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    found, dealt = [], placed
    homes = pieces(ranges, shards)
    for level, (a, b) in enumerate(levels):
        own = [(k >> a, t >> b, *home) for k, t, at, *home in homes if at == level]
        if own:
            home = _numbers(spark, _named(own, "k", "t", "piece", "shard", "base"), "k:bigint,t:bigint,piece:int,shard:int,base:bigint")
            home = home.select(F.col("k").alias(f"_k{level}"), F.col("t").alias(f"_t{level}"), F.struct("piece", "shard", "base").alias(f"_home{level}"))
            k, t = _range((a, b))
            dealt = dealt.join(F.broadcast(home), (F.col(f"_k{level}") == k) & (F.col(f"_t{level}") == t), "left")
            found.append(f"_home{level}")
    dealt = dealt.select(*placed.columns, F.coalesce(*found).alias("_home")).withColumn("_piece", F.col("_home.piece"))
    at = F.row_number().over(Window.partitionBy("_piece").orderBy("_key", "_tie"))  # the exchange
    return dealt.select(*plain.columns, F.col("_size").alias("size"), F.col("_home.shard").alias("shard"), (F.col("_home.base") + at - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder shard=k for each shard; each task writes the pieces it has."""
    sharded.write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = shard_rows(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL for the rows of op11_sharding. The checksum is folded byte by byte; 3988292384 is its fixed polynomial.
ORACLE_SQL = r"""
WITH steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
keyed AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(strlen(text), 0) + 1 AS size,
  (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 1) * 4294967296 + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM keyed),
sharded AS (SELECT *, (before * 8 // total)::INT AS shard FROM placed),
summed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM sharded, steps)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM summed
"""
