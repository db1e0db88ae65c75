"""The event log: order, invariants, text, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOLERANCE

#: Places in a session's order that share a join key.
SPAN_BLOCK = 64


def with_seq(df: DataFrame, session: str, *order: str) -> DataFrame:
    """seq: 0, 1, ... within the session."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("bigint"))


def backward_events(log: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Rows whose at lies before an earlier row's."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("latest", F.max("at").over(w)).where(F.col("at") < F.col("latest") - TOLERANCE)


def overlapping_commits(commits: DataFrame, session: str, order: str) -> DataFrame:
    """Commits that begin before the commit before them ends."""
    previous = F.lag("audio_end").over(Window.partitionBy(session).orderBy(order))
    return commits.withColumn("previous_end", previous).where(F.col("audio_start") < F.col("previous_end") - TOLERANCE)


def joined_text(df: DataFrame, session: str, order: str, text: str, out: str) -> DataFrame:
    """Texts of a session in order, joined by blanks."""
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(session).agg(F.array_join(F.transform(items, lambda x: x[text]), " ").alias(out))


def transitions(df: DataFrame, session: str, order: list[str], flag: Column) -> DataFrame:
    """Rows on which flag differs from the row before; the state before the first row is false."""
    w = Window.partitionBy(session).orderBy(*order)
    return df.withColumn("flag", flag).withColumn("before", F.lag("flag", 1, False).over(w)).where(F.col("flag") != F.col("before")).drop("before")


def run_start(df: DataFrame, session: str, order: list[str], value: Column) -> DataFrame:
    """since: at of the first row of the run of equal values that a row lies in."""
    w = Window.partitionBy(session).orderBy(*order)
    islands = df.withColumn("_v", value).withColumn("_c", F.when(F.col("_v") != F.lag("_v").over(w), 1).otherwise(0)).withColumn("_i", F.sum("_c").over(w))
    return islands.withColumn("since", F.min("at").over(Window.partitionBy(session, "_i"))).drop("_v", "_c", "_i")


def turn_index(df: DataFrame, session: str, order: list[str], speaker: str) -> DataFrame:
    """turn_no: opened by the first row, then by a known speaker other than the current known one."""
    w = Window.partitionBy(session).orderBy(*order)
    before = F.last(speaker, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.row_number().over(w) == 1, 1).when(F.col(speaker).isNotNull() & (F.col(speaker) != before), 1).otherwise(0)
    return df.withColumn("_o", opens).withColumn("turn_no", F.sum("_o").over(w)).drop("_o")


def display_text(words: DataFrame, spans: DataFrame, session: str) -> DataFrame:
    """Words (session, seq, text) with each span (session, from_seq, to_seq, text) in place of its words."""
    block = lambda c: F.floor(F.col(c) / SPAN_BLOCK)  # noqa: E731  a word meets the spans of its own block only
    s = spans.select(F.col(session).alias("_s"), "from_seq", "to_seq", F.col("text").alias("span_text"), F.explode(F.sequence(block("from_seq"), block("to_seq"))).alias("_b"))
    here = (F.col(session) == F.col("_s")) & (block("seq") == F.col("_b")) & F.col("seq").between(F.col("from_seq"), F.col("to_seq"))
    joined = words.join(s, here, "left")
    shown = joined.where(F.col("from_seq").isNull() | (F.col("seq") == F.col("from_seq"))).withColumn("shown", F.coalesce("span_text", "text"))
    return joined_text(shown, session, "seq", "shown", "display")


def encoded(columns: list[Column]) -> Column:
    """A JSON object with keys in the given order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rounded(column: Column) -> Column:
    return F.round(column, 6)
