"""Speaker, endpoint and word scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import effective_speaker, floor_percentile, rate
from ..functions.text import word_errors_udf
from .align import at_point

#: Up to so many labels on both sides the assignment is the best there is.
EXACT = 7


def best_mapping(pairs: list[tuple[str, str, int]]) -> dict[str, str]:
    """Predicted to true label, for the most agreement. pairs: (predicted, true, count) in order of first
    appearance. Beyond EXACT labels: greedily by count, earlier pairs first."""
    mine, true = list(dict.fromkeys(p[0] for p in pairs)), list(dict.fromkeys(p[1] for p in pairs))
    count = {(p, t): n for p, t, n in pairs}
    if max(len(mine), len(true), 0) <= EXACT:
        return _most_agreement(mine, true, count)
    out: dict[str, str] = {}
    for p, t, _ in sorted(pairs, key=lambda x: -x[2]):
        if p not in out and t not in out.values():
            out[p] = t
    return out


def _most_agreement(mine: list[str], true: list[str], count: dict) -> dict[str, str]:
    """By dynamic programming over sets of taken true labels: most[i][taken] is the most agreement that mine[i:] can
    have beside them. Read from the front, each label takes the first true one that still reaches it; of assignments
    that agree equally, that is the first in order. One without a partner comes last."""
    places = max(len(mine), len(true))
    gain = [[count.get((p, t), 0) for t in true] + [0] * (places - len(true)) for p in mine]
    most = [[0] * (1 << places) for _ in range(len(mine) + 1)]
    free = lambda taken: [j for j in range(places) if not taken >> j & 1]
    for i in range(len(mine) - 1, -1, -1):
        for taken in range(1 << places):
            if taken.bit_count() == i:
                most[i][taken] = max(gain[i][j] + most[i + 1][taken | 1 << j] for j in free(taken))
    out, taken = {}, 0
    for i, p in enumerate(mine):
        j = next(j for j in free(taken) if gain[i][j] + most[i + 1][taken | 1 << j] == most[i][taken])
        taken |= 1 << j
        if j < len(true):
            out[p] = true[j]
    return out


def contingency(words: DataFrame, session: str) -> DataFrame:
    """session, predicted, truth, n, first (earliest g)."""
    both = words.where(F.col("predicted").isNotNull() & F.col("truth").isNotNull())
    return both.groupBy(session, "predicted", "truth").agg(F.count("*").alias("n"), F.min("g").alias("first"))


def speaker_report(words: DataFrame, turns: DataFrame, session: str) -> DataFrame:
    """Per session: words, labelled, unlabelled, correct, confused, speakers, null_rate, confusion_rate."""

    def mapped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        pairs = list(zip(rows["predicted"], rows["truth"], rows["n"], strict=True))
        m = best_mapping(pairs)
        return pd.DataFrame({session: [key[0]], "correct": [int(sum(n for p, t, n in pairs if m.get(p) == t))]})

    correct = contingency(words, session).groupBy(session).applyInPandas(mapped, f"{session} bigint, correct bigint")
    scorable = F.col("truth").isNotNull()
    counts = words.groupBy(session).agg(
        F.count_if(scorable).alias("words"),
        F.count_if(scorable & F.col("predicted").isNotNull()).alias("labelled"),
        F.count_if(scorable & F.col("predicted").isNull()).alias("unlabelled"),
        F.count_distinct(F.when(scorable, F.col("predicted"))).alias("predicted_speakers"),
    )
    true = turns.groupBy(session).agg(F.count_distinct("speaker").alias("true_speakers"))
    out = counts.join(correct, session, "left").join(true, session, "left").withColumn("correct", F.coalesce("correct", F.lit(0).cast("bigint"))).withColumn("confused", F.col("labelled") - F.col("correct"))
    return out.withColumns({"null_rate": F.round(rate(F.col("unlabelled"), F.col("words")), 6), "confusion_rate": F.round(rate(F.col("confused"), F.col("labelled")), 6)})


def named_words(log: DataFrame) -> DataFrame:
    """session_id, g (the commit's seq), audio_start, audio_end, at, predicted of a log's commits: the label of the word,
    else the last that came for it, else the last that came for its turn."""
    late = log.where("kind = 'speaker'")
    by_word = late.where("target_seq IS NOT NULL").groupBy("session_id", F.col("target_seq").alias("seq")).agg(F.max_by("speaker", "seq").alias("by_word"))
    by_turn = late.where("target_seq IS NULL").groupBy("session_id", "turn").agg(F.max_by("speaker", "seq").alias("by_turn"))
    x = log.where("kind = 'commit'").join(by_word, ["session_id", "seq"], "left").join(by_turn, ["session_id", "turn"], "left")
    return x.select("session_id", F.col("seq").alias("g"), "audio_start", "audio_end", "at", effective_speaker(F.col("speaker"), F.col("by_word"), F.col("by_turn")).alias("predicted"))


def log_report(log: DataFrame, turns: DataFrame) -> DataFrame:
    """The speaker report of each session of a log against its true turns (session_id, turn_idx, speaker, start, end), with
    percentiles of the time from a turn's start to its first named word."""
    words = at_point(named_words(log), turns, "session_id")
    report = speaker_report(words, turns, "session_id")
    first = words.where("predicted IS NOT NULL").withColumn("mid", (F.col("audio_start") + F.col("audio_end")) / 2)
    hit = first.join(turns, "session_id").where(F.col("mid").between(F.col("start"), F.col("end"))).groupBy("session_id", "turn_idx", "start").agg(F.min("at").alias("at"))
    late = hit.groupBy("session_id").agg(F.collect_list(F.greatest(F.col("at") - F.col("start"), F.lit(0.0))).alias("l"))
    p = lambda q, name: F.round(floor_percentile(F.col("l"), q), 6).alias(name)
    return report.join(late.select("session_id", p(0.5, "p50_latency"), p(0.9, "p90_latency")), "session_id", "left")


def endpoint_report(scores: DataFrame, policies: DataFrame) -> DataFrame:
    """scores (score, complete) under each policy: wrong endpoints on incomplete, missed ones on complete."""
    both = scores.crossJoin(F.broadcast(policies))  # a policy table has a few fixed rows
    fires = F.col("score") >= F.col("threshold")
    out = both.groupBy("policy").agg(
        F.count_if(~F.col("complete")).alias("incomplete"),
        F.count_if(F.col("complete")).alias("complete"),
        F.count_if(~F.col("complete") & fires).alias("false_endpoints"),
        F.count_if(F.col("complete") & ~fires).alias("missed_endpoints"),
    )
    return out.withColumns({"false_rate": F.round(rate(F.col("false_endpoints"), F.col("incomplete")), 6), "missed_rate": F.round(rate(F.col("missed_endpoints"), F.col("complete")), 6)})


def endpoint_decisions(log: DataFrame, policies: DataFrame, session: str, order: list[str], score) -> DataFrame:
    """Closed form over the gap behind each row: complete at silence_s if the score passes, else timeout at
    timeout_s; the last row of a session is flushed. A gap counts as continuous silence."""
    from pyspark.sql import Window

    nxt = F.lead("at").over(Window.partitionBy(session).orderBy(*order))
    gaps = log.withColumn("score", score).withColumn("gap", nxt - F.col("at")).crossJoin(F.broadcast(policies))
    reason = (
        F.when(F.col("gap").isNull(), "flush")
        .when((F.col("gap") >= F.col("silence_s")) & (F.col("score") >= F.col("threshold")), "complete")
        .when(F.col("gap") >= F.col("timeout_s"), "timeout")
        .otherwise("none")
    )
    return gaps.withColumn("reason", reason)


def corpus_errors(pairs: DataFrame) -> DataFrame:
    """Sums and the rate over pairs (reference, hypothesis)."""
    each = pairs.select(word_errors_udf("reference", "hypothesis").alias("e"))
    sums = each.agg(*(F.sum(f"e.{c}").alias(c) for c in ("substitutions", "deletions", "insertions", "reference_words")))
    return sums.withColumn("wer", F.round(rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("reference_words")), 6))
