"""Admission against a plain sweep, and models that are made once a worker."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidelog.operators.admission import admitted, default_limit, sweep


def plain_sweep(rows, limit):
    """Every session against all that were let in before it."""
    inside, out = {}, {}
    for server, key, start, end in sorted((r for r in rows if r[2] is not None and r[3] is not None), key=lambda r: (r[0], r[2], r[1])):
        live = [e for e in inside.setdefault(server, []) if e > start]
        out[server, key] = len(live) < limit
        inside[server] = [*live, end] if out[server, key] else live
    return out | {(r[0], r[1]): False for r in rows if r[2] is None or r[3] is None}


@pytest.mark.parametrize("bucket_rows", [9, 10_000])
def test_admission_equals_a_plain_sweep(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(5), k, float(rng.randrange(300)), None) for k in range(200)]
    rows = [(s, k, a, a + rng.choice([0, 1, 5, 20, 400])) for s, k, a, _ in rows] + [(1, 900, None, 5.0), (2, 901, 3.0, None)]
    rows += [(4, 1000 + k, 50.0, 51.0) for k in range(40)] + [(7, 2000, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "server int, session_id int, start double, end double").repartition(3)
    got = {(r.server, r.session_id): r.admitted for r in admitted(df, 3, bucket_rows=bucket_rows).collect()}
    assert got == plain_sweep(rows, 3) and {True, False} == set(got.values())
    assert admitted(df.limit(0), 3).count() == 0


def test_sweep_and_limit():
    assert sweep([(0, 5), (1, 2), (2, 3), (4, 9)], 1, []) == ([True, False, False, False], [5]) and sweep([(5, 6)], 1, [5]) == ([True], [6])
    assert 2 <= default_limit() <= 16


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    """Each maker run leaves a file named by its process: one for each worker, though every worker scores many batches."""
    from tidelog.plans.audio import completeness_udf
    from tidelog.streaming.models import TextTurns

    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return TextTurns()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(800, numPartitions=16).select("id", F.when(F.col("id") % 2 == 0, "done.").otherwise("and").alias("text"), F.lit(None).cast("binary").alias("pcm"))
        got = df.select("id", completeness_udf("counted", make)("text", "pcm").alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.s == float(r.id % 2 == 0) for r in got)
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 1 <= len(workers) == len(set(workers)) <= 4


def test_rolling_audio_is_the_end_of_what_came(spark):
    from tidelog.plans.audio import rolling_audio
    from tidelog.sources.adapters import audio_frames

    frames = audio_frames(spark, DATA).where("kind = 'audio' AND session_id < 2")
    whole, by = {}, {}
    for r in frames.orderBy("session_id", "chunk_no").collect():
        whole[r.session_id] = whole.get(r.session_id, b"") + bytes(r.pcm)
        by[r.session_id, r.chunk_no] = whole[r.session_id][-16_000:]
    got = rolling_audio(frames, F.col("chunk_no") % 7 == 3, 0.5).collect()
    assert got and all(bytes(r.pcm) == by[r.session_id, r.chunk_no] for r in got)
    assert len(got) == sum(k % 7 == 3 for _, k in by)


def test_rounds_of_a_chain_of_long_sessions(spark, tmp_path, monkeypatch):
    """Sessions that fit so tightly that the first decides on the last: rounds grow with the bits of the number of buckets."""
    import glob

    from tidelog.operators import admission

    monkeypatch.setattr(admission, "SESSIONS_LONG", 0.1)
    monkeypatch.setattr("tidelog.plans.runner.shared_root", lambda spark, name: f"{tmp_path}/{name}")
    rows = [(0, k, float(k), k + 2.0) for k in range(256)] + [(1, 1000 + k, k / 10, k / 10 + 7.05) for k in range(300)]
    df = spark.createDataFrame(rows, "server int, session_id int, start double, end double")
    got = {(r.server, r.session_id): r.admitted for r in admitted(df, 1, bucket_rows=3).collect()}
    assert got == plain_sweep(rows, 1)
    assert 2 <= len([p for p in glob.glob(f"{tmp_path}/admission/*") if not p.endswith("rows")]) <= 9


def test_rolling_scores_ship_no_audio(spark):
    """Scores equal those of the tails, and only frames cross to Python, never tails."""
    from tidelog.plans.audio import completeness_udf, rolling_audio, rolling_scores
    from tidelog.streaming.models import SilenceTurns

    pcm = F.unhex(F.repeat(F.when(F.col("id") % 3 == 0, "0100").otherwise("d007"), 640))
    frames = spark.range(900).select((F.col("id") % 2).alias("session_id"), F.floor(F.col("id") / 2).alias("chunk_no"), pcm.alias("pcm"))
    wanted = F.col("chunk_no") % 7 == 3
    want = {(r.session_id, r.chunk_no): r.s for r in rolling_audio(frames, wanted, 0.8).select("session_id", "chunk_no", completeness_udf("silence", SilenceTurns)("text", "pcm").alias("s")).collect()}
    scores = rolling_scores(frames, wanted, "silence", SilenceTurns, 0.8)
    assert {(r.session_id, r.chunk_no): r.score for r in scores.collect()} == want and scores.columns == ["session_id", "chunk_no", "score"]
