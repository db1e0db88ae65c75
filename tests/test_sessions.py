"""Sessions of scripted parts, the polish chain, files, features, the protocol and the command line."""

import json
import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import tidelog
from tidelog.__main__ import main
from tidelog.functions import exprs as X
from tidelog.functions import polish, signal
from tidelog.operators import protocol
from tidelog.policy import PRESETS, SpeakerPolicy
from tidelog.schema import EVENT
from tidelog.sources import files
from tidelog.streaming import models
from tidelog.streaming.state import Frames, Passes, Pieces, Tracker, Windower, label_name


def test_chain_rules():
    loud = polish.Stage("loud", 10, frozenset({"casing"}), lambda t, c: t.upper(), lambda a, b: a.lower() == b.lower())
    wrong = polish.Stage("wrong", 20, frozenset({"words"}), lambda t, c: t + " more", lambda a, b: False)
    broken = polish.Stage("broken", 30, frozenset({"x"}), lambda t, c: 1 / 0, lambda a, b: True)
    assert polish.Chain((broken, wrong, loud)).run("one two") == ("ONE TWO", ["wrong", "broken"])
    assert polish.Chain((loud,), frozenset({"casing"})).run("one") == ("one", [])
    assert polish.Chain((loud,)).run("  ") == ("  ", [])
    assert polish.Chain().run("it is twenty five") == ("it is 25", [])


def test_punctuation_gets_context_and_keeps_words():
    asked = []
    stage = polish.punctuation(lambda t: asked.append(t) or t.capitalize() + ".")
    assert stage.apply("Two three", "a b c d e f one") == "two three." and asked == ["b c d e f one two three"]
    assert stage.verify("two three", "Two three.") and not stage.verify("two", "to")


def test_session_of_scripted_parts():
    for chunk in (0.02, 0.2, 0.5):
        log = models.demo(PRESETS["conversation"], chunk=chunk)
        assert " ".join(e["text"] for e in log if e["kind"] == "commit") == "we can meet at noon. that suits me well."
        ends = [e["reason"] for e in log if e["kind"] == "endpoint"]
        assert ends == ["complete", "complete"] or chunk == 0.5 and ends == ["complete"]  # a pause of one chunk is too short
    solo = models.demo(PRESETS["dictation"])
    assert {e["speaker"] for e in solo if e["kind"] == "commit"} == {"A"}


def test_builder_choices():
    parts = models.Backends(lambda: models.ScriptedWords([]), voices=lambda: models.ScriptedVoices([]), audio_turns=models.ScriptedTurns, restore=str.title)
    s = models.build(parts, PRESETS["conversation"])
    assert isinstance(s.turns, models.ScriptedTurns) and s.voices and {x.name for x in s.coordinator.chain.stages} == {"numbers", "punctuation"}
    s = models.build(models.Backends(parts.recogniser, voices=parts.voices, restore=str.title, punctuates=True), PRESETS["agent"])
    assert isinstance(s.turns, models.TextTurns) and s.voices is None and [x.name for x in s.coordinator.chain.stages] == ["numbers"]
    made = []
    for k in (1, 2, 1, 3, 4, 5, 1, 2):
        models.shared_model(("m", k), lambda k=k: made.append(k) or k)
    assert made == [1, 2, 3, 4, 5, 2]
    with pytest.raises(ValueError, match="half a sample"):
        s.push(b"\0")


def test_tracker_merges_and_evicts():
    seg = lambda v, at: {"start": at, "end": at + 2.0, "embedding": v, "overlap": False}
    t = Tracker(SpeakerPolicy(threshold=0.8, margin=0.01))
    assert t.observe(seg([1.0, 0.0], 0)) == ("A", "new") and t.observe(seg([0.6, 0.8], 3)) == ("B", "new")
    assert t.observe(seg([0.8, 0.6], 6)) == ("B", "") and len(t.clusters) == 2
    labels = [t.observe(seg([0.9, 0.436], 9 + 3 * k))[0] for k in range(12)]
    assert len(t.clusters) == 1 and labels[0] == "B" and labels[-1] == "A" and t.label(3, 4) == "A"  # B became the older A
    t = Tracker(SpeakerPolicy(max_speakers=2))
    labels = [t.observe(seg(v, 3 * k))[0] for k, v in enumerate(([1.0, 0, 0], [0, 1.0, 0], [1.0, 0, 0], [0, 0, 1.0], [0, 1.0, 0]))]
    assert labels == ["A", "B", "A", "C", "D"]  # B was heard longest ago; its label never comes back
    zero = Tracker(SpeakerPolicy(min_duration=0.0))
    zero.observe({"start": 1.0, "end": 3.0, "embedding": [0.8, 0.6], "overlap": False})
    zero.observe({"start": 3.0, "end": 3.0, "embedding": [1.0, 0.0], "overlap": False})
    assert zero.clusters[0].centroid() == pytest.approx([0.8, 0.6])  # a weight of zero counts nothing beside others


def test_regions_close_after_thirty_seconds():
    w = Windower(window=40.0)
    out = [x for k in range(1, 400) for x in w.observe(True, 1600, 1600 * k)]
    assert out == [(0, 480_000)]


def test_frames_do_not_depend_on_chunks():
    pcm = bytes(range(256)) * 40
    for size in (2, 300, 1024, 5000):
        f = Frames()
        got = [x for a in range(0, len(pcm), size) for x in f.push(pcm[a : a + size])]
        assert b"".join(got) + f.rest == pcm and all(len(x) == 1024 for x in got)
    assert len(b"".join(f.flush(0.5))) % 1024 == 0 and not f.rest


def test_passes_agree_trim_and_cap():
    words = [{"text": f"w{k}", "audio_start": 0.5 * k, "audio_end": 0.5 * k + 0.5} for k in range(100)]
    p = Passes()
    hear = lambda a, b: [w for w in words if a <= w["audio_start"] and w["audio_end"] <= b]
    told = [p.push(0.5, hear) for _ in range(20)]
    assert told[0] is None and told[1]["stable"] == [] and len(told[3]["stable"]) == 2
    assert p.begin == pytest.approx(p.agreement.frontier - 2.0)
    never = Passes()
    for _ in range(80):
        never.push(0.5, lambda a, b: [{"text": f"x{b}", "audio_start": a, "audio_end": b}])
    assert never.at - never.begin == pytest.approx(28.0)
    assert [w["text"] for w in p.flush(hear)["stable"]] == [f"w{k}" for k in range(20)]


def test_pieces_make_words():
    pieces = [(" Ja", 0.1, math.log(0.5)), ("nu", 0.2, math.log(0.5)), ("ary", 0.3, math.log(0.5)), (" first", 0.9, 0.0)]
    p = Pieces()
    h = p.push(pieces[:2], 0.25)
    assert h["stable"] == [] and h["tentative"][0]["text"] == "Janu" and h["fragment"]
    assert p.push([], 0.3) is None
    h = p.push(pieces[2:], 1.0)
    assert h["stable"] == [{"text": "January", "audio_start": 0.1, "audio_end": pytest.approx(0.38), "confidence": pytest.approx(0.5)}]
    assert [w["text"] for w in p.push([], 1.0, final=True)["stable"]] == ["January", "first"]
    p.push([(" later", 30.0, 0.0)], 30.2)
    assert p.words == []


def test_mel_filters_and_features():
    f = signal.mel_filters()
    assert f.shape == (80, 201) and (f >= 0).all() and (f.sum(1) > 0).all() and (np.diff(f.argmax(1)) >= 0).all()
    width = np.diff(np.linspace(0, 8000, 201))[0]
    assert np.allclose(f[40:].sum(1) * width, 1, atol=0.1)  # equal areas
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000).astype(np.float32)
    spectrum = signal.log_mel(tone)
    assert spectrum.shape == (80, 100) and spectrum.max() - spectrum.min() <= 2 + 1e-6
    assert abs(f[spectrum.mean(1).argmax()].argmax() * 40 - 1000) <= 80
    short, long = signal.window_features(tone), signal.window_features(np.tile(tone, 12))
    assert short.shape == long.shape == (80, 800)
    assert signal.samples(np.array([-32768, 0, 16384], "<i2").tobytes()).tolist() == [-1.0, 0.0, 0.5]


def test_feature_columns(spark):
    pcm = (np.sin(np.arange(20_000)) * 9000).astype("<i2").tobytes()
    df = spark.createDataFrame([(bytearray(pcm),), (bytearray(b""),)], "pcm binary")
    x = df.select(F.octet_length(signal.last_seconds(F.col("pcm"), 1.0)).alias("n"), signal.window_features_udf("pcm").alias("f"), signal.samples_udf("pcm").alias("s")).collect()
    assert [r.n for r in x] == [32_000, 0] and len(x[0].f) == 80 and len(x[0].f[0]) == 800 and len(x[0].s) == 20_000


def test_protocol_kinds_and_rounding(spark):
    log = spark.createDataFrame([(1, 0, "speech_onset", 0.12345678), (1, 1, "partial", 1.0)], "session_id bigint, seq bigint, kind string, at double")
    full = log.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EVENT.split(", ")[4:]))
    lines = [r.line for r in protocol.encode(full).collect()]
    assert json.loads(lines[0]) == {"at": 0.123457, "kind": "speech_onset", "payload": {}, "seq": 0}
    assert json.loads(lines[1])["payload"] == {"audio_end": None, "audio_start": None, "text": None}
    for bad in ('{"seq":1,"kind":"other","at":0}', "no json"):
        with pytest.raises(Exception, match="no such kind"):
            protocol.decode(spark.createDataFrame([(bad,)], "line string")).collect()
    nested = spark.createDataFrame([({"a": [1.23456789]},)], "m map<string,array<double>>")
    assert nested.select(protocol.rounded(F.col("m"), nested.schema["m"].dataType).alias("m")).first().m == {"a": [1.234568]}
    assert json.loads(spark.range(1).select(protocol.hello(F.lit("agent")).alias("line")).first().line)["sample_rate"] == 16_000


def test_quarantine(spark):
    df = spark.createDataFrame([(0, 1.0, "commit"), (-1, 1.0, "commit"), (0, -1.0, "commit"), (0, 1.0, None)], "seq bigint, at double, kind string")
    fine, bad = protocol.quarantine(df, protocol.event_problem(F.col("seq"), F.col("at"), F.col("kind")))
    assert fine.count() == 1 and sorted(r.problem for r in bad.collect()) == ["negative at", "negative seq", "no such kind"]


def test_files(spark, tmp_path):
    pcm = (np.arange(1000) % 100).astype("<i2").tobytes()
    (tmp_path / "a").mkdir()
    for name in ("one", "two"):
        (tmp_path / "a" / f"{name}.wav").write_bytes(files.wav_bytes(pcm))
    (tmp_path / "a" / "bad.wav").write_bytes(files.wav_bytes(pcm, 8000))
    (tmp_path / "a" / "x.trans.txt").write_text("one HELLO THERE\ntwo first\n")
    (tmp_path / "a" / "y.trans.txt").write_text("two last\n")
    (tmp_path / "index.json").write_text(json.dumps([{"stem": "s", "incomplete": "i.wav", "complete": "c.wav", "cut_after": "the", "cut_at": 1.5}]))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_wavs(spark, str(tmp_path)).collect()}
    assert bytes(got["one.wav"].pcm) == pcm and got["one.wav"].seconds == len(pcm) / 32_000 and "sample rate" in got["bad.wav"].problems[0]
    assert [r.path.rsplit("/", 1)[1] for r in files.list_audio(spark, str(tmp_path), limit=2).collect()] == ["bad.wav", "one.wav"]
    texts = files.read_transcripts(spark, str(tmp_path))
    paired = {r.key: r.text for r in files.with_transcripts(files.list_audio(spark, str(tmp_path)), texts).collect()}
    assert paired == {"one": "HELLO THERE", "two": "last"}
    assert files.read_index(spark, str(tmp_path / "index.json")).first().cut_at == 1.5
    assert [r.t for r in spark.createDataFrame([(["a", "b"],), ([],)], "p array<string>").select(files.problem_text(F.col("p")).alias("t")).collect()] == ["a; b", None]
    chunks = files.pcm_chunks(spark.createDataFrame([(7, bytearray(pcm))], "session_id bigint, pcm binary"), 0.01)
    rebuilt = files.recordings(chunks.select("session_id", "chunk_no", "chunk")).first()
    assert files.parse_wav(bytes(rebuilt.wav)) == (pcm, [])
    turns = spark.createDataFrame([(1, 0, "A", 0.0, 1.0), (1, 1, "B", 1.0, 2.0)], "session_id bigint, turn_idx int, speaker string, start double, end double")
    files.write_truth(turns, str(tmp_path / "truth"))
    back = files.read_truth_turns(spark, str(tmp_path / "truth" / "session_id=1")).orderBy("turn_idx").collect()
    assert [(r.turn_idx, r.speaker, r.start, r.end) for r in back] == [(0, "A", 0.0, 1.0), (1, "B", 1.0, 2.0)]


def test_labels_of_any_number(spark):
    numbers = [0, 25, 26, 701, 702, 18_277, 18_278, 10**12]
    got = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(X.label_of(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [label_name(n) for n in numbers]


def test_command_line(capsys, spark, tmp_path):
    assert main(["policies"]) == 0 and "dictation" in capsys.readouterr().out
    assert main(["demo"]) == 0 and "endpoint" in capsys.readouterr().out
    assert main(["demo", "--policy", "none"]) == 2 and main(["nothing"]) == 2 and main(["run", "no_such_query", "x"]) == 2
    assert main(["wer", str(tmp_path / "missing")]) == 1
    assert main(["queries"]) == 0 and "coordinator_batch" in capsys.readouterr().out
    spark.createDataFrame([("a b c", "a x c")], "reference string, hypothesis string").write.parquet(str(tmp_path / "pairs"))
    assert main(["wer", str(tmp_path / "pairs")]) == 0 and "0.333333" in capsys.readouterr().out


def test_commands_on_folders(capsys, spark, tmp_path):
    """Recordings with their words and truth, pairs of clips with one of them missing, and two folders of transcripts."""
    from pyspark.sql import Window

    from tidelog.sources import adapters, fixtures
    from tidelog.sources.recordings import write_recordings

    frames = adapters.audio_frames(spark, DATA).where("kind = 'audio' AND session_id < 2").withColumn("session", F.concat(F.lit("s"), "session_id"))
    write_recordings(frames, f"{tmp_path}/mix/audio")
    frames.select("session", F.col("chunk_no") * 2 + 1, "words", "tentative", "fragment").toDF("session", "chunk_no", "words", "tentative", "fragment").write.parquet(f"{tmp_path}/words")
    w = adapters.words(spark, DATA).where("conv_id < 2")
    turns = w.groupBy(F.concat(F.lit("s"), "conv_id").alias("session_id"), "turn").agg(F.min("role").alias("speaker"), (F.min("g") * 0.04).alias("start"), ((F.max("g") + 1) * 0.04).alias("end"))
    files.write_truth(turns.withColumn("turn_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1), f"{tmp_path}/mix/truth")
    assert main(["bench", f"{tmp_path}/mix", "--words", f"{tmp_path}/words"]) == 0
    out = capsys.readouterr().out
    assert "confusion_rate" in out and "p90_latency" in out and " s0" in out and " s1" in out
    assert main(["transcribe", f"{tmp_path}/mix/audio", f"{tmp_path}/lines", "--audio", "--words", f"{tmp_path}/words"]) == 0
    lines = spark.read.text(f"{tmp_path}/lines").where("session = 's0'").collect()
    assert any(json.loads(r.value)["kind"] == "commit" for r in lines)
    clip = lambda n: bytearray((b"\x00\x10" * 1600 + b"\x00\x00" * 0) * n)
    said = lambda n: [{"text": "The," if k == n // 2 else "word", "audio_end": 0.1 * (k + 1)} for k in range(n)]
    clips = [(f"c{n}", clip(n), said(n)) for n in (60, 80, 20, 200)]
    df = spark.createDataFrame(clips, "stem string, pcm binary, words array<struct<text:string,audio_end:double>>")
    assert {(r.stem, r.cut_after, r.cut_at, len(r.cut)) for r in fixtures.cut_clips(df).collect()} == {("c60", "The,", 3.1, 99_200), ("c80", "The,", 4.1, 131_200)}
    fixtures.write_pairs(df, f"{tmp_path}/pairs")
    (tmp_path / "pairs" / "audio" / "c80_complete.wav").unlink()
    (tmp_path / "pairs" / "audio" / "c60_complete.wav").write_bytes(b"nothing")
    problems = {(r.stem, r.complete): r.problems for r in fixtures.pair_scores(spark, f"{tmp_path}/pairs", "text", models.TextTurns).collect()}
    assert problems["c80", True] == ["no such file"] and "not a WAV" in problems["c60", True][0] and problems["c80", False] == []
    assert main(["endpoints", f"{tmp_path}/pairs"]) == 0 and "false_rate" in capsys.readouterr().out
    assert main(["endpoints", f"{tmp_path}/none"]) == 1
    for name, text in (("ref", "a1 one two three\n"), ("hyp", "a1 one too three\na2 lost\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.trans.txt").write_text(text)
    assert main(["wer", f"{tmp_path}/ref", f"{tmp_path}/hyp"]) == 0 and "0.333333" in capsys.readouterr().out


def test_parts_start_anew():
    """What a part remembers is gone behind reset."""
    from tidelog.streaming.detect import EnergySpeech, SpectralVoices

    loud, quiet = b"\x00\x10" * 8000, b"\x01\x00" * 8000
    for part in (EnergySpeech(), SpectralVoices()):
        first = [part.push(x, 0.5 * (k + 1)) for k, x in enumerate((quiet, loud, quiet, quiet))]
        part.reset()
        assert first == [part.push(x, 0.5 * (k + 1)) for k, x in enumerate((quiet, loud, quiet, quiet))]
    words = models.ScriptedWords([(1.0, {"stable": []}), (2.0, {"stable": [1]})])
    assert words.push(b"", 0.5) is None and words.push(b"", 2.5) == {"stable": [1]} and words.flush() is None
    words.reset()
    assert words.push(b"", 1.0) == {"stable": []}
    speech = models.ScriptedSpeech([(0.5, 1.0), (1.0, 2.0), (3.0, 3.0)])
    assert [speech.push(b"", t) for t in (0.4, 0.5, 1.0, 1.99, 2.0, 3.0)] == [False, True, True, True, False, False]


def test_public_names():
    assert all(hasattr(tidelog, n) for n in tidelog.__all__)


def test_a_merge_compares_only_centroids_that_are_new(monkeypatch):
    """30 voices that stay apart: a segment of one is compared with each other cluster once, to find its own and once more
    to merge it, however many clusters there are in pairs."""
    from tidelog.policy import SpeakerPolicy
    from tidelog.streaming import state

    t, calls = state.Tracker(SpeakerPolicy()), []
    seg = lambda k, at: {"start": at, "end": at + 2.0, "overlap": False, "embedding": [float(i == k) for i in range(30)]}
    for k in range(30):
        t.observe(seg(k, 2.0 * k))
    plain = state.cosine
    monkeypatch.setattr(state, "cosine", lambda *a: calls.append(1) or plain(*a))
    assert t.observe(seg(7, 100.0)) == ("H", "") and len(calls) == 30 + 29


def test_sessions_are_dealt_by_the_text_and_not_joined(spark, monkeypatch):
    """However small their compressed rows are, words and audio stay in as many partitions as the text asks for."""
    from tidelog.plans import audio
    from tidelog.sources import adapters

    monkeypatch.setattr(adapters, "TASK_LETTERS", 5_000)
    parts = adapters.session_parts(spark, DATA)
    assert parts > 4 and adapters.words(spark, DATA).rdd.getNumPartitions() == parts
    assert audio.in_order(adapters.audio_frames(spark, DATA), parts).rdd.getNumPartitions() == parts
