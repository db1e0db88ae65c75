import collections
import math
import re

import numpy as np
import pytest
from conftest import DATA, same_rows
from test_functions import plain_errors

from tidelog.functions import text as N
from tidelog.plans import registry
from tidelog.schema import KINDS
from tidelog.streaming.state import label_name


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_sql(spark, duck, name):
    mine, other = same_rows(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])
    assert mine == other


def test_commit_policy_replayed(spark):
    """A plain replay of the rules over the hypotheses of one session after another."""
    got, said = collections.defaultdict(list), collections.defaultdict(list)
    for r in registry.QUERIES["commit_policy"](spark, DATA).collect():
        got[r.session].append((r.word, r.audio_start, r.released_at))
    for r in sorted(registry.said_words(spark, DATA).collect(), key=lambda r: (r.session, r.g)):
        said[r.session].append(r)
    late = 0
    for session, rows in said.items():
        edge, since, want = 0.0, {}, []
        for r in rows:
            line = sorted(r.stable, key=lambda w: w.audio_start)
            if not r.fragment:
                for w in sorted(r.tentative, key=lambda w: w.audio_start):
                    if w.confidence < 0.9:
                        break
                    line.append(w)
            line = [w for w in line if w.audio_start + 1e-6 >= edge]
            now = {}
            for w in line:
                if w.confidence < 0.6:
                    k = (round(w.audio_start, 4), w.text)
                    if k not in since or r.emitted_at - since[k] < 0.35:
                        now[k] = since.get(k, r.emitted_at)
                        break
                    late += 1
                want.append((w.text, w.audio_start, r.emitted_at))
                edge = max(edge, w.audio_end)
            since = now
        want += [(w.text, w.audio_start, r.emitted_at) for w in sorted([*r.stable, *r.tentative], key=lambda w: w.audio_start) if w.audio_start + 1e-6 >= edge]
        assert sorted(got[session], key=lambda x: x[1]) == want
    assert late and any(w == "uh" for rows in got.values() for w, *_ in rows)


def words_by_conv(spark):
    from tidelog.sources.adapters import words

    out = collections.defaultdict(list)
    for r in sorted(words(spark, DATA).collect(), key=lambda r: (r.conv_id, r.g)):
        out[r.conv_id].append(r)
    return out


def test_cluster_online_replayed(spark):
    """A second, plain clustering gives the same labels."""
    from tidelog.sources.adapters import segments

    by = collections.defaultdict(list)
    for r in sorted(segments(spark, DATA).collect(), key=lambda r: (r.session, r.i)):
        by[r.session].append(r)
    got = {(r.session, r.i): (r.label, r.reason) for r in registry.QUERIES["cluster_online"](spark, DATA).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    for session, rows in by.items():
        groups, minted, gone = {}, 0, {}
        for r in rows:
            v = np.array(r.embedding)
            mean = {k: np.average([m for m, _ in g], axis=0, weights=[w for _, w in g]) for k, g in groups.items()}
            scores = sorted(((cos(m, v), k) for k, m in mean.items()), key=lambda x: -x[0])
            if r.overlap:
                want = (None, "overlap")
            elif r.end - r.start < 1.5:
                want = (None, "too_short")
            elif not scores or scores[0][0] < 0.15:
                groups[minted] = [(v, r.end - r.start)]
                want, minted = (label_name(minted), "new"), minted + 1
            elif scores[0][0] - (scores[1][0] if len(scores) > 1 else -1) < 0.03:
                want = (None, "ambiguous")
            else:
                groups[scores[0][1]] = [*groups[scores[0][1]], (v, r.end - r.start)][-24:]
                want = (label_name(scores[0][1]), "")
            assert got[session, r.i] == want
            mean = {k: np.average([m for m, _ in g], axis=0, weights=[w for _, w in g]) for k, g in groups.items()}
            for a, b in [(a, b) for a in sorted(mean) for b in sorted(mean) if a < b and cos(mean[a], mean[b]) >= 0.18]:
                if a in groups and b in groups:
                    groups[a] = [*groups[a], *groups.pop(b)][-24:]
                    gone[b] = a
    assert {"new", "", "ambiguous", "overlap", "too_short"} <= {reason for _, reason in got.values()}


def test_coordinator_shows_every_kind_and_reason(spark):
    rows = registry.QUERIES["coordinator_batch"](spark, DATA).collect()
    assert {r.kind for r in rows} == set(KINDS) and {r.reason for r in rows if r.kind == "endpoint"} == {"complete", "timeout", "flush"}
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.session_id, r.seq)):
        by[r.session_id].append(r)
    said = {c: [("twenty" if w.g % 20 == 9 else "five" if w.g % 20 == 10 else w.word) for w in ws] for c, ws in words_by_conv(spark).items()}
    turns = {c: [w.turn for w in ws] for c, ws in words_by_conv(spark).items()}
    for session, log in by.items():
        commits = [r for r in log if r.kind == "commit"]
        assert [r.text for r in commits] == said[session]  # every word once, in order
        # the endpoints of turns but the last follow from their silence and score alone
        ends, want = [r.reason for r in log if r.kind == "endpoint"], []
        for t in sorted(set(turns[session]))[:-1]:
            rows_of, score = (2, 4, 7)[t % 3], (t * 53 + session * 31) % 100 / 100
            want += ["complete"] if rows_of >= 4 and score >= 0.6 else ["timeout"] if rows_of == 7 else []
        assert ends[: len(want)] == want and len(ends) - len(want) <= 1
        # polished texts are those of utterances with a spoken number
        text = {r.seq: r.text for r in commits}
        for r in (r for r in log if r.kind == "polished"):
            before = " ".join(text[q] for q in sorted(text) if r.from_seq <= q <= r.to_seq)
            assert r.text == before.replace("twenty five", "25") != before


def test_agreed_words_replayed(spark):
    got = collections.defaultdict(list)
    for r in registry.QUERIES["agreed_words"](spark, DATA).collect():
        got[r.session].append(r)
    for conv, ws in words_by_conv(spark).items():
        mine = sorted(got[conv], key=lambda r: r.audio_start)
        assert [r.word for r in mine][:-2] == [w.word for w in ws][:-2] and len(mine) == len(ws)
        assert all(r.agreed_at >= w.audio_end - 1e-6 for r, w in zip(mine, ws, strict=True))


def test_wer_comparable_has_no_digits(spark):
    assert not any(re.search(r"\d", r.words) for r in registry.QUERIES["wer_comparable"](spark, DATA).collect())


def test_word_errors_of_whole_texts(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents WHERE doc_id % 8 = 0").fetchall())
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["wer_pairs"](spark, DATA).collect()}
    for d, text in texts.items():
        w = re.findall(r"[^ \t\n\x0b\f\r]+", text)
        said = [[] if i % 7 == 6 else ["xx"] if i % 11 == 10 else [x, x] if i % 13 == 12 else [x] for i, x in enumerate(w)]
        assert got[d] == plain_errors(N.comparable(" ".join(w)), N.comparable(" ".join(x for s in said for x in s)))
    each = list(got.values())
    assert tuple(registry.QUERIES["corpus_wer"](spark, DATA).first())[:4] == tuple(map(sum, zip(*each)))


def test_nearest_of_many_labels(spark, tmp_path):
    rows = [(k, k, [math.cos(k / 400), math.sin(k / 400)]) for k in range(1200)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    best = [r.best for r in registry.QUERIES["nearest_centroid_margin"](spark, str(tmp_path)).select("best").collect()]
    assert len(best) == 1200 and len(set(best)) > 1000


def test_both_outcomes(spark):
    kinds = {r.reason for r in registry.QUERIES["endpoint_decisions"](spark, DATA).collect()}
    assert {"complete", "timeout", "flush", "none"} <= kinds


def test_stream_equals_batch(spark):
    rows = registry.QUERIES["stream_equals_batch"](spark, DATA).collect()
    assert rows and all(r.different == 0 and r.batch == r.stream for r in rows)


def test_log_invariants(spark):
    rows = registry.QUERIES["coordinator_batch"](spark, DATA).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.seq)):
        by.setdefault(r.session_id, []).append(r)
    named = 0
    for log in by.values():
        assert [r.seq for r in log] == list(range(len(log)))
        assert all(b.at >= a.at - 1e-6 for a, b in zip(log, log[1:]))
        commits = [r for r in log if r.kind == "commit"]
        assert all(b.audio_start >= a.audio_end - 1e-6 for a, b in zip(commits, commits[1:]))
        blank = {r.seq for r in commits if r.speaker is None}
        fills = [r for r in log if r.kind == "speaker" and r.target_seq is not None]
        assert {r.target_seq for r in fills} <= blank  # late labels fill, they never change
        named += len(fills)
    assert named


def test_chains_of_any_length(spark, tmp_path):
    from tidelog.operators.align import survivors

    merges = [(k, k - 1) for k in range(1, 300)] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    got = {r.label: (r.survivor, r.hops) for r in survivors(spark.createDataFrame(merges, "label bigint, target bigint"), str(tmp_path / "s")).collect()}
    assert all(got[k] == (0, k) for k in range(1, 300)) and {got[k][0] for k in (1000, 1001, 1002)} <= {1000, 1001}


def test_session_flags_keep_the_factor(spark):
    assert all(r.factor > 0 for r in registry.QUERIES["session_flags"](spark, DATA).select("factor").collect())


def test_polish_leaves_a_currency_behind_a_number(spark, duck, tmp_path):
    """The ninth and tenth word of a conversation are spoken numbers; the word behind them is a currency."""
    text = " ".join(["word"] * 11 + ["dollar", "percent", "May", "first."])
    spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", text.replace("dollar", "euros"))], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.after for r in registry.QUERIES["polish_utterances"](spark, str(tmp_path)).collect()}
    sql = registry.ORACLES["polish_utterances"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == {r[0]: r[2] for r in duck.sql(sql).fetchall()} and "25 dollar percent" in got[1] and "25 euros" in got[2]


def test_a_pass_looks_at_its_own_words_only():
    class Heard(list):
        looked = 0

        def __getitem__(self, key):
            found = super().__getitem__(key)
            Heard.looked += len(found) if isinstance(key, slice) else 1
            return found

        def __iter__(self):
            Heard.looked += len(self)
            return super().__iter__()

    words = Heard({"text": f"w{k}", "audio_start": k * 0.3, "audio_end": (k + 1) * 0.3} for k in range(3000))
    transcribe, Heard.looked = registry._transcriber(words), 0
    for at in range(30, 900):
        got = transcribe(at - 28.0, float(at))
        assert got and all(w["audio_start"] >= at - 28.0 and w["audio_end"] <= at + 1e-6 for w in got) and got[-1]["text"] in (f"w{int(at / 0.3) - 1}"[:1], f"w{round(at / 0.3) - 1}"[:1])
    assert Heard.looked < 870 * 100


@pytest.mark.parametrize("name", ["recording_chunks", "mixed_turns", "gate_from_folder"])
def test_files_of_one_wave_at_once(spark, duck, monkeypatch, name):
    """Sessions are written, read and deleted in waves; the rows are those of all sessions."""
    from pathlib import Path

    from pyspark.sql import DataFrameWriter

    from tidelog.sources import adapters

    shared, saved = Path(spark.conf.get("spark.checkpoint.dir")), DataFrameWriter.parquet
    before, seen = set(shared.rglob("*.wav")), []

    def parquet(self, path, *args, **named):
        seen.append(frozenset(set(shared.rglob("*.wav")) - before))
        return saved(self, path, *args, **named)

    monkeypatch.setattr(adapters, "WAVE_LETTERS", 10_000)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    mine, other = same_rows(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])
    assert mine == other and len(seen) >= 3 and set(shared.rglob("*.wav")) == before
    assert all(seen) and sum(map(len, seen)) == len(frozenset().union(*seen))  # no file in two waves


def test_audio_of_a_clip_is_made_once(spark):
    """Before, Spark put the expression of the audio where its seconds are asked for: at each of a clip's words."""
    from tidelog.sources.fixtures import cut_clips

    plan = cut_clips(registry._turn_clips(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 1


def test_hypotheses_are_read_by_their_flat_parts():
    import pyarrow as pa

    word = lambda k: {"text": f"w{k}", "audio_start": 0.1 * k, "audio_end": 0.1 * k + 0.1, "confidence": 0.5}
    lists = [[], [word(1), word(2)], None, [word(3)]]
    kind = pa.list_(pa.struct([("text", pa.string()), ("audio_start", pa.float64()), ("audio_end", pa.float64()), ("confidence", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(lists, kind)], names=["stable"])
    assert registry._heard(batch, "stable") == [[], lists[1], [], lists[3]]
    assert registry._heard(batch.slice(1, 3), "stable") == [lists[1], [], lists[3]]


def test_commit_policy_over_batches(spark):
    """The state of a session lasts from batch to batch."""
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = lambda s: sorted(map(tuple, registry.QUERIES["commit_policy"](s, DATA).collect()))
    assert rows(own) == rows(spark)


@pytest.mark.parametrize("name", ["wer_comparable", "wer_pairs", "corpus_wer"])
def test_whole_texts_come_in_small_batches(spark, name):
    own = spark.newSession()
    registry.QUERIES[name](own, DATA)
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= N.BATCH_BYTES
