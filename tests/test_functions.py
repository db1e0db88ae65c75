import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import exprs as X
from tidelog.functions import text as N
from tidelog.operators.score import best_mapping
from tidelog.policy import CommitPolicy, EndpointPolicy, SpeakerPolicy, known_policy, policy
from tidelog.sources.files import parse_wav, pcm_chunks
from tidelog.streaming.state import Agreement, Commits, Endpoint, Tracker, Windower, label_name


@pytest.mark.parametrize(
    ("said", "written"),
    [
        ("twenty five", "25"),
        ("one hundred and five", "105"),
        ("two thousand and twenty five.", "2025."),
        ("ten percent of five dollars", "10% of $5"),
        ("the third of may", "the third of may"),
        ("may third", "may 3rd"),
        ("one two three", "one two three"),
        ("one and two", "one and two"),  # an "and" behind no scale joins nothing
        ("and twenty five and more", "and 25 and more"),  # a number starts with no "and"
        ("twenty, five", "twenty, five"),  # punctuation ends a number
        ("twenty percent", "twenty percent"),
        ("ten", "ten"),
        ("", ""),
        (None, None),
    ],
)
def test_inverse_normalise(said, written):
    assert N.inverse_normalise(said) == written


@given(st.integers(0, 10**12 - 1))
def test_numbers_round_trip(n):
    words = N.say_number(n)
    assert N.spelled_value(words.split()) == n


def test_ordinals_are_english():
    assert [N.say_ordinal(n) for n in (1, 12, 15, 18, 20, 112)] == ["first", "twelfth", "fifteenth", "eighteenth", "twentieth", "one hundred twelfth"]


def test_word_errors_against_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        s, d, i, n = N.word_errors(a, b)
        rows = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            rows = _next(rows, k, x, b)
        assert s + d + i == rows[-1] and n == len(a) and len(a) - d + i == len(b)


def plain_errors(a, b):
    rows = [list(range(len(b) + 1))]
    for k, x in enumerate(a, 1):
        rows.append(_next(rows[-1], k, x, b))
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j, s = i - 1, j - 1, s + 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return s, d, n, len(a)


def test_word_errors_against_plain_version(monkeypatch):
    """Each count, also where rows are computed again from checkpoints, and over long texts."""
    rng = random.Random(5)
    pairs = [[[rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2)] for _ in range(300)]
    pairs.append([[rng.choice("abcdefgh") for _ in range(n)] for n in (500, 430)])
    for bits in (N.TRACE_BITS, 0):
        monkeypatch.setattr(N, "TRACE_BITS", bits)
        for a, b in pairs:
            assert N.word_errors(a, b) == plain_errors(a, b)
    long = [f"w{i}" for i in range(20_000)]
    assert N.word_errors(long, [*long[:10_000], "x", *long[10_001:-1]]) == (1, 1, 0, 20_000)


def _next(last, k, x, b):
    row = [k]
    for j, y in enumerate(b, 1):
        row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_comparable():
    assert N.comparable("Dr. Smith paid 342 and a half") == "doctor smith paid three hundred forty two and a half".split()
    assert N.comparable("three hundred and forty two") == "three hundred forty two".split()


def test_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [3.0, 1.0, 2.0])], "a array<double>, z array<double>, v array<double>")
    r = df.select(X.cosine(F.col("a"), F.col("z")).alias("zero"), X.cosine(F.col("a"), F.col("a")).alias("one"), X.floor_percentile(F.col("v"), 0.5).alias("p")).first()
    assert (r.zero, r.one, r.p) == (0.0, 1.0, 2.0)
    with pytest.raises(Exception, match="unequal"):
        df.select(X.cosine(F.col("a"), F.col("v"))).collect()
    labels = spark.range(30).select(X.label_of(F.col("id")).alias("l")).collect()
    assert [r.l for r in labels] == [label_name(n) for n in range(30)]
    with pytest.raises(KeyError, match="agent"):
        policy("nobody")
    assert spark.range(1).select(known_policy(F.lit("agent"))).first()[0] == "agent"


def test_pcm(spark):
    df = pcm_chunks(spark.createDataFrame([(bytearray(1500),)], "pcm binary"), 0.02)
    assert [len(r.chunk) for r in df.orderBy("chunk_no").collect()] == [640, 640, 220]
    assert parse_wav(b"nothing")[0] is None


def test_best_mapping():
    assert best_mapping([("A", "x", 3), ("A", "y", 2), ("B", "x", 3)]) == {"A": "y", "B": "x"}
    many = [(f"p{i}", f"t{i}", 2) for i in range(9)] + [("p0", "t1", 5)]
    assert best_mapping(many)["p0"] == "t1"


@given(st.lists(st.tuples(st.sampled_from("ABCDE"), st.sampled_from("vwxyz"), st.integers(1, 4)), max_size=12, unique_by=lambda x: x[:2]))
def test_assignment_equals_every_order(pairs):
    """The first of the best assignments, in the order in which labels appear."""
    from itertools import permutations

    mine, true = (list(dict.fromkeys(p[k] for p in pairs)) for k in (0, 1))
    count, size = {(p, t): n for p, t, n in pairs}, max(len(mine), len(true))
    orders = permutations([*true, *[None] * (size - len(true))], len(mine))
    best = max(orders, key=lambda o: sum(count.get(x, 0) for x in zip(mine, o, strict=True)))
    assert best_mapping(pairs) == {p: t for p, t in zip(mine, best, strict=True) if t is not None}


def word(text, start, end, confidence=1.0):
    return {"text": text, "audio_start": start, "audio_end": end, "confidence": confidence}


def texts(words):
    return [w["text"] for w in words]


def test_commits_hold_back_what_is_behind_an_unsure_word():
    c = Commits(CommitPolicy(gate=0.5))
    said = [word("a", 0, 0.3, 0.2), word("b", 0.3, 0.6)]
    assert c.take(said, [], 0.3) == [] and c.frontier == 0
    assert texts(c.settle(said, [word("c", 0.6, 0.9)])) == ["a", "b", "c"]  # on silence nothing is left out
    assert c.settle(said, [word("c", 0.6, 0.9)]) == []
    c = Commits(CommitPolicy(gate=0.8, slow=0.5))
    assert [texts(c.take([word("maybe", 0, 0.3, 0.4)], [], at)) for at in (0.3, 0.6, 0.9)] == [[], [], ["maybe"]]


def test_commits_drop_what_the_recogniser_takes_back():
    c = Commits(CommitPolicy(gate=0.6))
    assert c.take([word("foo", 0.0, 0.4, 0.3)], [], 0.4) == []
    assert texts(c.take([word("bar", 0.0, 0.4, 0.9), word("baz", 0.4, 0.8, 0.9)], [], 0.5)) == ["bar", "baz"]
    c = Commits(CommitPolicy(gate=0.6))
    c.take([word("foo", 0.0, 0.4, 0.3)], [], 0.4)
    c.take([word("fou", 0.0, 0.4, 0.3)], [], 0.6)  # another word waits anew
    assert c.take([word("foo", 0.0, 0.4, 0.3)], [], 0.8) == [] and c.take([word("foo", 0.0, 0.4, 0.3)], [], 1.0) == []
    assert texts(c.take([word("foo", 0.0, 0.4, 0.3)], [], 1.2)) == ["foo"]


def test_commits_take_tentative_words_early():
    c = Commits(CommitPolicy(early=0.9))
    two, one = word("two", 0.2, 0.4, 0.95), word("one", 0.0, 0.2, 0.99)
    late = [word("four", 0.6, 0.8, 0.99), word("three", 0.4, 0.6, 0.1)]
    assert c.take([], [word("Ja", 0.0, 0.2, 0.99)], 1.0, fragment=True) == [] and c.frontier == 0
    assert texts(c.take([], [two, *late, one], 1.0)) == ["one", "two"]
    assert Commits().take([], [one], 1.0) == []
    assert texts(Commits(CommitPolicy(early=0.9, gate=0.5)).take([word("b", 0.5, 0.7)], [word("c", 0.7, 0.9, 0.99)], 1.0)) == ["b", "c"]


def test_commits_take_zero_length_words_once():
    c = Commits()
    z = word("z", 1.0, 1.0)
    assert len(c.take([z], [], 1.0)) == 1 and c.take([z], [], 1.1) == []


def test_endpoint_fires_once_per_run():
    e = Endpoint(EndpointPolicy())
    fired = [e.observe(sp, at, s) for sp, at, s in [(True, 0, 0), (False, 1, 0.9), (False, 1.5, 0.9), (False, 1.7, 0.9), (False, 9, 0.9)]]
    assert fired == [None, None, None, "complete", None]
    assert e.flush() is None


def test_tracker_abstains():
    t = Tracker(SpeakerPolicy())
    seg = lambda s, v, **k: {"start": s, "end": s + 2.0, "embedding": v, "overlap": False} | k
    assert t.observe(seg(0, [1.0, 0, 0])) == ("A", "new") and t.observe(seg(2, [0, 1.0, 0])) == ("B", "new")
    assert t.observe(seg(4, [0.72, 0.70, 0])) == (None, "ambiguous")
    assert t.observe(seg(6, [1.0, 0, 0], overlap=True)) == (None, "overlap")
    assert t.label(0.8, 1.1) == "A" and t.label(1.9, 2.4) == "B" and t.label(4.5, 4.8) == "B"


def region_windows(spans, seconds, chunk, **k):
    w, n, out = Windower(**k), int(chunk * 16_000), []
    for i in range(1, round(seconds / chunk) + 1):
        out += w.observe(any(a <= i * chunk < b for a, b in spans), n, i * n)
    return [(a / 16_000, b / 16_000) for a, b in out + w.close()]


def test_long_runs_of_digits_stay():
    long = "7" * 5000
    assert N.comparable(f"a {long} b 21st") == ["a", long, "b", "twenty", "first"] and N.comparable(long + "th") == [long + "th"]


def test_windows_and_agreement():
    regions = lambda spans, seconds, **k: region_windows(spans, seconds, 0.02, **k)
    assert regions([(0, 1.3)], 3) == [(0.0, 1.64)]  # pauses and the silence that ends a region count
    assert regions([(0, 2.5)], 3.5) == [(0.0, 2.0)] and regions([(0, 3.8)], 4.5) == [(0.0, 2.0), (2.0, 4.0)]
    assert regions([], 3) == [] and all(a >= 3.9 for a, _ in regions([(4.0, 9.0)], 10))
    assert any(a < 3.2 < b for a, b in regions([(0, 3), (3.2, 6)], 7)) and not any(a < 4 < b for a, b in regions([(0, 3), (5, 8)], 9))
    assert region_windows([(0, 60)], 20, 0.02, window=40.0, most=6.0)[0] == (0.0, 6.0)
    a = Agreement()
    assert a.observe([word("x", 0, 1), word("y", 1, 2)]) == []
    assert [v["text"] for v in a.observe([word("X", 0, 1), word("q", 1, 2)])] == ["X"]
