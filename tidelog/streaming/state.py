"""Order-dependent operators as plain step functions, shared by batch and streaming.

Each class is the state of one session; its methods take one observation and return what it causes. States are
plain data, so they pickle into a keyed state store.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions.polish import Chain
from ..functions.signal import TOKEN_TAIL
from ..policy import CommitPolicy, EndpointPolicy, Policy, SpeakerPolicy

EPS = 1e-6


def label_name(n: int) -> str:
    """0, 1, ... as A..Z, AA, AB, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass
class Commits:
    """Final words: taken in time order from the frontier on, each word once."""

    policy: CommitPolicy = CommitPolicy()
    frontier: float = 0.0
    held: dict | None = None  # name (place, text) and since
    seen: set = field(default_factory=set)

    def _open(self, words: list[dict]) -> list[dict]:
        fresh = [w for w in words if w["audio_start"] + EPS >= self.frontier and (round(w["audio_start"], 4), w["text"]) not in self.seen]
        return sorted(fresh, key=lambda w: w["audio_start"]) if len(fresh) > 1 else fresh

    def _commit(self, words: list[dict]) -> list[dict]:
        out = []
        for w in words:
            if out and w["audio_start"] < self.frontier - EPS:
                continue  # overlaps the word just committed
            out.append(w)
            self.frontier = max(self.frontier, w["audio_end"])
            self.seen.add((round(w["audio_start"], 4), w["text"]))
        if out:
            self.seen = {k for k in self.seen if k[0] + 1 >= self.frontier}
        return out

    def take(self, stable: list[dict], tentative: list[dict], at: float, fragment: bool = False) -> list[dict]:
        """Stable words, and tentative ones of a confident prefix unless the last of them may be half a word. With
        the gate on, a word below it waits for `slow` seconds and holds back those behind it; the wait counts only
        while the recogniser goes on saying that word at that place."""
        later = [] if fragment or self.policy.early > 1.0 else sorted(tentative, key=lambda w: w["audio_start"])
        sure = next((i for i, w in enumerate(later) if w["confidence"] < self.policy.early), len(later))
        ready, waited, self.held = [], self.held, None
        for w in self._open(stable) + self._open(later[:sure]):
            if w["confidence"] < self.policy.gate:
                name = (round(w["audio_start"], 4), w["text"])
                again = waited is not None and waited["name"] == name
                if not again or at - waited["since"] < self.policy.slow:
                    self.held = waited if again else {"name": name, "since": at}
                    break
            ready.append(w)
        return self._commit(ready)

    def settle(self, stable: list[dict], tentative: list[dict]) -> list[dict]:
        """On silence and at the end: all that the recogniser still says, in order, so that no hole stays."""
        self.held = None
        return self._commit(self._open([*stable, *tentative]))

    flush = settle


@dataclass
class Endpoint:
    """One endpoint per run of silence behind speech."""

    policy: EndpointPolicy = EndpointPolicy()
    silence_since: float | None = None
    fired: bool = False
    had_speech: bool = False

    def held(self, at: float) -> float:
        """Seconds of silence behind speech."""
        return 0.0 if self.silence_since is None else at - self.silence_since

    @property
    def wants_score(self) -> bool:
        return self.had_speech and self.silence_since is not None and not self.fired

    def observe(self, speaking: bool, at: float, score: float) -> str | None:
        if speaking:
            self.silence_since, self.fired, self.had_speech = None, False, True
            return None
        if not self.had_speech:
            return None
        if self.silence_since is None:
            self.silence_since = at
            return None
        held = self.held(at)
        if self.fired:
            return None
        reason = "timeout" if held >= self.policy.timeout else "complete" if held >= self.policy.silence and score >= self.policy.threshold else None
        if reason:
            self.fired, self.had_speech = True, False
        return reason

    def flush(self) -> str | None:
        if not self.had_speech or self.fired:
            return None
        self.fired, self.had_speech = True, False
        return "flush"


@dataclass
class Cluster:
    index: int
    ring: list  # (embedding, weight)
    last_heard: float
    # of a ring and its length: its centroid, and the length of that
    known: tuple | None = field(default=None, repr=False, compare=False)

    def _mean(self) -> tuple:
        if self.known is None or self.known[0] is not self.ring or self.known[1] != len(self.ring):
            total = sum(w for _, w in self.ring) or 1.0
            mean = [sum(v[i] * w for v, w in self.ring) / total for i in range(len(self.ring[0][0]))]
            self.known = (self.ring, len(self.ring), mean, length(mean))
        return self.known

    def centroid(self) -> list[float]:
        return self._mean()[2]

    def length(self) -> float:
        return self._mean()[3]


def length(a: list[float]) -> float:
    return math.sqrt(sum(x * x for x in a))


def cosine(a: list[float], b: list[float], of_a: float | None = None, of_b: float | None = None) -> float:
    """of_a, of_b: the lengths, where they are known."""
    if len(a) != len(b):
        raise ValueError("vectors of unequal length")
    n = (length(a) if of_a is None else of_a) * (length(b) if of_b is None else of_b)
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


@dataclass
class Tracker:
    """Online clustering of voice segments, and labels for word spans."""

    policy: SpeakerPolicy = SpeakerPolicy()
    clusters: list[Cluster] = field(default_factory=list)
    minted: int = 0
    merged: dict[int, int] = field(default_factory=dict)
    spans: list = field(default_factory=list)  # (start, end, index)
    # centroids that have been compared with each other and not merged, by cluster
    compared: dict[int, list] = field(default_factory=dict, repr=False, compare=False)

    def _new(self, seg: dict) -> int:
        if len(self.clusters) >= self.policy.max_speakers:
            self.clusters.remove(min(self.clusters, key=lambda c: c.last_heard))
        self.clusters.append(Cluster(self.minted, [(seg["embedding"], seg["end"] - seg["start"])], seg["end"]))
        self.minted += 1
        return self.minted - 1

    def observe(self, seg: dict) -> tuple[str | None, str]:
        """Label and reason ('', 'new', or why there is none). Merges follow every segment; the label is that before them."""
        index, reason = self._assign(seg)
        if index is not None:
            self.spans.append((seg["start"], seg["end"], index))
            newest = max(s[1] for s in self.spans)
            self.spans = [s for s in self.spans if s[1] >= newest - self.policy.memory]
        label = None if index is None else label_name(self.resolve(index))
        self._merge()
        return label, reason

    def _assign(self, seg: dict) -> tuple[int | None, str]:
        if seg["overlap"]:
            return None, "overlap"
        if seg["end"] - seg["start"] < self.policy.min_duration:
            return None, "too_short"
        own = length(seg["embedding"])
        scored = sorted(((cosine(c.centroid(), seg["embedding"], c.length(), own), -i) for i, c in enumerate(self.clusters)), reverse=True)
        best, second = (scored[0][0] if scored else -1.0), (scored[1][0] if len(scored) > 1 else -1.0)
        if best < self.policy.threshold:
            return self._new(seg), "new"
        if best - second < self.policy.margin:
            return None, "ambiguous"
        c = self.clusters[-scored[0][1]]
        c.ring = [*c.ring, (seg["embedding"], seg["end"] - seg["start"])][-self.policy.history :]
        c.last_heard = seg["end"]
        return c.index, ""

    def resolve(self, index: int) -> int:
        for _ in range(len(self.merged) + 1):
            if index not in self.merged:
                break
            index = self.merged[index]
        return index

    def _merge(self) -> None:
        """Clusters nearer than threshold + margin become the older one. Only pairs with a centroid that is new since the
        last time are compared: the others were too far apart then."""
        limit = self.policy.threshold + self.policy.margin
        by = sorted(self.clusters, key=lambda c: c.index)
        old = {c.index for c in by if self.compared.get(c.index) is c.centroid()}
        near = lambda a, b: cosine(a.centroid(), b.centroid(), a.length(), b.length()) >= limit
        pairs = [(a, b) for i, a in enumerate(by) for b in by[i + 1 :] if not (a.index in old and b.index in old) and near(a, b)]
        self.compared = {c.index: c.centroid() for c in by}
        for a, b in pairs:
            if a in self.clusters and b in self.clusters:
                a.ring = [*a.ring, *b.ring][-self.policy.history :]
                a.last_heard = max(a.last_heard, b.last_heard)
                self.clusters.remove(b)
                self.merged[b.index] = a.index

    def label(self, start: float, end: float) -> str | None:
        """By most overlap, else by the nearest spans on both sides where they agree."""
        laps = [(round(min(end, e) - max(start, s), 9), -i) for i, (s, e, _) in enumerate(self.spans)]
        if laps and max(laps)[0] > 0:
            return label_name(self.resolve(self.spans[-max(laps)[1]][2]))
        before = max(((e, i) for i, (_, e, _) in enumerate(self.spans) if 0 <= start - e <= self.policy.max_gap), default=None)
        after = min(((s, i) for i, (s, _, _) in enumerate(self.spans) if 0 <= s - end <= self.policy.max_gap), default=None)
        found = {self.resolve(self.spans[x[1]][2]) for x in (before, after) if x}
        return label_name(found.pop()) if len(found) == 1 else None


@dataclass
class Windower:
    """Speech regions in fixed windows, counted in samples. A region starts with the chunk that speech is heard in and
    holds every sample from there on, those of pauses too; `pause` seconds of silence end it, and its rest is a window if
    it is long enough. A region that holds `most` seconds beyond its windows ends as well."""

    pause: float = 0.35
    window: float = 2.0
    least: float = 1.5
    most: float = 30.0
    rate: int = 16_000
    start: int | None = None  # of what is held, in samples
    held: int = 0
    quiet: int = 0

    def observe(self, speaking: bool, samples: int, at: int) -> list[tuple[int, int]]:
        """Windows, as sample positions, that are complete with a chunk of so many samples that ends at sample `at`."""
        if self.start is None:
            if not speaking:
                return []
            self.start = max(0, at - samples)
        self.held += samples
        self.quiet = 0 if speaking else self.quiet + samples
        if self.held >= int(self.most * self.rate) or self.quiet / self.rate >= self.pause:
            return self.close()
        return self._whole()

    def _whole(self) -> list[tuple[int, int]]:
        size = int(self.window * self.rate)
        n = self.held // size
        out = [(self.start + k * size, self.start + (k + 1) * size) for k in range(n)]
        self.start, self.held = self.start + n * size, self.held - n * size
        return out

    def close(self) -> list[tuple[int, int]]:
        if self.start is None:
            return []
        out = self._whole()
        if self.held >= int(self.least * self.rate):
            out.append((self.start, self.start + self.held))
        self.start, self.held, self.quiet = None, 0, 0
        return out


@dataclass
class Frames:
    """Samples in frames of one size, however they are cut up."""

    size: int = 512
    rest: bytes = b""

    def push(self, pcm: bytes) -> list[bytes]:
        data, step = self.rest + pcm, 2 * self.size
        n = len(data) // step
        self.rest = data[n * step :]
        return [data[k * step : (k + 1) * step] for k in range(n)]

    def flush(self, padding: float = 0.0, rate: int = 16_000) -> list[bytes]:
        """The rest behind so many seconds of silence, the last frame filled up with it."""
        out = self.push(b"\0" * (2 * int(padding * rate)))
        last, self.rest = self.rest, b""
        return [*out, last.ljust(2 * self.size, b"\0")] if last else out


@dataclass
class Agreement:
    """Words that two passes in a row agree on, aligned by their start."""

    last: list[dict] = field(default_factory=list)
    frontier: float = 0.0

    def observe(self, words: list[dict]) -> list[dict]:
        key = lambda w: "".join(c for c in w["text"].lower() if c.isalnum() or c in "_'")
        old, new = ([w for w in ws if w["audio_start"] + EPS >= self.frontier] for ws in (self.last, words))
        stable = []
        for a, b in zip(old, new, strict=False):
            if key(a) != key(b):
                break
            stable.append(b)
        self.last = words
        if stable:
            self.frontier = max(self.frontier, stable[-1]["audio_end"])
        return stable

    def open(self) -> list[dict]:
        return [w for w in self.last if w["audio_start"] + EPS >= self.frontier]


@dataclass
class Passes:
    """A recogniser that runs over its whole buffer every `interval` seconds of audio. Agreed words are stable; the
    buffer keeps `context` seconds before them and `most` seconds in all. transcribe(from, to) gives a pass's words."""

    interval: float = 1.0
    context: float = 2.0
    most: float = 28.0
    begin: float = 0.0
    at: float = 0.0
    pending: float = 0.0
    stable: list[dict] = field(default_factory=list)
    agreement: Agreement = field(default_factory=Agreement)

    def _heard(self, transcribe) -> list[dict]:
        cut = [{**w, "audio_end": min(w["audio_end"], self.at)} for w in transcribe(self.begin, self.at) if w["text"].strip()]
        return [w for w in cut if w["audio_end"] >= w["audio_start"] >= self.begin - EPS]

    def push(self, seconds: float, transcribe) -> dict | None:
        """None while no pass is due; else stable (all so far) and tentative words."""
        self.at += seconds
        self.pending += seconds
        if self.pending < self.interval - 1e-9:
            return None
        self.pending = 0.0
        self.stable += self.agreement.observe(self._heard(transcribe))
        self.begin = min(self.at, max(self.begin, self.agreement.frontier - self.context, self.at - self.most))
        return {"stable": list(self.stable), "tentative": self.agreement.open(), "consumed_to": self.at}

    def flush(self, transcribe) -> dict:
        """The end: nothing can disagree any more."""
        rest = [w for w in self._heard(transcribe) if w["audio_start"] + EPS >= self.agreement.frontier]
        self.stable = sorted([*self.stable, *rest], key=lambda w: w["audio_start"])
        return {"stable": list(self.stable), "tentative": [], "consumed_to": self.at}


def assemble(pieces: list[tuple[str, float, float]], cap: float) -> dict:
    """One word of pieces (text, start, log probability)."""
    start, last = pieces[0][1], pieces[-1][1]
    sure = math.exp(sum(p[2] for p in pieces) / len(pieces))
    return {"text": "".join(p[0] for p in pieces).strip(), "audio_start": start, "audio_end": min(max(last + TOKEN_TAIL, start), max(cap, start)), "confidence": min(1.0, sure)}


@dataclass
class Pieces:
    """New pieces of a recogniser that only ever appends, as they come: a leading blank starts a word and completes the
    one before. The last word is tentative and may be a fragment. Complete words stay in the hypothesis for `keep` seconds,
    longer than any policy holds one back."""

    keep: float = 10.0
    words: list[dict] = field(default_factory=list)
    pending: list[tuple] = field(default_factory=list)

    def push(self, pieces: list[tuple[str, float, float]], consumed_to: float, final: bool = False) -> dict | None:
        """The hypothesis behind these pieces; None if there is no new one."""
        if not pieces and not final:
            return None
        for piece in pieces:
            if piece[0].startswith(" ") and self.pending:
                self.words.append(assemble(self.pending, piece[1]))
                self.pending = []
            self.pending.append(piece)
        tail, self.words = [assemble(self.pending, consumed_to)] if self.pending else [], [w for w in self.words if w["audio_end"] >= consumed_to - self.keep]
        if final:
            self.words, self.pending = self.words + tail, []
            return {"stable": list(self.words), "tentative": [], "consumed_to": consumed_to, "fragment": False}
        return {"stable": list(self.words), "tentative": tail, "consumed_to": consumed_to, "fragment": True}

    def reset(self) -> None:
        self.words, self.pending = [], []


@dataclass
class Coordinator:
    """One session's log. push takes one chunk row and returns its events."""

    policy: Policy = Policy()
    seq: int = 0
    at: float = 0.0
    onset: bool = False
    degraded: bool = False
    turn: int = 0
    speaker: str | None = None
    turn_unnamed: bool = False
    commits: Commits | None = None
    endpoint: Endpoint | None = None
    tracker: Tracker | None = None
    open_words: list = field(default_factory=list)  # (seq, start, end) without a label
    heard: dict | None = None  # the last hypothesis
    scored_at: float = -math.inf
    score: float = 0.0
    chain: Chain | None = field(default_factory=Chain)
    utterance: list = field(default_factory=list)  # (seq, text) since the last endpoint
    context: str = ""

    def __post_init__(self) -> None:
        self.commits = self.commits or Commits(self.policy.commit)
        self.endpoint = self.endpoint or Endpoint(self.policy.endpoint)
        self.tracker = self.tracker or Tracker(self.policy.speaker)

    def _event(self, kind: str, **payload) -> dict:
        self.seq += 1
        return {"seq": self.seq - 1, "kind": kind, "at": self.at, **payload}

    def _word(self, w: dict) -> list[dict]:
        if w["audio_end"] > self.at + EPS:
            raise ValueError(f"word {w['text']!r} ends at {w['audio_end']}, after the stream position {self.at}")
        label = "A" if self.policy.solo else self.tracker.label(w["audio_start"], w["audio_end"])
        out = []
        if self.turn == 0 or (label and self.speaker and label != self.speaker):
            self.turn += 1
            self.speaker, self.turn_unnamed = label, label is None
            out.append(self._event("turn_start", turn=self.turn, speaker=label, audio_start=w["audio_start"]))
        elif label and self.turn_unnamed:
            self.speaker, self.turn_unnamed = label, False
            out.append(self._event("speaker", turn=self.turn, speaker=label))
        fields = {k: w[k] for k in ("text", "audio_start", "audio_end", "confidence")}
        out.append(self._event("commit", **fields, emitted_at=self.at, delay=self.at - w["audio_end"], speaker=label, turn=self.turn))
        self.utterance.append((self.seq - 1, w["text"]))
        if label is None:
            self.open_words.append((self.seq - 1, w["audio_start"], w["audio_end"]))
        return out

    def _fills(self) -> list[dict]:
        """Labels that have become known; they name words only, never a turn."""
        out, still = [], []
        for seq, start, end in self.open_words:
            label = self.tracker.label(start, end)
            if label is None:
                still.append((seq, start, end))
            else:
                out.append(self._event("speaker", target_seq=seq, speaker=label, audio_start=start, audio_end=end, turn=self.turn))
        self.open_words = still
        return out

    def _polish(self) -> list[dict]:
        """The utterance as the chain renders it, if that differs."""
        said, self.utterance = self.utterance, []
        if self.chain is None or not said:
            return []
        before = " ".join(text for _, text in said)
        after, _ = self.chain.run(before, self.context)
        self.context = after
        return [] if after == before else [self._event("polished", text=after, from_seq=said[0][0], to_seq=said[-1][0], turn=self.turn)]

    def _end(self, reason: str, score: float) -> list[dict]:
        out = [self._event("endpoint", reason=reason, completeness=score, turn=self.turn)]
        out += [] if self.policy.solo else self._fills()
        self.open_words = []  # what has no label now keeps none
        return out + self._polish()

    @staticmethod
    def _scored(row: dict, out: list[dict]) -> float:
        """A row's score can be a function of the words that its push has made final."""
        return row["score"]([e["text"] for e in out if e["kind"] == "commit"]) if callable(row["score"]) else row["score"]

    def _score(self, row: dict, out: list[dict]) -> float:
        """The row's score where it can decide; taken at most every turn_interval. Without a scorer nothing objects."""
        if row["score"] is None:
            return 1.0
        if not self.endpoint.wants_score or self.endpoint.held(self.at) < self.policy.endpoint.silence:
            return 0.0
        if self.at - self.scored_at >= self.policy.turn_interval:
            self.scored_at, self.score = self.at, self._scored(row, out)
        return self.score

    def push(self, row: dict) -> list[dict]:
        if row["at"] < self.at - EPS:
            raise ValueError(f"the clock goes back from {self.at} to {row['at']}")
        self.at = max(self.at, row["at"])
        out: list[dict] = []
        late = (row["lag"] or 0.0) > self.policy.max_lag
        if late != self.degraded:
            self.degraded = late
            out.append(self._event("degraded", degraded=late, lag=row["lag"]))
        speaking = bool(row["speaking"])
        if speaking and not self.onset:
            self.onset = True
            out.append(self._event("speech_onset"))
        if not self.policy.solo:
            for seg in row["segments"] or []:
                self.tracker.observe(seg)
        if row["words"] is not None or row["tentative"] is not None:  # else the recogniser has nothing to say
            stable, tentative = list(row["words"] or []), list(row["tentative"] or [])
            self.heard = {"stable": stable, "tentative": tentative}
            for w in self.commits.take(stable, tentative, self.at, bool(row.get("fragment"))):
                out += self._word(w)
            shown = [w for w in tentative if w["audio_start"] >= self.commits.frontier]
            if shown and not self.degraded:
                out.append(self._event("partial", text=" ".join(w["text"] for w in shown), audio_start=shown[0]["audio_start"], audio_end=shown[-1]["audio_end"]))
        if row["segments"] and not self.policy.solo:
            out += self._fills()  # labels change with the segments only
        if self.heard and self.endpoint.held(self.at) >= self.policy.endpoint.silence:
            for w in self.commits.settle(**self.heard):
                out += self._word(w)
        score = self._score(row, out)
        reason = self.endpoint.observe(speaking, self.at, score)
        if reason:
            out += self._end(reason, score)
        if row["last"]:
            for w in self.commits.flush(**self.heard) if self.heard else []:
                out += self._word(w)
            out += [] if self.policy.solo else self._fills()
            reason = self.endpoint.flush()
            out += self._end(reason, 1.0 if row["score"] is None else self._scored(row, out)) if reason else self._polish()
        return out
