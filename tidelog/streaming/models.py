"""What a session is built of: recogniser, voice front end, speech detector, turn detector. Scripted ones replay rows;
ones with weights live outside this library and come in as makers."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from ..functions.polish import NUMBERS, Chain, Stage
from ..policy import Policy
from ..schema import SAMPLE_RATE
from .state import Coordinator


class Recogniser(Protocol):
    def push(self, pcm: bytes, at: float) -> dict | None: ...

    def flush(self) -> dict | None: ...

    def reset(self) -> None: ...


class VoiceFrontend(Protocol):
    def push(self, pcm: bytes, at: float) -> list[dict]: ...

    def flush(self) -> list[dict]: ...

    def reset(self) -> None: ...


class SpeechDetector(Protocol):
    def push(self, pcm: bytes, at: float) -> bool: ...

    def reset(self) -> None: ...


class TurnDetector(Protocol):
    def completeness(self, text: str, pcm: bytes) -> float: ...


@dataclass
class Replay:
    """Rows that fall due by time: (due, row), in order. What a part of a session gives out is a view of it."""

    rows: list[tuple[float, Any]]
    next: int = 0

    def until(self, at: float = math.inf) -> list[Any]:
        first = self.next
        while self.next < len(self.rows) and self.rows[self.next][0] <= at + 1e-9:
            self.next += 1
        return [row for _, row in self.rows[first : self.next]]

    def reset(self) -> None:
        self.next = 0


class ScriptedWords(Replay):
    """Hypotheses (stable, tentative); of several due at once the last counts."""

    def push(self, pcm: bytes, at: float) -> dict | None:
        return next(reversed(self.until(at)), None)

    def flush(self) -> dict | None:
        return self.push(b"", math.inf)


class ScriptedVoices(Replay):
    """Segments are given out when they have ended."""

    def __init__(self, segments: list[dict]) -> None:
        super().__init__([(s["end"], s) for s in segments])

    def push(self, pcm: bytes, at: float) -> list[dict]:
        return self.until(at)

    def flush(self) -> list[dict]:
        return self.until()


class ScriptedSpeech(Replay):
    """Speech in half-open spans: their edges fall due."""

    def __init__(self, spans: list[tuple[float, float]]) -> None:
        super().__init__(sorted((t, up) for a, b in spans if a < b for t, up in ((a, 1), (b, -1))))
        self.open = 0

    def push(self, pcm: bytes, at: float) -> bool:
        self.open += sum(self.until(at))
        return self.open > 0

    def reset(self) -> None:
        super().reset()
        self.open = 0


class TextTurns:
    """Complete behind a sentence mark; needs no model, but a recogniser that punctuates."""

    def completeness(self, text: str, pcm: bytes) -> float:
        bare = text.rstrip().rstrip("\"')]")
        return 0.5 if not bare else float(bare[-1] in ".?!")


@dataclass
class SilenceTurns:
    """Complete by the share of quiet samples in the last second; a stand-in for a model of turns by audio."""

    level: int = 500
    seconds: float = 1.0
    least: float = 0.5

    def completeness(self, text: str, pcm: bytes) -> float:
        x = np.frombuffer(pcm, "<i2")
        if len(x) < self.least * SAMPLE_RATE:
            return 0.5
        x = x[-int(self.seconds * SAMPLE_RATE) :].astype(np.int32)
        return 1 / (1 + math.exp(-(6 * float((np.abs(x) < self.level).mean()) - 3)))


@dataclass
class ScriptedTurns:
    """A fixed score, scores by text, or complete behind a sentence mark."""

    fixed: float | None = None
    by_text: dict[str, float] = field(default_factory=dict)

    def completeness(self, text: str, pcm: bytes) -> float:
        return self.fixed if self.fixed is not None else self.by_text.get(text, float(text.strip().endswith((".", "?", "!"))))


#: Models without a state of their own, per process; the least recently used goes.
_MODELS: OrderedDict[tuple, Any] = OrderedDict()
MOST_MODELS = 4


def shared_model(key: tuple, make: Callable[[], Any]) -> Any:
    """The model of this key, made once per Python worker. Only for models that keep no state between calls."""
    if key not in _MODELS:
        _MODELS[key] = make()
        while len(_MODELS) > MOST_MODELS:
            _MODELS.popitem(last=False)
    _MODELS.move_to_end(key)
    return _MODELS[key]


@dataclass(frozen=True)
class Backends:
    """Makers of the parts, and whether the recogniser punctuates. Without a recogniser its words come with the audio."""

    recogniser: Callable[[], Recogniser] | None
    speech: Callable[[], SpeechDetector] | None = None
    voices: Callable[[], VoiceFrontend] | None = None
    audio_turns: Callable[[], TurnDetector] | None = None
    restore: Callable[[str], str] | None = None
    punctuates: bool = False


@dataclass
class Session:
    """One stream: PCM in, events out. Time is counted in samples, so chunk sizes don't matter."""

    policy: Policy
    recogniser: Recogniser | None
    speech: SpeechDetector | None
    voices: VoiceFrontend | None
    turns: TurnDetector | None
    coordinator: Coordinator
    rate: int = 16_000
    samples: int = 0
    recent: bytes = b""
    text: list[str] = field(default_factory=list)

    def _step(self, words: dict | None, segments: list[dict], speaking: bool | None, lag: float, last: bool) -> list[dict]:
        at = self.samples / self.rate
        row = {
            "at": at, "lag": lag, "speaking": bool(speaking), "segments": segments, "last": last, "words": words and words.get("stable", []), "tentative": words and words.get("tentative", []), "fragment": bool(words and words.get("fragment")),
            "score": self.turns and (lambda new: self.turns.completeness(" ".join(self.text + new), self.recent)),  # asked only where it can decide
        }
        events = self.coordinator.push(row)
        self.text += [e["text"] for e in events if e["kind"] == "commit"]
        return events

    def push(self, pcm: bytes, lag: float = 0.0, said: dict | None = None) -> list[dict]:
        """said: what a recogniser beside the session makes of the audio, where the session has none of its own."""
        if len(pcm) % 2:
            raise ValueError("half a sample")
        self.samples += len(pcm) // 2
        at = self.samples / self.rate
        if self.turns is not None:
            self.recent = (self.recent + pcm)[-int(self.policy.turn_context * self.rate) * 2 :]
        speaking = None if self.speech is None else self.speech.push(pcm, at)
        segments = [] if self.voices is None else self.voices.push(pcm, at)
        return self._step(said if self.recogniser is None else self.recogniser.push(pcm, at), segments, speaking, lag, False)

    def remembered(self) -> tuple:
        """All but the coordinator."""
        return self.recogniser, self.speech, self.voices, self.turns, self.samples, self.recent, self.text

    def recall(self, parts: tuple) -> None:
        self.recogniser, self.speech, self.voices, self.turns, self.samples, self.recent, self.text = parts

    def finish(self) -> list[dict]:
        segments = [] if self.voices is None else self.voices.flush()
        return self._step(None if self.recogniser is None else self.recogniser.flush(), segments, False, 0.0, True)


def build(backends: Backends, policy: Policy) -> Session:
    """A punctuating recogniser gets the text detector and no punctuation stage; a solo policy gets no voices; numbers
    are always written in digits."""
    stages: list[Stage] = [NUMBERS]
    if backends.restore is not None and not backends.punctuates:
        from ..functions.polish import punctuation

        stages.append(punctuation(backends.restore))
    turns = TextTurns() if backends.punctuates else backends.audio_turns() if backends.audio_turns else None
    voices = None if policy.solo or backends.voices is None else backends.voices()
    coordinator = Coordinator(policy, chain=Chain(tuple(stages)))
    return Session(policy, backends.recogniser() if backends.recogniser else None, backends.speech() if backends.speech else None, voices, turns, coordinator)


def demo(policy: Policy, seconds: float = 6.0, chunk: float = 0.02) -> list[dict]:
    """Two voices in turn, scripted, through the real session."""
    say = lambda text, start: [{"text": w, "audio_start": start + 0.4 * k, "audio_end": start + 0.4 * (k + 1), "confidence": 0.9} for k, w in enumerate(text.split())]
    first, second = say("we can meet at noon.", 0.2), say("that suits me well.", 3.2)
    script = [(1.0, {"stable": first[:1], "tentative": first[1:2]}), (2.3, {"stable": first[:4], "tentative": first[4:]}), (4.9, {"stable": first + second[:3], "tentative": second[3:]})]
    voices = [{"start": 0.2, "end": 2.2, "embedding": [1.0, 0.0], "overlap": False}, {"start": 3.2, "end": 4.8, "embedding": [0.0, 1.0], "overlap": False}]
    parts = Backends(lambda: ScriptedWords(script), lambda: ScriptedSpeech([(0.2, 2.2), (3.2, 4.8)]), lambda: ScriptedVoices(voices), punctuates=True)
    session, events = build(parts, policy), []
    for _ in range(round(seconds / chunk)):
        events += session.push(b"\0\0" * int(chunk * session.rate))
    return events + session.finish()
