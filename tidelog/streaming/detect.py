"""Parts of a session that need no model: speech by energy over an adaptive floor, voices by their spectrum."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.signal import log_mel, samples
from .state import Frames, Windower


@dataclass
class EnergySpeech:
    """Speech where a frame's mean square is well above a floor that follows the noise. Decisions fall on whole frames of
    512 samples, so they don't depend on how the audio is cut into chunks.

    The floor sinks to a quieter frame at once and rises slowly, slower still in speech. It takes more energy to begin
    speech than to go on with it, `start` frames in a row to begin and `hang` to end.
    """

    begin: float = 4.0
    keep: float = 2.0
    start: int = 2
    hang: int = 8
    rise: float = 1.01
    rise_in_speech: float = 1.001
    least: float = 1.0
    frames: Frames = field(default_factory=Frames)
    floor: float | None = None
    speaking: bool = False
    against: int = 0

    def decide(self, pcm: bytes) -> list[bool]:
        """The decision behind each frame that is whole with these samples."""
        return [self._frame(float(np.square(np.frombuffer(f, "<i2").astype(np.int64)).sum()) / self.frames.size) for f in self.frames.push(pcm)]

    def _frame(self, energy: float) -> bool:
        floor = energy if self.floor is None else min(energy, self.floor * (self.rise_in_speech if self.speaking else self.rise))
        self.floor = max(floor, self.least)
        loud = energy >= (self.keep if self.speaking else self.begin) * self.floor
        self.against = self.against + 1 if loud != self.speaking else 0
        if self.against >= (self.hang if self.speaking else self.start):
            self.speaking, self.against = loud, 0
        return self.speaking

    def push(self, pcm: bytes, at: float) -> bool:
        self.decide(pcm)
        return self.speaking

    def reset(self) -> None:
        self.frames.rest, self.floor, self.speaking, self.against = b"", None, False, 0


@dataclass
class SpectralVoices:
    """Segments of speech regions, with the mean spectrum of each as its embedding."""

    speech: EnergySpeech = field(default_factory=EnergySpeech)
    windows: Windower = field(default_factory=Windower)
    audio: bytes = b""
    begin: int = 0  # of audio, in samples

    def push(self, pcm: bytes, at: float) -> list[dict]:
        end = round(at * self.windows.rate)
        if self.windows.start is None:
            self.audio, self.begin = b"", end - len(pcm) // 2
        self.audio += pcm
        found = self.windows.observe(self.speech.push(pcm, at), len(pcm) // 2, end)
        return self._segments(found)

    def flush(self) -> list[dict]:
        return self._segments(self.windows.close())

    def _segments(self, found: list[tuple[int, int]]) -> list[dict]:
        out = [{"start": a / self.windows.rate, "end": b / self.windows.rate, "embedding": self._embedding(a, b), "overlap": False} for a, b in found]
        if found:  # what a window has had is not asked for again
            self.audio, self.begin = self.audio[2 * (found[-1][1] - self.begin) :], found[-1][1]
        return out

    def _embedding(self, a: int, b: int) -> list[float]:
        mean = log_mel(samples(self.audio[2 * (a - self.begin) : 2 * (b - self.begin)])).mean(1)
        return [float(x) for x in mean - mean.mean()]

    def reset(self) -> None:
        self.speech.reset()
        self.windows.close()
        self.audio, self.begin = b"", 0
