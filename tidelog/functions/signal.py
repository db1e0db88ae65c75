"""Audio samples and features: columns where they do, numpy for spectra."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SAMPLE_RATE

#: Fixed values of the features: transform size, step, bands, seconds and frames of a window.
FFT, STEP, BANDS, SECONDS, FRAMES = 400, 160, 80, 8, 800
#: Seconds that a token is taken to last; least audio that is worth a score, and the score without it.
TOKEN_TAIL, LEAST_AUDIO, UNDECIDED = 0.08, 0.5, 0.5


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def turn_score(logit: Column, seconds: Column) -> Column:
    """The probability that a turn is complete; undecided on too little audio."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) < LEAST_AUDIO, UNDECIDED).otherwise(sigmoid(logit))


def word_end(last_start: Column, start: Column, cap: Column) -> Column:
    """The end of a word whose last piece starts at last_start: a tail behind it, within the audio heard."""
    return F.least(F.greatest(last_start + TOKEN_TAIL, start), F.greatest(cap, start))


def standardised(value: Column, *by: str) -> Column:
    """Zero mean and unit variance within a group."""
    w = Window.partitionBy(*by)
    return (value - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + 1e-7)


def samples(pcm: bytes | None) -> np.ndarray:
    """16-bit little-endian PCM as floats from -1 to 1."""
    return np.frombuffer(pcm or b"", "<i2").astype(np.float32) / 32768


def mel_filters() -> np.ndarray:
    """Triangles of equal area on a scale that is linear up to 1,000 Hz and logarithmic above, BANDS x (FFT / 2 + 1)."""
    return _filters().copy()


@lru_cache(maxsize=1)
def _filters() -> np.ndarray:
    linear, knee, ratio = 200 / 3, 1000.0, np.log(6.4) / 27
    top = knee / linear + np.log(SAMPLE_RATE / 2 / knee) / ratio
    mel = np.linspace(0, top, BANDS + 2)
    hz = np.where(mel < knee / linear, mel * linear, knee * np.exp(ratio * (mel - knee / linear)))
    bins = np.linspace(0, SAMPLE_RATE / 2, FFT // 2 + 1)
    out = np.zeros((BANDS, len(bins)))
    for k in range(BANDS):
        low, mid, high = hz[k : k + 3]
        out[k] = np.interp(bins, [low, mid, high], [0, 1, 0], left=0, right=0) * 2 / (high - low)
    return out


def log_mel(audio: np.ndarray) -> np.ndarray:
    """Log-mel spectrum, BANDS x frames: mirrored edges, periodic Hann window, the last frame dropped, floor at 8
    decades below the peak, scaled to about -1 to 1."""
    wide = np.pad(np.asarray(audio, np.float32), FFT // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(wide, FFT)[::STEP][:-1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / FFT)
    power = np.abs(np.fft.rfft(frames * hann.astype(np.float32), axis=1)) ** 2
    level = np.log10(np.maximum(_filters() @ power.T, 1e-10))
    return ((np.maximum(level, level.max() - 8) + 4) / 4).astype(np.float32)


def window_features(audio: np.ndarray) -> np.ndarray:
    """BANDS x FRAMES of the last SECONDS: standardised first, then padded with silence behind."""
    audio = np.asarray(audio, np.float32)[-SECONDS * SAMPLE_RATE :]
    if len(audio):
        audio = (audio - audio.mean()) / np.sqrt(audio.var() + 1e-7)
    return log_mel(np.pad(audio, (0, SECONDS * SAMPLE_RATE - len(audio))))[:, :FRAMES]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def samples_udf(pcm: pd.Series) -> pd.Series:
    return pcm.map(samples)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def window_features_udf(pcm: pd.Series) -> pd.Series:
    return pcm.map(lambda b: list(window_features(samples(b))))


def last_seconds(pcm: Column, seconds: float = SECONDS) -> Column:
    """The end of a PCM value."""
    size = int(seconds * SAMPLE_RATE) * 2
    return F.when(F.octet_length(pcm) > size, F.substring(pcm, -size, size)).otherwise(pcm)
