"""Tunables of the log operators, as dataclasses and as a small table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpeakerPolicy:
    threshold: float = 0.40
    margin: float = 0.10
    min_duration: float = 1.5
    max_gap: float = 2.0
    memory: float = 120.0
    history: int = 24
    max_speakers: int = 32


@dataclass(frozen=True)
class CommitPolicy:
    gate: float = 0.0  # off
    slow: float = 0.35
    early: float = 1.01  # off


@dataclass(frozen=True)
class EndpointPolicy:
    silence: float = 0.6
    threshold: float = 0.60
    timeout: float = 1.4


@dataclass(frozen=True)
class Policy:
    name: str = "conversation"
    solo: bool = False
    endpoint: EndpointPolicy = EndpointPolicy()
    speaker: SpeakerPolicy = SpeakerPolicy()
    commit: CommitPolicy = CommitPolicy()
    turn_interval: float = 0.2
    turn_context: float = 8.0
    max_lag: float = 1.5
    extra: dict = field(default_factory=dict)


#: The presets.
PRESETS = {
    "conversation": Policy(),
    "dictation": Policy("dictation", True, EndpointPolicy(1.0, 0.70, 4.0)),
    "agent": Policy("agent", True, EndpointPolicy(0.25, 0.55, 1.2)),
}


def policy(name: str) -> Policy:
    try:
        return PRESETS[name]
    except KeyError:
        raise KeyError(f"no policy {name!r}; there are {', '.join(sorted(PRESETS))}") from None


def policies(spark: SparkSession, scale: float = 1.0) -> DataFrame:
    """name, solo, silence_s, threshold, timeout_s; times are multiplied by scale."""
    rows = [(p.name, p.solo, p.endpoint.silence * scale, p.endpoint.threshold, p.endpoint.timeout * scale) for p in PRESETS.values()]
    return spark.createDataFrame(rows, "policy string, solo boolean, silence_s double, threshold double, timeout_s double")


def known_policy(name: Column) -> Column:
    """The name, or an error that lists the names."""
    return F.when(name.isin(*PRESETS), name).otherwise(F.raise_error(F.concat(F.lit("no such policy: "), name)))
