"""Ordered, append-only logs of conversations on Spark."""

from .functions.polish import NUMBERS, Chain, Stage, punctuation
from .operators.log import display_text, joined_text
from .operators.protocol import VERSION as PROTOCOL_VERSION
from .operators.protocol import decode, encode, hello, render
from .plans.runner import run_batch, run_stream
from .policy import PRESETS, CommitPolicy, EndpointPolicy, Policy, SpeakerPolicy, policy
from .schema import CHUNK, EVENT, FINAL_KINDS, KINDS
from .streaming.models import Backends, Session, build
from .streaming.state import Coordinator

__version__ = "0.2.0"
__all__ = [
    "CHUNK", "EVENT", "FINAL_KINDS", "KINDS", "NUMBERS", "PRESETS", "PROTOCOL_VERSION", "Backends", "Chain", "CommitPolicy", "Coordinator", "EndpointPolicy", "Policy", "Session", "SpeakerPolicy",
    "Stage", "__version__", "build", "decode", "display_text", "encode", "hello", "joined_text", "policy", "punctuation", "render", "run_batch", "run_stream",
]
