"""Row types of the log and its inputs."""

from __future__ import annotations

WORD = "text string, audio_start double, audio_end double, confidence double"
SEGMENT = "start double, end double, embedding array<double>, overlap boolean"
PAYLOAD = (
    "text string, audio_start double, audio_end double, emitted_at double, delay double, speaker string, confidence double, turn int, "
    "target_seq bigint, reason string, completeness double, degraded boolean, lag double, from_seq bigint, to_seq bigint"
)
EVENT = f"session_id bigint, seq bigint, kind string, at double, {PAYLOAD}"
KINDS = ("speech_onset", "turn_start", "partial", "commit", "speaker", "endpoint", "degraded", "polished")
#: Never revised once written.
FINAL_KINDS = ("commit", "endpoint", "turn_start")
#: One input row of the coordinator.
CHUNK = (
    "session_id bigint, chunk_no bigint, at double, speaking boolean, lag double, score double, "
    "words array<struct<text:string,audio_start:double,audio_end:double,confidence:double>>, "
    "tentative array<struct<text:string,audio_start:double,audio_end:double,confidence:double>>, "
    "segments array<struct<start:double,end:double,embedding:array<double>,overlap:boolean>>, last boolean, fragment boolean"
)
#: One frame of a connection: audio, with what a recogniser beside it says, or the end (kind finish); other kinds are ignored.
FRAME = (
    "session_id bigint, chunk_no bigint, kind string, pcm binary, lag double, "
    "words array<struct<text:string,audio_start:double,audio_end:double,confidence:double>>, "
    "tentative array<struct<text:string,audio_start:double,audio_end:double,confidence:double>>, fragment boolean"
)
#: New pieces of words that a recogniser has appended since the row before.
PIECES = "session_id bigint, chunk_no bigint, at double, pieces array<struct<piece:string,start:double,logp:double>>, speaking boolean, lag double, score double, last boolean"
SAMPLE_RATE = 16_000
TOLERANCE = 1e-6
