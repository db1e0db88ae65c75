"""A data source of WAV recordings: long files are read by byte ranges, in batch and as a stream, and written from rows.

    spark.dataSource.register(Recordings)
    spark.read.format("tidelog_recordings").option("seconds", "0.1").load(folder)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import SAMPLE_RATE

CHUNKS = "path string, session string, chunk_no bigint, begin bigint, pcm binary, problems array<string>"
_ARROW = pa.schema([("path", pa.string()), ("session", pa.string()), ("chunk_no", pa.int64()), ("begin", pa.int64()), ("pcm", pa.binary()), ("problems", pa.list_(pa.string()))])
#: Bytes of a file that one task reads, of a header that is looked through, and of a read or copy at a time.
SPLIT_BYTES, HEADER_BYTES, BLOCK = 64 << 20, 1 << 16, 1 << 20
#: What opening a file counts for where splits are dealt to tasks, tasks of a read at least, rows of a batch, and files moved at once.
OPEN_BYTES, LEAST_TASKS, BATCH_ROWS, MOVES = 1 << 16, 32, 10_000, 16


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def data_range(head: bytes, size: int) -> tuple[int, int, list[str]]:
    """Where the samples of a WAV file begin and end, and why they can't be used, from the file's first bytes."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0, 0, ["not a WAV file"]
    at, problems, known = 12, [], False
    while at + 8 <= len(head):
        name, length = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(head):
            known = True
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            want = {"format": (kind, 1), "channels": (channels, 1), "sample rate": (rate, SAMPLE_RATE), "bits": (bits, 16)}
            problems = [f"{k} is {have}, not {need}" for k, (have, need) in want.items() if have != need]
        elif name == b"data":
            problems = problems if known else ["no format before the samples"]
            return at + 8, min(at + 8 + length, size), problems
        at += 8 + length + length % 2
    return 0, 0, ["no samples"]


def header(n_bytes: int) -> bytes:
    fmt = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, 2 * SAMPLE_RATE, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + n_bytes) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", n_bytes)


@dataclass
class Split(InputPartition):
    """Bytes first to last of a file."""

    path: str
    size: int
    first: int
    last: int


@dataclass
class Pack(InputPartition):
    """Splits that one task reads, one behind another: short files and splits don't cost a task each."""

    splits: list[Split]


@dataclass
class Chunked:
    """What both readers do: list files, cut them into splits, read the chunks that begin in a split."""

    root: str
    chunk_bytes: int
    split_bytes: int

    def listed(self) -> list[tuple[int, str, int]]:
        fs, base = file_system(self.root)
        found = fs.get_file_info(arrow_fs.FileSelector(base, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.endswith(".wav") and "/_" not in f.path.removeprefix(base))

    def splits(self, files: list[tuple[int, str, int]]) -> list[Split]:
        return [Split(path, size, a, min(size, a + self.split_bytes)) for _, path, size in files for a in range(0, max(size, 1), self.split_bytes)]

    def packs(self, splits: list[Split]) -> list[Pack]:
        costs = [s.last - s.first + OPEN_BYTES for s in splits]
        most, packs, held = min(SPLIT_BYTES, sum(costs) // LEAST_TASKS), [], 0
        for s, cost in zip(splits, costs, strict=True):
            if not packs or held + cost > most:
                packs.append(Pack([]))
                held = 0
            packs[-1].splits.append(s)
            held += cost
        return packs

    def batches(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for row in chain.from_iterable(map(self.chunks, pack.splits)):
            rows.append(row)
            n += len(row[4] or b"")
            if n >= BLOCK or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, n = [], 0
        if rows:
            yield _batch(rows)

    def chunks(self, split: Split) -> Iterator[tuple]:
        fs, _ = file_system(self.root)
        session = split.path.rsplit("/", 1)[-1].removesuffix(".wav")
        with fs.open_input_file(split.path) as f:
            start, end, problems = data_range(f.read_at(min(HEADER_BYTES, split.size), 0), split.size)
            if problems:  # once for the file
                if split.first == 0:
                    yield split.path, session, None, None, None, problems
                return
            k = max(0, -(-(split.first - start) // self.chunk_bytes))
            at = start + k * self.chunk_bytes
            stop = min(end, split.last)
            while at < stop:
                n = min(max(1, BLOCK // self.chunk_bytes), -(-(stop - at) // self.chunk_bytes))
                block = f.read_at(min(n * self.chunk_bytes, end - at), at)
                for i in range(0, n * self.chunk_bytes, self.chunk_bytes):
                    yield split.path, session, k, k * self.chunk_bytes // 2, block[i : i + self.chunk_bytes], []
                    k, at = k + 1, at + self.chunk_bytes


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class BatchReader(DataSourceReader):
    def __init__(self, source: Chunked) -> None:
        self.source = source

    def partitions(self) -> list[Pack]:
        return self.source.packs(self.source.splits(self.source.listed())) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.source.batches(partition)


class StreamReader(DataSourceStreamReader):
    """Files in the order in which they came; an offset is the last one. A file must be whole when it appears."""

    def __init__(self, source: Chunked) -> None:
        self.source = source

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.source.listed()
        return {"mtime": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        place = lambda o: (o["mtime"], o["path"])
        return self.source.packs(self.source.splits([f for f in self.source.listed() if place(start) < f[:2] <= place(end)]))

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.source.batches(partition)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class RecordingWriter(DataSourceArrowWriter):
    """One file for each session, of rows (session, chunk_no, pcm) that lie together and in order. A header says how many
    samples there are, so those of a short session wait in memory, and those of a longer one go to a file beside it first;
    files move to their place when the whole write is done."""

    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.root)
        own = f"{base}/_attempt-{uuid.uuid4().hex}"
        fs.create_dir(own)
        now = out = None
        held, n = bytearray(), 0

        def done() -> None:
            with fs.open_output_stream(f"{own}/{now}.wav", compression=None) as wav:
                wav.write(header(n))
                if out is not None:
                    out.close()
                    with fs.open_input_file(f"{own}/{now}.pcm") as samples:
                        while block := samples.read(BLOCK):
                            wav.write(block)
                wav.write(bytes(held))
            if out is not None:
                fs.delete_file(f"{own}/{now}.pcm")

        for batch in iterator:
            for session, pcm in zip(batch.column("session").to_pylist(), batch.column("pcm").to_pylist(), strict=True):
                if str(session) != now:
                    if now is not None:
                        done()
                    now, out, held, n = str(session), None, bytearray(), 0
                held += pcm or b""
                n += len(pcm or b"")
                if len(held) >= BLOCK:
                    out = out or fs.open_output_stream(f"{own}/{now}.pcm", compression=None)
                    out.write(bytes(held))
                    held = bytearray()
        if now is not None:
            done()
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.root)

        def settle(folder: str) -> None:
            for f in fs.get_file_info(arrow_fs.FileSelector(folder)):
                fs.move(f.path, f"{base}/{f.base_name}")
            fs.delete_dir(folder)

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(settle, [w.folder for w in messages if w]))

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.root)
        for w in messages:
            if w:
                fs.delete_dir(w.folder)


class Recordings(DataSource):
    """Options: path, seconds of a chunk (0.02), split_bytes. Rows of a file that is no 16 kHz mono 16-bit WAV: one, with
    its problems. The folder is reached by pyarrow: a local or shared path, or a store that it knows."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_recordings"

    def schema(self) -> str:
        return CHUNKS

    def _chunked(self) -> Chunked:
        size = int(float(self.options.get("seconds", "0.02")) * SAMPLE_RATE) * 2
        if size <= 0:
            raise ValueError("a chunk must hold a sample")
        return Chunked(self.options["path"], size, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self._chunked())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self._chunked())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordingWriter(self.options["path"], overwrite)


def write_recordings(chunks, path: str, parts: int | None = None, pcm=None) -> None:
    """A WAV file for each session of rows (session, chunk_no, pcm). parts: how many tasks write; else as Spark finds fit by
    the compressed size, which for audio can be far too few. pcm: an expression of other columns that makes the audio; it
    is made behind the shuffle and the sort, which then carry those columns only."""
    chunks.sparkSession.dataSource.register(Recordings)
    rows = chunks.select("session", "chunk_no", "pcm") if pcm is None else chunks
    dealt = rows.repartition("session") if parts is None else rows.repartition(parts, "session")
    in_order = dealt.sortWithinPartitions("session", "chunk_no")
    (in_order if pcm is None else in_order.select("session", "chunk_no", pcm.alias("pcm"))).write.format("tidelog_recordings").mode("append").save(path)


def read_recordings(spark, path: str, seconds: float = 0.02, split_bytes: int = SPLIT_BYTES, stream: bool = False):
    """path, session, chunk_no, begin (sample), pcm, problems of every *.wav below path."""
    spark.dataSource.register(Recordings)
    reader = spark.readStream if stream else spark.read
    return reader.format("tidelog_recordings").option("seconds", repr(seconds)).option("split_bytes", str(split_bytes)).load(path)


def sounding(chunks, samples: int = 160):
    """session, begin and samples of each run of blocks, of so many samples, of chunks (session, begin, pcm) that are not
    silent all through. A run ends with its chunk, so that rows are few and none is gathered; a chunk must begin with a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sessions, begins, lengths = [], [], []
            for session, begin, pcm in zip(*(batch.column(c).to_pylist() for c in ("session", "begin", "pcm")), strict=True):
                if not pcm:
                    continue
                blocks = np.maximum.reduceat(np.frombuffer(pcm, np.uint8), np.arange(0, len(pcm), 2 * samples)) > 0
                edges = np.flatnonzero(np.diff(blocks, prepend=False, append=False)) * samples
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    sessions.append(session)
                    begins.append(begin + a)
                    lengths.append(min(b, len(pcm) // 2) - a)
            yield pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64())], names=["session", "begin", "samples"])

    return chunks.select("session", "begin", "pcm").mapInArrow(run, "session string, begin bigint, samples bigint")


__all__ = ["CHUNKS", "Recordings", "data_range", "header", "read_recordings", "sounding", "write_recordings"]
