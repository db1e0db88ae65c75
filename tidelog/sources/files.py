"""Audio, truth and transcript files."""

from __future__ import annotations

import io
import os
import re
import uuid
import wave
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def file_system(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def _rooted(path: str) -> str:
    return path if ":/" in path else os.path.abspath(path)


def _folder_name(value: str | None) -> str:
    """A value as Spark names its partition."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


_WAV = T.StructType([T.StructField("pcm", T.BinaryType()), T.StructField("problems", T.ArrayType(T.StringType()))])


def parse_wav(data: bytes) -> tuple[bytes | None, list[str]]:
    """PCM of a 16 kHz mono 16-bit file, or every reason why it is none."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            found = {"sample rate": (w.getframerate(), 16_000), "channels": (w.getnchannels(), 1), "sample bytes": (w.getsampwidth(), 2)}
            problems = [f"{k} is {have}, not {want}" for k, (have, want) in found.items() if have != want]
            return (None, problems) if problems else (w.readframes(w.getnframes()), [])
    except (wave.Error, EOFError) as e:
        return None, [f"not a WAV file: {e}"]


@F.pandas_udf(_WAV)
def wav_udf(data: pd.Series) -> pd.DataFrame:
    rows = [parse_wav(d) for d in data]
    return pd.DataFrame({"pcm": [r[0] for r in rows], "problems": [r[1] for r in rows]})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every *.wav below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path, pcm, problems, seconds of every *.wav below path."""
    return read_files(spark, path).select("path", wav_udf("content").alias("w")).select("path", "w.*").withColumn("seconds", F.octet_length("pcm") / 32_000.0)


def pcm_chunks(df: DataFrame, seconds: float = 0.02, sample_rate: int = 16_000) -> DataFrame:
    """A row per chunk of pcm: chunk_no, chunk; the short tail is kept."""
    size = int(seconds * sample_rate) * 2
    if size <= 0:
        raise ValueError("a chunk must hold a sample")
    n = F.ceil(F.octet_length("pcm") / size)
    at = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    return df.withColumn("chunk_no", F.explode(at)).withColumn("chunk", F.substring(F.col("pcm"), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)))


def read_truth_turns(spark: SparkSession, path: str) -> DataFrame:
    """path, turn_idx, speaker, start, end from JSON files with a list turns."""
    schema = "turns array<struct<speaker:string,start:double,end:double>>"
    fs, base = file_system(_rooted(path))
    info = fs.get_file_info(base)
    below = [info] if info.is_file else fs.get_file_info(FileSelector(base, recursive=True))
    hidden = lambda name: any(part[:1] in ("_", ".") for part in name.removeprefix(base).split("/"))
    names = sorted(f.path for f in below if f.is_file and not hidden(f.path))
    # a folder for each session: Spark would list each by a task of its own
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    root = _rooted(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = file_system(root)
        for batch in batches:
            text = [fs.open_input_file(n).readall().decode("utf-8", "replace") for n in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "text": text})

    raw = rows.mapInPandas(read, "path string, text string").select("path", F.from_json("text", schema)["turns"].alias("turns"))
    return raw.select("path", F.posexplode("turns").alias("turn_idx", "t")).select("path", "turn_idx", "t.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """key, text of every line of *.trans.txt below path; of equal keys the last line stays."""
    raw = spark.read.option("pathGlobFilter", "*.trans.txt").option("recursiveFileLookup", "true").text(path)
    line = F.split("value", " ", 2)
    rows = raw.where(F.size(line) == 2).select(line[0].alias("key"), line[1].alias("text"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"))
    return rows.groupBy("key").agg(F.max_by("text", "at").alias("text"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def list_audio(spark: SparkSession, path: str, suffix: str = "wav", limit: int | None = None) -> DataFrame:
    """path of the audio files below path in order, the first so many where a limit is asked for."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path")
    return names if limit is None else names.limit(limit)


def with_transcripts(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """audio (path, ...) with the text whose key is the file's stem; files without one are left out."""
    return audio.withColumn("key", stem(F.col("path"))).join(transcripts, "key")


def read_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """stem, incomplete, complete, cut_after, cut_at of the items of an index: pairs of cut and whole clips, as one array
    or a line each."""
    schema = "stem string, incomplete string, complete string, cut_after string, cut_at double"
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def problem_text(problems: Column) -> Column:
    """Reasons as one text, or null for none."""
    return F.when(F.size(problems) > 0, F.concat_ws("; ", problems))


def wav_bytes(pcm: bytes, sample_rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes(pcm)
    return out.getvalue()


def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: wav_bytes(b"".join(p)))


def recordings(chunks: DataFrame) -> DataFrame:
    """session_id and wav, one file each: the chunks (session_id, chunk_no, chunk) put together in order."""
    wav = F.pandas_udf(_joined, T.BinaryType())
    items = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return chunks.groupBy("session_id").agg(F.transform(items, lambda x: x["chunk"]).alias("parts")).select("session_id", wav("parts").alias("wav"))


def write_truth(turns: DataFrame, path: str) -> None:
    """A JSON file for each session with its speakers and turns, as :func:`read_truth_turns` reads them."""
    items = F.sort_array(F.collect_list(F.struct("turn_idx", "speaker", "start", "end")))
    files = turns.groupBy("session_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"), F.transform(items, lambda x: F.struct(x["speaker"].alias("speaker"), x["start"].alias("start"), x["end"].alias("end"))).alias("turns"))
    rows = files.select(F.col("session_id").cast("string").alias("name"), F.to_json(F.struct("speakers", "turns")).alias("text"))
    root = _rooted(path)
    fs, base = file_system(root)
    if fs.get_file_info(base).type != FileType.NotFound:
        fs.delete_dir(base)
    fs.create_dir(base)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(root)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                folder, part = f"{base}/session_id={_folder_name(name)}", f"_{uuid.uuid4().hex}"
                fs.create_dir(folder)
                with fs.open_output_stream(f"{folder}/{part}", compression=None) as out:
                    out.write(f"{text}\n".encode())
                fs.move(f"{folder}/{part}", f"{folder}/part-0.json")  # whole, however often a task starts
            yield pd.DataFrame({"n": [len(batch)]})

    # a file costs its own bytes: Spark's commit moves each on the driver, one behind another
    rows.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
