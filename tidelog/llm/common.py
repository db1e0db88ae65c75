"""Shared helpers: shared-folder tables, Arrow batch maps, stable text keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths of tables saved by :func:`save` that :func:`release` may delete.
_SAVED: list[str] = []
#: Catalog names of those saved by :func:`save_by`, by path.
_NAMED: dict[str, str] = {}
#: Most bytes of an Arrow batch that goes to a Python worker, unless the session names its own limit.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session gets a temporary one;
    on a cluster that would be a machine's own folder, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidelog-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost executor
    costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`save`, in buckets by key, one for each shuffle partition: a join on key reads such a table in place
    and shuffles only its other side, however often it is joined."""
    spark = df.sparkSession
    unique = f"tidelog-{name}-{uuid.uuid4().hex}"
    path, named = f"{shared_dir(spark)}/{unique}", unique.replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(named)
    _SAVED.append(path)
    _NAMED[path] = named
    return spark.table(named)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that :func:`save` has written in this process, all or those named. Only for tables that no
    DataFrame still in use reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in list(_SAVED) if paths is None else paths:
        if p in _SAVED:
            _SAVED.remove(p)
            if p in _NAMED:
                spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(p)}")
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def done_with(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and clean: Spark drops the shuffle files of finished steps
    only when the driver collects its garbage."""
    spark = tables[0].sparkSession
    names = {f.split("/tidelog-", 1)[1].split("/")[0] for df in tables for f in df.inputFiles() if "/tidelog-" in f}
    release(spark, [p for p in _SAVED if p.rsplit("/tidelog-", 1)[1] in names])
    clean(spark)


def clean(spark: SparkSession) -> None:
    """Have the shuffle files of steps whose result is saved cleaned now."""
    gc.collect()
    spark._jvm.System.gc()


def saved_paths() -> list[str]:
    return list(_SAVED)


def _give_back() -> None:
    """Hand freed memory back to the system: Spark uses a Python worker again."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | T.StructType, rows: int = 10_000) -> DataFrame:
    """mapInArrow with dicts of Python lists or arrays in place of record batches, of at most so many rows each.
    Batches are limited by bytes, since texts can be very long."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target, spark = to_arrow_schema(struct), df.sparkSession
    if int(spark.conf.get(_BYTES).rstrip("b")) >= 64 << 20:  # Spark's default
        spark.conf.set(_BYTES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        dicts = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in parts)
        for out in fn(dicts):
            cols = [pa.array(out[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays(cols, schema=target)
        _give_back()

    return df.mapInArrow(run, struct)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names renamed, and what gives a DataFrame that has them their names back."""
    clash = {c: f"_own {c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(clash), lambda out: out.withColumnsRenamed({v: k for k, v in clash.items()})


def chunks(batch: dict, rows: int) -> Iterator[dict]:
    """A batch in pieces of at most so many rows."""
    n = len(next(iter(batch.values()))) if batch else 0
    for at in range(0, n, rows):
        yield {k: v[at : at + rows] for k, v in batch.items()}


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def text_binary(column: str = "text"):
    return F.col(column).cast("binary").alias(column)
