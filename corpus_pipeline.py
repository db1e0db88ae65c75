"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the pipeline writes it as Parquet and rereads it
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import aside, clean, crc_mod, release, save, saved_paths, shared_dir, table
from tidelog.llm.decontamination import contaminated
from tidelog.llm.jaccard_join import link_components
from tidelog.llm.language_id import fit, identify
from tidelog.llm.line_dedup import dedup_lines
from tidelog.llm.mixing import mix


#: Tables that the stage before has saved, by session and input folder; the next stage of that run deletes them.
_BEFORE: dict[tuple[int, str], list[str]] = {}


def stage(function: Callable) -> Callable:
    """A stage deletes the tables that the stage before it in the same run saved, once its own docs no longer read them,
    and names its own for the next one."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old = _BEFORE.pop(run_of := (id(spark), sf_dir), [])
        names = [p.rsplit("/", 1)[1] for p in old]
        still = any(name in f for f in docs.inputFiles() for name in names) if names else False
        if not still:
            release(spark, old)
            clean(spark)
        before = set(saved_paths())
        try:
            return function(spark, docs, sf_dir)
        finally:
            _BEFORE[run_of] = [p for p in saved_paths() if p not in before] + (old if still else [])

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of 0.5 or more. Rejected: null texts, texts without
    a letter, texts that no language explains better than the rest. Columns that clash with the operator's stay."""
    model = fit(docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))))
    plain, back = aside(docs, "lang_pred", "score")
    found = identify(plain, model, keep_columns=True)
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*plain.columns))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars follows the text. A document that
    loses all its lines stays with an empty text, a null text becomes empty. Columns that clash with the operator's stay."""
    plain, back = aside(docs, "n_lines", "n_dropped", "kept")
    kept = dedup_lines(plain, 10, keep_columns=True)
    return back(kept.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}).select(*plain.columns))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of documents linked by five-word shingles at a
    similarity of 0.8 or more; of rows that repeat an id all stay or go. Rows with a null id have no component and stay."""
    others = save(link_components(docs, words=5, percent=80).where("doc <> component_id").select(F.col("doc").alias("gone")), "others")
    return docs.join(others, docs["doc_id"] == others["gone"], "left_anti").select(*docs.columns)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item; of rows that repeat an id only those with a
    matching text go."""
    bad = save(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct(), "matches")
    same = (docs["doc_id"] == bad["gone"]) & (F.xxhash64(docs["text"]) == bad["gone_text"])
    return docs.join(bad, same, "left_anti").select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one copy or more in the mixture, with their rates."""
    return mix(docs, table(spark, sf_dir, "labels")).where("copies >= 1")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixing", mixing)]

#: The language model and the mixing rates can't be expressed in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    base = f"{shared_dir(spark)}/tidelog-pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, function = stage
        out = function(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        return spark.read.schema(out.schema).parquet(f"{base}/{name}")

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
