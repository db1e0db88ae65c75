"""The registry of this subpackage's queries; __spark_entry__ adds them when it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, divergence, line_dedup, sharding
from .clustering import op13_centroid_clustering
from .decontamination import op5_decontamination
from .divergence import op12_source_divergence
from .jaccard_join import op8_ngram_jaccard_join
from .language_id import op4_language_id
from .line_dedup import op2_line_dedup
from .mixing import op3_source_mixing
from .neighbours import op9_nearest_neighbours
from .quality import op10_quality_classifier
from .secrets import op1_secret_scans
from .sharding import op11_sharding
from .substring_dedup import op7_substring_dedup
from .token_counts import op6_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_line_dedup": op2_line_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_token_counts": op6_token_counts,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_sharding": op11_sharding,
        "op12_source_divergence": op12_source_divergence,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op11_sharding": sharding.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_centroid_clustering": clustering.ORACLE_SQL,
    }
