"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_quality import op10_quality_scores
from .op11_rules import op11_quality_rules
from .op12_fill_middle import ORACLE as FILL_SQL
from .op12_fill_middle import op12_fill_in_middle
from .op13_collocations import ORACLE as PHRASES_SQL
from .op13_collocations import op13_phrase_collocations
from .op1_pii import op1_pii_spans
from .op2_decontaminate import op2_benchmark_leaks
from .op3_paragraphs import op3_repeated_paragraphs
from .op4_pitman_yor import op4_pitman_yor_scores
from .op5_media import op5_media_fingerprints
from .op6_mixture import op6_mix_sources
from .op7_simhash import op7_simhash_components
from .op8_suffixes import op8_suffix_dedup
from .op9_licenses import op9_license_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_pii": lambda s, d: op1_pii_spans(docs(s, d)),
        "op2_decontaminate": lambda s, d: op2_benchmark_leaks(docs(s, d), table(s, d, "benchmark")),
        "op3_paragraphs": lambda s, d: op3_repeated_paragraphs(docs(s, d)),
        "op4_pitman_yor": lambda s, d: op4_pitman_yor_scores(docs(s, d)),
        "op5_media": lambda s, d: op5_media_fingerprints(docs(s, d)),
        "op6_mixture": lambda s, d: op6_mix_sources(docs(s, d)),
        "op7_simhash": lambda s, d: op7_simhash_components(docs(s, d)),
        "op8_suffixes": lambda s, d: op8_suffix_dedup(docs(s, d)),
        "op9_licenses": lambda s, d: op9_license_scan(docs(s, d)),
        "op10_quality": lambda s, d: op10_quality_scores(docs(s, d), table(s, d, "labels")),
        "op11_rules": lambda s, d: op11_quality_rules(docs(s, d), table(s, d, "labels")),
        "op12_fill_middle": lambda s, d: op12_fill_in_middle(docs(s, d)),
        "op13_collocations": lambda s, d: op13_phrase_collocations(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_middle": FILL_SQL, "op13_collocations": PHRASES_SQL}
