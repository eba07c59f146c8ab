"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``,
the last one excepted, which adds what the mixture decided. ``run`` writes each stage's result as Parquet to the shared
checkpoint folder and reads it again, so a lost executor repeats one stage at most.

Cases, for every stage: a null text counts as empty; rows with a null id stay in stages that name documents by id; rows
equal in id and text go or stay together; an empty table gives an empty one; further columns of ``docs`` pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import op1_pii, op2_decontaminate, op6_mixture, op7_simhash, op10_quality
from wayfold.llm.shared import Scratch, checked

#: The stages learn, hash and sample; no SQL says their rows.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the positive-unlabelled classifier scores below its threshold."""
    network = op10_quality.train(docs, _table(spark, sf_dir, "labels"))
    score = _free(docs, "_score")
    return op10_quality.with_score(docs, network, score_col=score).filter(F.col(score) >= op10_quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 over 5-word shingles the smallest id stays; rows without an id stay.
    A row is named by its id and text, so another text under the same id is judged on its own."""
    groups = op7_simhash.near_copies(docs)
    extra = checked(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct())
    return docs.join(extra, (docs["doc_id"] == extra["gone"]) & (F.xxhash64(docs["text"]) == extra["gone_text"]), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its values changed or not. Rows are named by the hash of id and text."""
    name = _free(docs, "_name")
    named = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = op2_decontaminate.leaks(named, _table(spark, sf_dir, "benchmark"), id_col=name).select(F.col("doc_id").alias("leak")).distinct()
    found = checked(found)
    return named.join(found, named[name] == found["leak"], "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind; n_chars follows the new text."""
    return op1_pii.redact(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mixture takes, with size, target and copies (under free names); those it leaves out go."""
    mixed = op6_mixture.mix_sources(docs)
    m = mixed[mixed.columns[-1]]
    return mixed.filter(m["copies"] > 0).select(*docs.columns, *[m[c].alias(_free(docs, c)) for c in ("size", "source_size", "target", "copies", "taken")])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = _table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = name
    return docs
