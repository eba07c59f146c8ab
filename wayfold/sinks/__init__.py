"""Sinks: result tables with a provenance document beside them, passage exports by sequence and by run, a column rewritten
in place. Each writes a folder and swaps it in when it is whole."""

from __future__ import annotations

import json
import platform
import subprocess

import numpy
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _swap(spark: SparkSession, new: str, old: str) -> None:
    """The new folder takes the old one's place; the old one goes last."""
    a, fs = _fs(spark, new)
    b, _ = _fs(spark, old)
    aside, _ = _fs(spark, old + ".old")
    if fs.exists(b):
        fs.rename(b, aside)
    fs.rename(a, b)
    fs.delete(aside, True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def git_commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def save_results(df: DataFrame, path: str, **meta) -> dict:
    """A Parquet table and ``<path>.meta.json``: what the caller says, then the commit, versions and the row count."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    own = {"git_commit": git_commit(), "python": platform.python_version(), "platform": platform.platform(), "n_rows": spark.read.parquet(path).count(), "numpy": numpy.__version__, "spark": spark.version}
    doc = own | meta
    _put(spark, f"{path}.meta.json", json.dumps(doc, indent=2, sort_keys=True, default=str))
    return doc


def rewrite_column(df: DataFrame, path: str, column: str, value: Column, dry_run: bool = False) -> dict:
    """Replace one text column of the CSV folder that ``df`` was read from, all other text untouched; written only if any
    flag flips. Flags are true, 1 or yes before, True or False after."""
    old = F.coalesce(F.lower(F.trim(F.col(column))).isin("true", "1", "yes"), F.lit(False))
    both = df.withColumns({"_old": old, "_new": value})
    stats = both.agg(F.count("*").alias("rows"), F.count_if("_old").alias("true_old"), F.count_if("_new").alias("true_new"), F.count_if(F.col("_old") != F.col("_new")).alias("flipped")).first().asDict()
    stats["wrote"] = bool(stats["flipped"]) and not dry_run
    if stats["wrote"]:
        text = both.withColumn(column, F.when(F.col("_new"), "True").otherwise("False")).select(*df.columns)
        write_csv(text, path + ".new")
        _swap(df.sparkSession, path + ".new", path)
    return stats


def export_index(found: DataFrame, stem: Column, camera: Column, frame_col: str, **settings) -> DataFrame:
    """One row a sequence of ``found`` (num_detections, num_truth_frames, first_frame): where its files lie, its counts, the
    settings behind it."""
    return found.select(
        stem.alias("sequence"), camera.alias("camera_id"), F.concat(F.lit("x/"), stem, F.lit(".csv")).alias("x_csv"), F.concat(F.lit("y_truth/"), stem, F.lit("_truth.csv")).alias("y_truth_csv"),
        "num_detections", "num_truth_frames", F.lit(frame_col).alias("frame_col"), "first_frame", *[F.lit(v).alias(k) for k, v in settings.items()],
    )


def by_run(index: DataFrame) -> DataFrame:
    """The index with its files regrouped in a folder for each run, the run first."""
    run = F.substring_index("sequence", "_camera_", 1)
    name = lambda c: F.substring_index(c, "/", -1)
    moved = {"x_csv": F.concat(run, F.lit("/x/"), name("x_csv")), "y_truth_csv": F.concat(run, F.lit("/y/"), name("y_truth_csv"))}
    return index.withColumns(moved).withColumnRenamed("y_truth_csv", "y_csv").select(run.alias("run"), *["y_csv" if c == "y_truth_csv" else c for c in index.columns])


def export_passages(detections: DataFrame, index: DataFrame, path: str) -> None:
    """``x/sequence=…`` with (frame_number, confidence, empty where there is none) and the index, by sequence."""
    rows = detections.select("sequence", F.col("frame_number").cast("bigint").alias("frame_number"), F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"))
    rows.repartition("sequence").sortWithinPartitions("sequence", "frame_number").write.mode("overwrite").partitionBy("sequence").option("header", True).option("emptyValue", "").csv(f"{path}/x")
    write_csv(index, f"{path}/index")


def export_by_run(detections: DataFrame, index: DataFrame, path: str) -> None:
    """The same, with a folder for each run above the sequences."""
    rows = detections.withColumn("run", F.substring_index("sequence", "_camera_", 1))
    rows.repartition("run").sortWithinPartitions("run", "sequence", "frame_number").write.mode("overwrite").partitionBy("run", "sequence").option("header", True).csv(f"{path}/x")
    write_csv(by_run(index), f"{path}/index")


def save_sensors(sensors: DataFrame, path: str, **extra) -> None:
    """A sensor document; placement leaves a few hundred rows at most, which are checked before they are collected."""
    n = sensors.count()
    if n > 100_000:
        raise ValueError(f"{n} sensors: write a table instead")
    rows = [r.asDict() for r in sensors.orderBy("sensor_id").collect()]
    doc = {"n_sensors": n, "n_perimeter": sum(r["role"] == "perimeter" for r in rows), "n_interior": sum(r["role"] == "interior" for r in rows), "sensors": rows, **extra}
    _put(sensors.sparkSession, path, json.dumps(doc, indent=2))
