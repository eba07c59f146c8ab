"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions alone.

Word counts are summed by (source, hash bucket); the bucket in which a source's budget ends is refined by the next
twelve hash bits, level after level, so that after five levels a threshold of 60 bits stands for each source and the
choice is a filter, with no sort of documents. Every level groups with map-side sums: a source with a third of all rows
costs a task no more than its 4096 bucket sums. What windows sort is one row a source or a bucket.

Cases: null ids and texts count as such (size 0 for a null text); rows equal in id and text share a hash and go
together; a boundary bucket that no further bits split is taken if that comes nearer; a table without words takes
nothing; an empty table gives no rows; columns other than id, text and source pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked, cut, free_name

LEVELS, BITS = 5, 12
PREFIX = "_mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (…, target): weights repeat over the sorted sources; a level is filled up to each cap.

    The unpartitioned windows see one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = sizes.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    fits = capped.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    return fits.select("source", "source_size", F.least("cap", F.coalesce(F.max("level").over(everything) * F.col("weight"), F.col("cap"))).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("key", (LEVELS - 1 - level) * BITS).bitwiseAND((1 << BITS) - 1)


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key of 60 bits, size) and targets to (…, copies, threshold): all rows go ``copies`` times, those with a
    smaller key than the threshold once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("copies", whole.cast("int"))
    edge = plan.filter("source_size > 0").select(F.col("source").alias("s"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("left"), F.lit(0).cast("bigint").alias("head"))
    for level in range(LEVELS):
        here = rows if level == 0 else rows.join(edge.select("s", "head"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", (LEVELS - level) * BITS) == F.col("head"))).drop("s", "head")
        sums = here.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        both = sums.join(edge, F.col("source").eqNullSafe(F.col("s")))
        upto = Window.partitionBy("source").orderBy("b")
        both = both.withColumn("sum", F.sum("n").over(upto)).filter(F.col("sum") > F.col("left"))
        first = both.groupBy("source").agg(F.min(F.struct("b", "n", "sum", "left", "head")).alias("x"))
        edge = first.select(F.col("source").alias("s"), (F.col("x.left") - F.col("x.sum") + F.col("x.n")).alias("left"), (F.col("x.head") * (1 << BITS) + F.col("x.b")).alias("head"), F.col("x.n").alias("last"))
        edge = cut(edge)
    end = edge.select("s", (F.col("head") + (F.col("left") * 2 >= F.col("last")).cast("bigint")).alias("threshold"))
    return plan.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("bigint")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every input row with its columns and, last, a struct ``_mix_`` (or the next free name): size, source_size, target,
    copies, taken.

    The plan of thresholds (a row a source, counted) is broadcast up to a million sources; beyond, a shuffled join whose
    hot source adaptive skew handling splits."""
    key = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 4)
    rows = docs.select(F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = checked(thresholds(rows, cut(source_targets(sizes, weights, share, most))))
    plan = plan.select(F.struct("*").alias("plan"))
    # rows travel as one struct, so no name of theirs meets one of ours
    out = docs.select(F.struct("*").alias("row"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.col(source_col).alias("source"))
    p = F.col("plan")
    out = out.join(plan, F.col("source").eqNullSafe(p["source"]), "left")
    copies = p["copies"] + (F.col("key") < p["threshold"]).cast("int")
    row = F.struct("size", p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    return out.select("row.*", row.alias(free_name(docs, PREFIX)))


def op6_mix_sources(docs: DataFrame) -> DataFrame:
    m = F.col(PREFIX)
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken")])
