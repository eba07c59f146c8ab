"""Event detection scored against truth: events from flags, matching, metrics, hyper-parameter sweeps.

A sweep is one plan over (sequence, setting): binarisation is shared by all gaps, merging by all tolerances and
durations, so the rows of a sequence are copied once for each way to binarise, not once for each setting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sequences as Q
from .matching import band_join, greedy_match

Names = Sequence[str]


def merged_events(runs: DataFrame, keys: Names, gap: Column) -> DataFrame:
    """Runs (start_us, end_us) closer than ``gap`` (strictly; none for a gap of 0) to the latest end so far become one."""
    w = Window.partitionBy(*keys).orderBy("start_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (gap <= 0) | (F.col("start_us") - before >= gap)).cast("int")
    s = runs.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return s.groupBy(*keys, "_s").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_s")


def numbered(events: DataFrame, keys: Names) -> DataFrame:
    """``k`` from 1 in order of starts; ``mid2_us`` is twice the midpoint, which stands for the event."""
    return events.withColumns({"k": F.row_number().over(Window.partitionBy(*keys).orderBy("start_us")).cast("bigint"), "mid2_us": F.col("start_us") + F.col("end_us")})


def matched_events(predicted: DataFrame, truth: DataFrame, keys: Names, tolerance_us: int) -> DataFrame:
    """(keys, pi, gi, error_us2): one-to-one by midpoints within the tolerance (closed); the error is doubled too."""
    p = predicted.select(*keys, F.col("k").alias("pi"), F.col("mid2_us").alias("pt"))
    g = truth.select(*keys, F.col("k").alias("gi"), F.col("mid2_us").alias("gt2"))
    c = band_join(p, g, keys, "pt", "gt2", 2 * tolerance_us).withColumn("delta", F.abs(F.col("pt") - F.col("gt2")))
    m = greedy_match(c.select(*keys, "delta", "pi", "gi", "pt"), keys, "pt", 4 * tolerance_us)
    return m.join(p, [*keys, "pi"]).join(g, [*keys, "gi"]).select(*keys, "pi", "gi", (F.col("pt") - F.col("gt2")).alias("error_us2"))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, zero on empty denominators."""
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return {"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)}


def timing(error: Column) -> dict[str, Column]:
    """Aggregates of errors in seconds: null on no rows; the spread is that of the population."""
    return {
        "mean_error": F.avg(error), "mean_abs_error": F.avg(F.abs(error)), "median_abs_error": F.percentile(F.abs(error), 0.5),
        "jitter": F.stddev_pop(error), "rms_error": F.sqrt(F.avg(error * error)),
    }


def sequence_metrics(series: DataFrame, predicted: DataFrame, truth: DataFrame, pairs: DataFrame, keys: Names, time: str = "t_us") -> DataFrame:
    """One row a sequence: event counts, scores, ghosts per true event and per minute, timing; sequences without any
    event included."""
    seconds = series.groupBy(*keys).agg(((F.max(time) - F.min(time)) / 1e6).alias("observed_s"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    errors = pairs.withColumn("e", F.col("error_us2") / 2e6).groupBy(*keys).agg(F.count("*").alias("tp"), *[c.alias(n) for n, c in timing(F.col("e")).items()])
    out = seconds.join(count(predicted, "n_pred"), list(keys), "left").join(count(truth, "n_true"), list(keys), "left").join(errors, list(keys), "left")
    out = out.fillna(0, ["n_pred", "n_true", "tp"])
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    out = out.withColumns({"fp": fp, "fn": fn}).withColumns(scores(F.col("tp"), fp, fn))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({"ghost_rate": ratio(F.col("fp"), F.col("n_true")), "fp_per_minute": ratio(F.col("fp"), F.col("observed_s") / 60)})


def grid(thresholds, pairs, gaps, tolerances, durations, with_flag: bool = False) -> list[tuple]:
    """Settings in order: (grid_idx, bin, on, off, gap, tolerance, duration). ``bin`` numbers the ways to binarise: -1 is a
    given flag, then plain thresholds (on = off, at or above), then hysteresis pairs."""
    ways = [(-1, None, None)] if with_flag else []
    ways += [(k, on, off) for k, (on, off) in enumerate([*[(t, t) for t in thresholds], *pairs])]
    rows = [(b, on, off, g, t, m) for b, on, off in ways for g in gaps for t in tolerances for m in durations]
    return [(i, *row) for i, row in enumerate(rows)]


def sweep(series: DataFrame, keys: Names, order: Names, score: str, truth: str, settings: list[tuple], time: str = "t_us") -> DataFrame:
    """(keys, grid_idx, n_pred, n_true, tp, fp, fn, precision, recall, f1) of every sequence and setting of ``grid``."""
    ways = sorted({(b, on, off) for _, b, on, off, *_ in settings if b >= 0})
    gaps, tolerances = sorted({x[4] for x in settings}), sorted({x[5] for x in settings})
    list_of = lambda rows, names: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    many = series.select(*keys, *order, time, F.col(score).alias("_p"), F.inline(list_of(ways, ("bin", "on_at", "off_at"))))
    vote = F.when(F.col("_p") >= F.col("on_at"), 1).when(F.col("_p") <= F.col("off_at"), 0)
    plain = (F.col("_p") >= F.col("on_at")).cast("int")
    upto = Window.partitionBy(*keys, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    many = many.withColumn("active", F.when(F.col("on_at") == F.col("off_at"), plain).otherwise(F.coalesce(F.last(vote, ignorenulls=True).over(upto), F.lit(0))))
    runs = Q.true_runs(many, [*keys, "bin"], order, "active", time)
    each_gap = F.explode(F.array(*[F.lit(g).cast("bigint") for g in gaps])).alias("gap")
    predicted = merged_events(runs.select(*keys, "bin", "start_us", "end_us", each_gap), [*keys, "bin", "gap"], F.col("gap"))
    true = merged_events(Q.true_runs(series, keys, order, truth, time).select(*keys, "start_us", "end_us", each_gap), [*keys, "gap"], F.col("gap"))
    true = numbered(true, [*keys, "gap"])
    names = ("grid_idx", "bin", "on_at", "off_at", "gap", "tol", "least")
    plan = list_of([(i, b, g, t, m) for i, b, _, _, g, t, m in settings], ("grid_idx", "bin", "gap", "tol", "least"))
    base = series.select(*keys).distinct().select(*keys, F.inline(plan))
    lasting = predicted.join(F.broadcast(_rows(series, settings, names)), ["bin", "gap"]).filter(F.col("end_us") - F.col("start_us") >= F.col("least"))
    lasting = numbered(lasting, [*keys, "grid_idx"])
    setting = [*keys, "grid_idx"]
    each = true.join(F.broadcast(_rows(series, settings, names).select("grid_idx", "gap")), "gap")
    hits = None
    for t in tolerances:
        some = [i for i, *_, tol, _ in settings if tol == t]
        pick = lambda df: df.filter(F.col("grid_idx").isin(some))  # noqa: B023, E731
        m = matched_events(pick(lasting), pick(each), setting, t).groupBy(*setting).agg(F.count("*").alias("tp"))
        hits = m if hits is None else hits.unionByName(m)
    count = lambda df, name: df.groupBy(*setting).agg(F.count("*").alias(name))
    out = base.select(*setting).join(count(lasting, "n_pred"), setting, "left").join(count(each, "n_true"), setting, "left").join(hits, setting, "left").fillna(0)
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    return out.withColumns({"fp": fp, "fn": fn}).withColumns(scores(F.col("tp"), fp, fn))


def _rows(any_df: DataFrame, settings: list[tuple], names: Names) -> DataFrame:
    return any_df.sparkSession.createDataFrame(settings, ", ".join(f"{n} {'double' if n in ('on_at', 'off_at') else 'bigint'}" for n in names))


def best_settings(swept: DataFrame, keys: Names) -> DataFrame:
    """Of each sequence the setting of highest F1, then most hits, then fewest false alarms, then first."""
    rank = F.struct(F.col("f1"), F.col("tp"), (-F.col("fp")).alias("fp"), (-F.col("grid_idx")).alias("g"))
    return swept.groupBy(*keys).agg(F.max_by(F.struct("grid_idx", "tp", "fp", "fn", "precision", "recall", "f1"), rank).alias("b")).select(*keys, "b.*")
