"""Operators on ordered sequences: runs, sessions, folds, rolling robust statistics, interpolation, windows.

Each takes a DataFrame, the keys of a sequence and its order, stays lazy and shuffles once by the keys; operators in a
row over the same keys reuse that partitioning. Sequences are independent, so a long table of many sequences scales out;
nothing here gathers rows of more than one sequence. Rolling
quantiles, recursions and medians do not gather one either (``ranks``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from . import ranks as R
from .store import durable

Names = Sequence[str]


def over(keys: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def around(keys: Names, order: Names, before: int, after: int) -> WindowSpec:
    return over(keys, order).rowsBetween(-before, after)


def per_sequence(df: DataFrame, keys: Names, order: Names, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arrow-batched fallback for recursions that windows cannot say; one sequence at a time."""
    return df.groupBy(*keys).applyInPandas(lambda x: fn(x.sort_values(list(order))), schema)


# --- segments, runs, sessions ------------------------------------------------------------------------------------------


def close_segments(df: DataFrame, keys: Names, order: Names, marker: str, out: str = "seg") -> DataFrame:
    """Segment number; a marker row belongs to the segment it closes."""
    before = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(F.col(marker).cast("int")).over(before), F.lit(0)).cast("bigint"))


def packets_to_frames(df: DataFrame, keys: Names = ("seq_id",), order: Names = ("row_idx",), marker: str = "marker", size: str = "frame_len", time: str = "t_us") -> DataFrame:
    """Frames with packet count, total size, first and last time and row; trailing packets form an open frame."""
    seg = close_segments(df, keys, order, marker)
    at = F.struct(*order)
    return seg.groupBy(*keys, "seg").agg(
        F.count("*").alias("n_packets"), F.sum(size).alias("bytes"), F.min_by(time, at).alias("first_us"), F.max_by(time, at).alias("last_us"),
        F.min(order[0]).alias("first_idx"), F.max(order[0]).alias("last_idx"), F.max(marker).alias("closed"),
    )


def hysteresis(df: DataFrame, keys: Names, order: Names, score: str, on: float, off: float, out: str = "active") -> DataFrame:
    """State 1 from a score at or above ``on`` until one at or below ``off``; equal thresholds compare strictly."""
    s = F.col(score)
    if on == off:
        return df.withColumn(out, (s > on).cast("int"))
    vote = F.when(s >= on, 1).when(s <= off, 0)
    upto = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(vote, ignorenulls=True).over(upto), F.lit(0)))


def binarize(df: DataFrame, keys: Names, order: Names, score: str, threshold: float = 0.5, on: float | None = None, off: float | None = None, out: str = "active") -> DataFrame:
    if on is not None and on != off:
        return hysteresis(df, keys, order, score, on, off, out)
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def run_ids(df: DataFrame, keys: Names, order: Names, flag: str, out: str = "run") -> DataFrame:
    """Number of the maximal run of equal flags each row lies in."""
    change = (F.lag(flag).over(over(keys, order)).eqNullSafe(F.col(flag))).cast("int")
    return df.withColumn("_c", 1 - change).withColumn(out, F.sum("_c").over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def true_runs(df: DataFrame, keys: Names, order: Names, flag: str, time: str = "t_us", score: str | None = None) -> DataFrame:
    """Runs of true: first and last row (both inside), times, length, and peak (first of equals) if there is a score."""
    r = run_ids(df, keys, order, flag).filter(F.col(flag).cast("int") == 1)
    aggs = [F.min(order[0]).alias("start_idx"), F.max(order[0]).alias("end_idx"), F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("n")]
    if score:
        first = F.struct((-F.col(score)).alias("p"), *order)
        aggs += [F.max(score).alias("peak"), F.min_by(order[0], first).alias("peak_idx"), F.min_by(time, first).alias("peak_us")]
    return r.groupBy(*keys, "run").agg(*aggs).drop("run")


def merge_gaps(events: DataFrame, keys: Names, gap_us: int) -> DataFrame:
    """Events closer than ``gap_us`` (strictly) to the latest end so far become one; the first highest peak speaks for it."""
    order = ["start_us"]
    if gap_us <= 0:
        return events.select(*keys, "start_us", "end_us", "peak", "peak_us", "n", F.lit(1).cast("bigint").alias("n_parts"), F.row_number().over(over(keys, order)).cast("bigint").alias("event_idx"))
    end = F.max("end_us").over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    new = (end.isNull() | (F.col("start_us") - end >= gap_us)).cast("int")
    s = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(over(keys, order)))
    out = s.groupBy(*keys, "_s").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("peak").alias("peak"),
        F.min_by("peak_us", F.struct((-F.col("peak")).alias("p"), F.col("start_us").alias("i"))).alias("peak_us"), F.sum("n").alias("n"), F.count("*").alias("n_parts"),
    )
    return out.withColumn("event_idx", F.col("_s").cast("bigint")).drop("_s")


def min_duration(events: DataFrame, least_us: int) -> DataFrame:
    return events.filter(F.col("end_us") - F.col("start_us") >= least_us)


def fill_short_gaps(df: DataFrame, keys: Names, order: Names, flag: str, longest: int, out: str = "filled") -> DataFrame:
    """Runs of false up to ``longest`` with true on both sides become true."""
    r = run_ids(df, keys, order, flag)
    runs = r.groupBy(*keys, "run").agg(F.count("*").alias("_n"), F.max(F.col(flag).cast("int")).alias("_f"))
    w = over(keys, ["run"])
    runs = runs.withColumn("_fill", (F.col("_f") == 0) & (F.col("_n") <= longest) & F.lag("run").over(w).isNotNull() & F.lead("run").over(w).isNotNull())
    joined = r.join(runs.select(*keys, "run", "_fill"), [*keys, "run"])
    return joined.withColumn(out, F.when(F.col("_fill"), 1).otherwise(F.col(flag).cast("int"))).drop("run", "_fill")


def keep_runs(df: DataFrame, keys: Names, order: Names, flag: str, least: int | None = None, most: int | None = None, out: str = "kept") -> DataFrame:
    """Runs of true of a length from ``least`` to ``most`` stay true."""
    r = run_ids(df, keys, order, flag)
    n = F.count("*").over(Window.partitionBy(*keys, "run"))
    ok = F.col(flag).cast("int") == 1
    if least is not None:
        ok = ok & (n >= least)
    if most is not None:
        ok = ok & (n <= most)
    return r.withColumn(out, ok.cast("int")).drop("run")


# --- folds and rolling statistics ----------------------------------------------------------------------------------------


def ewm(df: DataFrame, keys: Names, order: Names, value: str, alpha: float, out: str = "ewm") -> DataFrame:
    """y0 = x0, y = alpha x + (1 - alpha) y before, by linear maps of ranges (``ranks.smoothed``)."""
    return R.smoothed(df, keys, order, value, alpha, out)


def rolling_quantile(df: DataFrame, keys: Names, order: Names, value: str, window: int, q: float, out: str, dense: bool = False) -> DataFrame:
    """Centred rolling quantile, shorter at the ends, in chunks of a sequence; ``dense`` says that the order counts rows
    without gaps and need not be ranked."""
    half = (window - 1) // 2
    d, at = R.indexed(df, keys, order, dense)
    return R.in_chunks(d, keys, at, [value], half, lambda v: R.centred_quantile(v, half, q), out).select(*df.columns, out)


def rolling_mean(df: DataFrame, keys: Names, order: Names, value: str, window: int, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(around(keys, order, (window - 1) // 2, (window - 1) // 2)))


def robust_center(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """Adds ``med`` and ``mad`` of a sequence: exact quantiles, twice."""
    d = R.with_quantiles(durable(df), keys, value, {"med": 0.5}).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return R.with_quantiles(d, keys, "_d", {"mad": 0.5}).drop("_d")


def robust_zscore(df: DataFrame, keys: Names, value: str, out: str = "z") -> DataFrame:
    return robust_center(df, keys, value).withColumn(out, (F.col(value) - F.col("med")) / (1.4826 * F.col("mad") + 1e-9))


def residual_signal(df: DataFrame, keys: Names, order: Names, size: str, window: int = 301, q: float = 0.2, smooth: int = 7, dense: bool = False) -> DataFrame:
    """log1p of the size less its rolling baseline, median-smoothed (both in one pass over chunks), as a robust z."""
    wide, near = (window - 1) // 2, (smooth - 1) // 2
    d, at = R.indexed(df.withColumn("lv", F.log1p(F.greatest(F.col(size), F.lit(0)).cast("double"))), keys, order, dense)
    d = R.in_chunks(d, keys, at, ["lv"], wide + near, lambda v: R.centred_quantile(v - R.centred_quantile(v, wide, q), near, 0.5), "sm")
    return robust_zscore(d, keys, "sm", "z").drop("_at")


def threshold_detector(df: DataFrame, keys: Names, order: Names, size: str, threshold: float, active: int = 21, share: float = 0.45, gap: int = 8, least: int = 15, dense: bool = False) -> DataFrame:
    """Sustained excess: point test, rolling share of hits, short gaps filled, short runs dropped; column ``visible``. ``score``
    (0 to 1) is the logistic of the excess times the share, standardised over the sequence."""
    d = residual_signal(df, keys, order, size, dense=dense).withColumn("hit", (F.col("z") >= threshold).cast("double"))
    d = rolling_mean(d, keys, order, "hit", active, "frac").withColumn("on", (F.col("frac") >= share).cast("int"))
    d = d.withColumn("_e", F.greatest(F.col("z") - threshold, F.lit(0.0)) * F.col("frac"))
    whole = Window.partitionBy(*keys)
    d = d.withColumn("score", 1 / (1 + F.exp(-(F.col("_e") - F.avg("_e").over(whole)) / (F.stddev_pop("_e").over(whole) + 1e-9)))).drop("_e")
    return keep_runs(fill_short_gaps(d, keys, order, "on", gap, "filled"), keys, order, "filled", least=least, out="visible")


def iframe_mask(df: DataFrame, keys: Names, order: Names, size: str, k: float = 8.0, tail: int = 2) -> DataFrame:
    """Outliers of log size (median + k MAD) or above the .995 quantile, and ``tail`` rows after each."""
    d = robust_center(df.withColumn("lv", F.log1p(F.col(size).cast("double"))), keys, "lv")
    d = R.with_quantiles(durable(d), keys, size, {"_top": 0.995})
    d = d.withColumn("hit", ((F.col("lv") > F.col("med") + k * (F.col("mad") + 1e-9)) | (F.col(size) > F.col("_top"))).cast("int")).drop("_top")
    return d.withColumn("mask", F.max("hit").over(around(keys, order, tail, 0)))


def head_omit(df: DataFrame, keys: Names, order: Names, hit: str, k: int, out: str = "omit") -> DataFrame:
    """The k rows before each hit."""
    return df.withColumn(out, F.coalesce(F.max(hit).over(over(keys, order).rowsBetween(1, k)), F.lit(0)))


def spike_mask(df: DataFrame, keys: Names, order: Names, value: str, window: int = 9, k: float = 6.0, narrow: int = 3, dense: bool = False) -> DataFrame:
    """Narrow runs above rolling median + k * 1.4826 * rolling MAD."""
    d = rolling_quantile(df, keys, order, value, window, 0.5, "rm", dense).withColumn("_d", F.abs(F.col(value) - F.col("rm")))
    d = rolling_quantile(d, keys, order, "_d", window, 0.5, "rmad", dense).withColumn("hit", (F.col(value) > F.col("rm") + k * 1.4826 * F.col("rmad")).cast("int"))
    return keep_runs(d.drop("_d"), keys, order, "hit", most=narrow, out="spike")


# --- filling, resampling, windows ----------------------------------------------------------------------------------------


def fill_both(df: DataFrame, keys: Names, order: Names, value: str, out: str = "filled") -> DataFrame:
    """Last known value, and the first one for a leading gap."""
    w = over(keys, order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(back, ahead))


def interpolate(df: DataFrame, keys: Names, order: Names, value: str, mask: str, out: str = "interp") -> DataFrame:
    """Masked rows on the line between their nearest valid rows by index, edges held, not below 0, half-even."""
    w = over(keys, order)
    good = F.when(F.col(mask).cast("int") == 0, F.struct(F.col(order[0]).alias("i"), F.col(value).cast("double").alias("v")))
    a, b = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order[0]) - F.col("_a.i")) / F.greatest(F.col("_b.i") - F.col("_a.i"), F.lit(1))
    est = F.when(F.col(mask).cast("int") == 0, F.col(value).cast("double")).otherwise(F.coalesce(line, F.col("_a.v"), F.col("_b.v")))
    return d.withColumn(out, F.rint(F.greatest(est, F.lit(0.0))).cast("bigint")).drop("_a", "_b")


def resample(df: DataFrame, keys: Names, index: str, value: str, flag: str, n: int) -> DataFrame:
    """Each sequence on n evenly spaced index positions (index from 0): linear value, nearest flag (half-even)."""
    size = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    grid = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pos", F.col("k") * (F.col("_n") - 1) / float(n - 1))
    grid = grid.withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos"), "nn": F.rint("pos").cast("bigint")})
    src = lambda name, col: df.select(*keys, F.col(index).alias(name), F.col(col).alias(f"_{name}"))
    j = grid.join(src("lo", value), [*keys, "lo"]).join(src("hi", value), [*keys, "hi"]).join(src("nn", flag), [*keys, "nn"])
    return j.select(*keys, F.col("k").cast("bigint").alias("k"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("pos") - F.col("lo"))).alias(value), F.col("_nn").alias(flag))


def window_starts(df: DataFrame, keys: Names, index: str, size: int, stride: int) -> DataFrame:
    """Starts 0, stride, … and the last full start, once each."""
    n = df.groupBy(*keys).agg((F.max(index) + 1).alias("n"))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(stride).cast("bigint")), F.array(F.greatest(F.lit(0).cast("bigint"), F.col("n") - size))))
    return n.select(*keys, "n", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + size, F.col("n")))


def in_windows(df: DataFrame, keys: Names, index: str, size: int, stride: int) -> DataFrame:
    """Rows of each window, by the few starts a row can belong to rather than a range join."""
    n = F.max(index).over(Window.partitionBy(*keys)) + 1
    i = F.col(index)
    lowest = F.greatest(F.lit(0), F.ceil((i - size + 1) / stride)) * stride
    regular = F.when(lowest <= i, F.sequence(lowest.cast("bigint"), i, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    last = F.greatest(F.lit(0).cast("bigint"), F.col("_n") - size)
    starts = F.array_distinct(F.concat(regular, F.when(i >= last, F.array(last)).otherwise(F.array().cast("array<bigint>"))))
    return df.withColumn("_n", n).withColumn("start", F.explode(starts)).drop("_n")


def drop_surplus(windows: DataFrame, label: str, order: Names) -> DataFrame:
    """All windows with a true label, and of the others as many as there are of these at most: the surplus goes at evenly
    spaced ranks floor(j (n - 1) / (k - 1)), j from 0 to k - 1. The rank comes by ranges; whether a rank is one of these
    follows from arithmetic on the two counts."""
    zero = R.positions(windows.filter(~F.col(label)), [], order, "_at").withColumn("_at", F.col("_at") - 1)
    n = windows.agg(F.count_if(label).alias("_p"), F.count_if(~F.col(label)).alias("_n"))  # one row
    d = zero.crossJoin(F.broadcast(n)).withColumn("_k", F.col("_n") - F.least("_n", "_p"))
    step = lambda j: F.floor(j * (F.col("_n") - 1).cast("double") / F.greatest(F.col("_k") - 1, F.lit(1)))
    # the only numbers whose step can be this rank
    near = F.floor(F.col("_at") * F.greatest(F.col("_k") - 1, F.lit(1)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    gone = F.lit(False)
    for e in (-1, 0, 1, 2):
        j = near + e
        gone = gone | ((j >= 0) & (j < F.col("_k")) & (step(j) == F.col("_at")))
    return windows.filter(label).unionByName(d.filter(~gone).select(*windows.columns))


def fixed_period(df: DataFrame, keys: Names, order: Names, time_us: str, period_us: int, out: str = "boundary") -> DataFrame:
    """The last row of each period counted from the first row in order, and the final row."""
    w = over(keys, order)
    t0 = F.first(time_us).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("bin", ((F.col(time_us) - t0) / period_us).cast("bigint"))
    last = ~F.lead("bin").over(over(keys, order)).eqNullSafe(F.col("bin"))
    return d.withColumn(out, last.cast("int"))


def interarrival(df: DataFrame, keys: Names, order: Names, time_us: str, marker: str) -> DataFrame:
    """Time since the row before; the first row goes; the last marker is true."""
    w = over(keys, order)
    d = df.withColumns({"dt_us": F.col(time_us) - F.lag(time_us).over(w), "closing": F.col(marker) | F.lead(time_us).over(w).isNull()})
    return d.filter("dt_us IS NOT NULL")
