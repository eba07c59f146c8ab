"""Bootstrap by partial sums: resamples are weights, not copies.

Row weights are Poisson(1) draws from a 32-bit counter hash of (row id, resample number): the same on any engine, in any
order of rows, after any retry. A task adds weight times value into an array of sums for each group and block of resamples;
arrays add up across tasks. So a resample of a table copies no row, and what is shuffled is groups x resamples numbers a
task, whatever the number of rows.

Cases: rows with a null, infinite or NaN value are left out; a group without values has null bounds; one of one value has
that value as its bounds, as in a resample of one row; resamples that draw nothing are left out; an empty table gives no
rows; rows with equal ids are drawn together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = Sequence[str]

RESAMPLES, BLOCK = 10_000, 500
#: Fixed values of the hash, and the upper 16 bits from which on a draw is at least 1, 2, … (cumulative Poisson(1) shares).
ROW, TURN, STIR = 73244475, 295559667, 1540483477
AT_LEAST = (24110, 48219, 60274, 64292, 65297, 65498, 65531)
_DRAW = np.searchsorted(AT_LEAST, np.arange(1 << 16), side="right").astype(np.float64)
#: Memory of a task's sums before they are handed on.
HELD = 64 << 20


def weights(ids: np.ndarray, first: int, n: int) -> np.ndarray:
    """Draws [rows, n] of the resamples from ``first`` on."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * np.uint32(ROW) + (np.arange(first, first + n, dtype=np.uint32) * np.uint32(TURN))[None, :]
        for _ in range(2):
            x ^= x >> np.uint32(16)
            x *= np.uint32(STIR)
        x ^= x >> np.uint32(15)
    return _DRAW[x >> np.uint32(16)]


def weight_sql(row: str, turn: str) -> str:
    """The same draw as SQL over two integers (row from 0 to 2^32 - 1)."""
    x = f"(({row}) * {ROW} + ({turn}) * {TURN}) % 4294967296"
    for _ in range(2):
        x = f"(xor({x}, ({x}) >> 16) * {STIR}) % 4294967296"
    return "(" + " + ".join(f"(xor({x}, ({x}) >> 15) >> 16 >= {t})::INT" for t in AT_LEAST) + ")"


def _sums(n_keys: int, n_values: int, resamples: int):
    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        starts = range(0, resamples, BLOCK)

        def give():
            for key, sums in held.items():
                keys = [pa.array([v] * len(starts)) for v in key]
                yield key, keys, sums
            held.clear()

        def as_batches(schema):
            for key, _, sums in give():
                parts = [sums[:, a : a + BLOCK].ravel() for a in starts]
                columns = [pa.array([v] * len(starts), schema.field(k).type) for k, v in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(starts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=[*schema.names[:n_keys], "block", "sums"])

        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for k in range(n_keys):
                d = batch.column(k).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            ids = batch.column(n_keys).to_numpy()
            values = np.stack([np.ones(batch.num_rows), *[batch.column(n_keys + 1 + k).to_numpy() for k in range(n_values)]])
            for c in np.unique(code):
                rows = np.flatnonzero(code == c)
                key = tuple(batch.column(k)[int(rows[0])].as_py() for k in range(n_keys))
                sums = held.setdefault(key, np.zeros((n_values + 1, resamples)))
                for a in starts:
                    n = min(BLOCK, resamples - a)
                    for r in range(0, len(rows), 4096):
                        part = rows[r : r + 4096]
                        sums[:, a : a + n] += values[:, part] @ weights(ids[part], a, n)
                if len(held) * sums.nbytes > HELD:
                    yield from as_batches(schema)
        if held:
            yield from as_batches(schema)

    return run


def resampled(df: DataFrame, keys: Names, row_id: str, values: Names, resamples: int = RESAMPLES) -> DataFrame:
    """(keys, b, w, s1, s2, …): of each resample of each group the sum of weights and the weighted sums of ``values``; rows
    with a value that is not finite are left out."""
    finite = reduce(lambda x, y: x & y, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")) for v in values])
    rows = df.filter(finite).select(*keys, F.col(row_id).cast("bigint").alias("_id"), *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)])
    key_fields = [rows.schema[k] for k in keys]
    shape = T.StructType([*key_fields, T.StructField("block", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    partial = rows.mapInArrow(_sums(len(keys), len(values), resamples), shape)

    def total(x: pd.DataFrame) -> pd.DataFrame:
        return x.iloc[:1].assign(sums=[np.sum(np.stack(x["sums"].to_numpy()), axis=0)])

    blocks = partial.groupBy(*keys, "block").applyInPandas(total, shape)
    n = (F.size("sums") / (len(values) + 1)).cast("int")
    part = lambda k: F.slice("sums", n * k + 1, n)
    names = ["w", *[f"s{k + 1}" for k in range(len(values))]]
    zipped = F.arrays_zip(*[part(k).alias(c) for k, c in enumerate(names)])
    rows = blocks.select(*keys, "block", F.posexplode(zipped).alias("_i", "_x"))
    fields = [f.name for f in rows.schema["_x"].dataType.fields]
    return rows.select(*keys, (F.col("block") * BLOCK + F.col("_i")).alias("b"), *[F.col("_x")[f].alias(c) for f, c in zip(fields, names)])


def mean(k: int = 1) -> Column:
    return F.when(F.col("w") > 0, F.col(f"s{k}") / F.col("w"))


def pearson(x: int, y: int, xx: int, yy: int, xy: int) -> Column:
    """Correlation of a resample from the places of its sums; null where a side does not vary."""
    s = lambda k: F.col(f"s{k}")
    w = F.col("w")
    vx, vy = w * s(xx) - s(x) * s(x), w * s(yy) - s(y) * s(y)
    least = 1e-9
    return F.when((vx > least * w * s(xx)) & (vy > least * w * s(yy)), (w * s(xy) - s(x) * s(y)) / F.sqrt(vx * vy))


def interval(samples: DataFrame, keys: Names, statistic: Column, alpha: float = 0.05, more: Sequence[Column] = ()) -> DataFrame:
    """Percentile interval of a statistic over the resamples of each group: keys, ``lo``, ``hi`` and what ``more`` aggregates of
    column ``v``."""
    return samples.select(*keys, statistic.alias("v")).groupBy(*keys).agg(F.percentile("v", alpha / 2).alias("lo"), F.percentile("v", 1 - alpha / 2).alias("hi"), *more)


def mean_interval(df: DataFrame, keys: Names, row_id: str, value: str, resamples: int = RESAMPLES, alpha: float = 0.05) -> DataFrame:
    """keys, ``n`` finite values, their ``mean`` and its interval ``lo``, ``hi`` for every group of ``df``."""
    v = F.col(value).cast("double")
    fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    known = df.groupBy(*keys).agg(F.count(fine).alias("n"), F.avg(fine).alias("mean"))
    got = interval(resampled(df, keys, row_id, [value], resamples), keys, mean(), alpha)
    return beside(known, got, keys).select(*keys, "n", "mean", F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col("hi")).alias("hi"))


def beside(one: DataFrame, two: DataFrame, keys: Names) -> DataFrame:
    """The columns of ``two`` beside those of ``one``, by keys that may be null."""
    two = two.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[c for c in two.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    return one.join(two, same, "left").drop(*[f"_b{i}" for i in range(len(keys))])


def difference(samples: DataFrame, axis: str, low: str, high: str, keys: Names = (), alpha: float = 0.05) -> DataFrame:
    """Means of ``high`` less means of ``low`` along ``axis``, resample by resample: interval, and the share of resamples at or
    below zero as one-sided p."""
    side = lambda k: F.max(F.when(F.col(axis) == k, mean()))
    both = samples.filter(F.col(axis).isin(low, high)).groupBy(*keys, "b").agg(side(high).alias("_h"), side(low).alias("_l"))
    return interval(both, keys, F.col("_h") - F.col("_l"), alpha, [F.avg((F.col("v") <= 0).cast("double")).alias("p")])
