"""Order over whole tables: ranks, exact quantiles and linear recursions in which no sequence is one task.

Rows are dealt by ranges of (keys, order), sorted within each range and checkpointed, so that a row's partition and place
hold from then on. A partition can share a sequence only with its neighbours; its first and its last run fold to a linear
map, and the maps of all partitions, two each, are composed on the driver (their number is that of the partitions, not of
rows or keys). A second pass starts each partition where the one before it ends.

Cases: null keys and order values sort first and count; ties keep some fixed order; an empty table gives no rows; one
sequence may hold all rows. ``keys`` may be empty: then the table is one sequence.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import durable

Names = Sequence[str]


def in_ranges(df: DataFrame, keys: Names, order: Names, number: str | None = None) -> DataFrame:
    """Sorted by keys and order over all partitions, whose numbers are the last column, if named: tasks that read them later
    may have others."""
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return durable(rows.withColumn(number, F.spark_partition_id()) if number else rows)


def runs_of(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """First rows of the runs of equal keys in a batch."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in columns:
        code = batch.column(k).dictionary_encode()
        code = code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


class Recursion:
    """y = a y before + b for each row; ``none`` is the value before a sequence, or None where its first value stands for it."""

    def __init__(self, alpha: float | None):
        self.alpha = alpha  # None: counts, y = y before + 1

    def fold(self, x: np.ndarray) -> tuple[float, float, float | None]:
        """(a, b, first value) of a run; nulls (NaN) leave y as it is."""
        if self.alpha is None:
            return 1.0, float(len(x)), 0.0
        v = x[~np.isnan(x)]
        if not len(v):
            return 1.0, 0.0, None
        return float((1 - self.alpha) ** len(v)), float(self.along(v, 0.0)[-1]), float(v[0])

    def along(self, x: np.ndarray, y: float | None) -> np.ndarray:
        if self.alpha is None:
            return y + np.arange(1, len(x) + 1)
        s = pd.Series(x if y is None else np.append(y, x)).ewm(alpha=self.alpha, adjust=False, ignore_na=True).mean().to_numpy()
        return s if y is None else s[1:]


def _join(one: tuple, two: tuple) -> tuple:
    """The map of two runs in a row."""
    return two[0] * one[0], two[0] * one[1] + two[1], one[2] if one[2] is not None else two[2]


def _values(batch: pa.RecordBatch, at: int | None) -> np.ndarray:
    if at is None:
        return np.zeros(batch.num_rows)
    return batch.column(at).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _key(batch: pa.RecordBatch, columns: Sequence[int], row: int) -> bytes:
    return pickle.dumps([batch.column(k)[row].as_py() for k in columns])


def _edges(rule: Recursion, columns: Sequence[int], value: int | None):
    """(partition, number of runs, first key, first map, last key, last map) of a partition, which is numbered in the last
    column."""

    def run(batches):
        first = last = None  # [key, map]
        n = p = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(batch.num_columns - 1)[0].as_py()
            starts, x = runs_of(batch, columns), _values(batch, value)
            for k in {0, len(starts) - 1}:  # runs between are whole within this partition
                a, b = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else batch.num_rows
                key, made = _key(batch, columns, a), rule.fold(x[a:b])
                if k == 0 and last is not None and last[0] == key:
                    last[1] = _join(last[1], made)
                    if n == 1:
                        first = last
                else:
                    n += 1
                    last = [key, made]
                    first = first or last
        if first:
            yield pa.RecordBatch.from_pylist([{"p": p, "n": n, "edges": pickle.dumps((first, last))}])

    return run


def _carried(rule: Recursion, rows: DataFrame, columns: Sequence[int], value: int | None) -> dict[int, float | None]:
    """Value at the end of the partition before, for each partition that goes on with its last sequence."""
    got = sorted(tuple(r) for r in rows.mapInArrow(_edges(rule, columns, value), "p bigint, n bigint, edges binary").collect())
    out: dict[int, float | None] = {}
    before, end = None, None  # last key so far and y at its end
    for p, n, raw in got:
        (first_key, first_map), (last_key, last_map) = pickle.loads(raw)
        if before == first_key:
            out[p] = end
        start = end if before == first_key and n == 1 else None
        start = last_map[2] if start is None else start
        before, end = last_key, None if start is None else last_map[0] * start + last_map[1]
    return out


def _along(rule: Recursion, carried: dict[int, float | None], columns: Sequence[int], value: int | None, kind: pa.DataType, out: str):
    def partitions(batches):
        """Batches without the last column, which numbers the partition the rows were sorted in: the task that reads them may
        have another number (in a union) or read several of them."""
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            starts = np.flatnonzero(np.append(True, p[1:] != p[:-1])[: len(p)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(p)]):
                part = batch.slice(a, b - a)
                yield int(p[a]), pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])

    def run(batches):
        at = last = y = None
        begun = False
        for p, batch in partitions(batches):
            if p != at:
                at, last, y, begun = p, None, carried.get(p), p in carried
            starts, x = runs_of(batch, columns), _values(batch, value)
            ends = np.append(starts[1:], batch.num_rows)
            made = np.empty(batch.num_rows)
            whole = starts[1:] if _key(batch, columns, 0) == last or begun else starts
            begun = False
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                goes_on = k == 0 and len(whole) < len(starts)
                made[a:b] = rule.along(x[a:b], y if goes_on else (0.0 if rule.alpha is None else None))
            seen = made[ends[-1] - 1]
            y, last = None if np.isnan(seen) else float(seen), _key(batch, columns, int(starts[-1]))
            result = pa.array(made, from_pandas=True) if kind == pa.float64() else pa.array(made.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, out])

    return run


def _scan(df: DataFrame, rule: Recursion, keys: Names, order: Names, value: str | None, kind: T.DataType, arrow: pa.DataType, out: str) -> DataFrame:
    rows = in_ranges(df, keys, order, "_part")
    columns = [rows.columns.index(k) for k in keys]
    at = None if value is None else rows.columns.index(value)
    carried = _carried(rule, rows, columns, at)
    return rows.mapInArrow(_along(rule, carried, columns, at, arrow, out), T.StructType([*rows.schema.fields[:-1], T.StructField(out, kind)]))


def positions(df: DataFrame, keys: Names, order: Names, out: str = "pos") -> DataFrame:
    """Each row's place in its sequence, from 1."""
    return _scan(df, Recursion(None), keys, order, None, T.LongType(), pa.int64(), out)


def smoothed(df: DataFrame, keys: Names, order: Names, value: str, alpha: float, out: str) -> DataFrame:
    """y = alpha x + (1 - alpha) y before, from the first value on; a null value leaves y as it is."""
    return _scan(df, Recursion(alpha), keys, order, value, T.DoubleType(), pa.float64(), out)


def between(lower: Column, upper: Column, place: Column) -> Column:
    """Value at a fractional place between those at its floor and its ceiling."""
    return F.when(F.floor(place) == F.ceil(place), lower).otherwise((F.ceil(place) - place) * lower + (place - F.floor(place)) * upper)


def _same(df_keys: Names, prefix: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(df_keys):
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def quantiles(df: DataFrame, keys: Names, value: str, shares: dict[str, float], bound: int = 1_000_000) -> DataFrame:
    """Exact quantiles of each group (linear between neighbours): keys, ``n`` and a column for each share. Nulls and NaN are
    left out.

    Groups of up to ``bound`` rows (counted) are aggregated natively, where a group's distinct values are one task's state.
    Beyond, rows are ranked by ranges and the few needed are picked by rank, so no group's values meet in one task."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= bound:
        return rows.groupBy(*keys).agg(F.count("_v").alias("n"), *[F.percentile("_v", q).alias(c) for c, q in shares.items()])
    rows = positions(rows, keys, ["_v"], "_at")
    size = rows.groupBy(*keys).agg(F.max("_at").alias("n"))
    g = size.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n")
    place = {c: F.lit(q) * (F.col("n") - 1) + 1 for c, q in shares.items()}
    wanted = [p for c in shares for p in (F.floor(place[c]), F.ceil(place[c]))]
    picked = rows.join(g, _same(keys, "_k")).filter(F.col("_at").isin(*wanted))
    at = lambda p: F.max(F.when(F.col("_at") == p, F.col("_v")))
    found = picked.groupBy(*keys, "n").agg(*[F.struct(at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi")).alias(c) for c, p in place.items()])
    return found.select(*keys, "n", *[between(F.col(c)["lo"], F.col(c)["hi"], p).alias(c) for c, p in place.items()])


def with_quantiles(df: DataFrame, keys: Names, value: str, shares: dict[str, float], bound: int = 1_000_000) -> DataFrame:
    """``df`` with its group's quantiles beside each row (null for a group without values). ``df`` is read more than once;
    give it from a table or a checkpoint."""
    q = quantiles(df, keys, value, shares, bound)
    q = q.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], *shares)
    return df.join(q, _same(keys, "_q"), "left").drop(*[f"_q{i}" for i in range(len(keys))])


# --- windows that slide, in chunks ----------------------------------------------------------------------------------------


def centred_quantile(v: np.ndarray, half: int, q: float) -> np.ndarray:
    """Quantile of up to ``half`` values on either side, through one ordered window; NaN are left out."""
    from bisect import bisect_left, insort

    out, window, n = np.full(len(v), np.nan), [], len(v)
    x = v.tolist()
    for e in x[:half]:
        if e == e:
            insort(window, e)
    for i in range(n):
        if i + half < n and x[i + half] == x[i + half]:
            insort(window, x[i + half])
        if i > half and x[i - half - 1] == x[i - half - 1]:
            del window[bisect_left(window, x[i - half - 1])]
        if window:
            place = q * (len(window) - 1)
            lo = int(place)
            out[i] = window[lo] if lo == place else (lo + 1 - place) * window[lo] + (place - lo) * window[lo + 1]
    return out


def centred_mean(v: np.ndarray, half: int) -> np.ndarray:
    seen = ~np.isnan(v)
    total, count = (np.concatenate([[0.0], np.cumsum(c)]) for c in (np.where(seen, v, 0.0), seen.astype(float)))
    lo, hi = np.maximum(np.arange(len(v)) - half, 0), np.minimum(np.arange(len(v)) + half + 1, len(v))
    n = count[hi] - count[lo]
    return np.where(n > 0, (total[hi] - total[lo]) / np.maximum(n, 1), np.nan)


def in_chunks(df: DataFrame, keys: Names, index: str, values: Names, margin: int, fn: Callable[..., np.ndarray], out: str, chunk: int = 4096) -> DataFrame:
    """``df`` with ``fn(values…)`` beside each row, computed in chunks of ``chunk`` rows of a sequence that also see ``margin``
    rows on either side. ``index`` counts each sequence's rows without gaps, so the shuffle is by (keys, chunk)."""
    i = F.col(index)
    cell = lambda x: F.floor(x / chunk)
    dealt = df.withColumn("_own", cell(i)).withColumn("_chunk", F.explode(F.sequence(cell(i - margin), cell(i + margin))))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = df.columns

    def one(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(index)
        made = fn(*[pd.to_numeric(x[c], errors="coerce").to_numpy(float) for c in values])
        mine = (x["_own"] == x["_chunk"]).to_numpy()
        return x.loc[mine, names].assign(**{out: made[mine]})

    return dealt.groupBy(*keys, "_chunk").applyInPandas(one, schema)


def indexed(df: DataFrame, keys: Names, order: Names, dense: bool) -> tuple[DataFrame, str]:
    """The table with a column that counts each sequence's rows: the order's own where it does, else a rank."""
    return (df, order[0]) if dense else (positions(df, keys, order, "_at"), "_at")
