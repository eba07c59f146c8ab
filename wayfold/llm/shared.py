"""Helpers every operator of this subpackage shares: checkpoints, texts as bytes, words as numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SMALL = np.arange(0x800)
for _c in range(0x80, 0x800):
    if len(_l := chr(_c).lower()) == 1 and 0x80 <= ord(_l) < 0x800:
        _SMALL[_c] = ord(_l)

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one in local mode; on a
    cluster, whose executors could not read it, an error."""
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get()
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wayfold-")
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in a table in the shared folder: a lost executor costs nothing, and plans see true sizes.

    (A row checkpoint keeps its plan's estimated size; in loops of joins these estimates multiply without bound.)"""
    return _written(df, f"{checkpoint_root(df.sparkSession)}/wayfold-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    if not _MADE:
        atexit.register(_forget, spark)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession) -> None:
    """At the end of the program the intermediate tables go."""
    with contextlib.suppress(Exception):
        for path in _MADE:
            _delete(spark, path)


class Scratch:
    """Parquet tables in the shared folder, for intermediate results too wide for a row checkpoint."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/wayfold-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles of finished steps nobody refers to any more, so their disk is freed. What
    Python lets go reaches the JVM a little later, hence more than one turn."""
    for _ in range(3):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def few(df: DataFrame, rows: int, per: int = 50_000) -> DataFrame:
    """What a shuffle deals out, in tasks of ``per`` rows at least: small tables do not pay for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // per)))


def checked(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """A narrow table, written and counted: marked for broadcast up to ``bound`` rows, joined by shuffle beyond."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= bound else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as a column of the table bears it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo: the split that contracts name. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch whose texts hold about ``limit`` bytes (one text at least): (slice, bytes, offsets)."""
    data, at = texts_of(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower_letters(data: np.ndarray) -> np.ndarray:
    """Lower case for one- and two-byte code points (Latin, Greek, Cyrillic, …); lengths stay."""
    out = LOWER[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
    code = _SMALL[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
    out[lead], out[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true, broken at text borders."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(inside)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text each position lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit hashes here."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span's hash off it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(tokens: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens within one text, and the first token of each."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ tokens[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(owners[:n] == owners[k - 1 :])
    return mix(h[at]), at


def joined_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes with one space after each word; word starts and ends in them, and the text of each word."""
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    whose = owner(starts, offsets)
    lengths = ends - starts
    new_start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(starts) else starts
    keep = np.zeros(int(lengths.sum()) + len(starts), np.uint8)
    keep[:] = 32
    inside = ~SPACE[data]
    target = np.ones(len(keep), bool)
    target[new_start + lengths] = False
    keep[target] = data[inside]
    return keep, new_start, new_start + lengths, whose


def word_runs_hash(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words begin..end of each paragraph."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
