"""Benchmark decontamination by template canonicalisation.

Words are maximal runs of letters, digits and bytes beyond ASCII (a point or comma between digits belongs to the
number). Numbers, units and names (capitalised words inside a sentence) become typed placeholders, so a question
asked again with other values keeps its template. Windows of five placeholder-or-word tokens are hashed; windows with
fewer than two plain words are no evidence and stay out of the index. Texts are read once: those windows that hit an
index of at most ``BOUND`` benchmark windows leave the scan, with position and slot values; a larger benchmark sends
every window through a shuffled hash join instead. Hits meet the benchmark windows in a join on the hash, are counted
along diagonals (text position less item position) and, per diagonal, each slot value of the item must stand for one
value in the text (two of its values may have become equal); windows of inconsistent diagonals do not count. A text is reported for an item when 0.8 or more of the item's
indexed windows are found.

Cases: rows and items with a null id are left out, as nothing could name them; null and empty texts have no windows; an item with fewer than five words, or none indexed, matches nothing;
repeated rows are reported each under their id once; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, cut, lower_letters, owner, prefix_hash, runs, shingles, span_hash

WINDOW, SIMILARITY, BOUND = 5, 0.8, 1_000_000
#: Words taken as units of measure.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees kmh mph kw w watt watts volt volts".split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA1, 0xB2, 0xC3))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_BREAK = np.ones(256, bool)  # after these bytes a capital begins a sentence; blanks are looked through
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 44, 45, 39]] = False


def _hash_words(words) -> np.ndarray:
    data = " ".join(words).encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends = runs(raw != 32, np.array([0, len(raw)]))
    return np.sort(span_hash(prefix_hash(raw), starts, ends))


_UNIT_HASHES = _hash_words(UNITS)


def canonical(data: np.ndarray, offsets: np.ndarray):
    """(token hashes with placeholders, value hash of each token, is slot, text of each token)."""
    word = _WORD[data]
    if len(data) > 2:
        word[1:-1] |= _POINT[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    starts, ends = runs(word, offsets)
    whose = owner(starts, offsets)
    low = lower_letters(data)
    value = span_hash(prefix_hash(low), starts, ends)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data] | (_POINT[data] & word), out=digits[1:])
    number = digits[ends] - digits[starts] == ends - starts
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = np.zeros(len(starts), bool)
    unit[1:] = (_UNIT_HASHES[at[1:]] == value[1:]) & number[:-1] & (whose[1:] == whose[:-1])
    # a name: capital, then small letters, and only blanks since a word or comma of the same text
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    capital = (head >= 65) & (head <= 90) & (ends - starts > 1)
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_BREAK[data] & (data != 32), out=stops[1:])
    quiet = np.zeros(len(starts), bool)
    quiet[1:] = (stops[starts[1:]] == stops[ends[:-1]]) & (whose[1:] == whose[:-1])
    second = np.zeros(len(starts), np.uint8)
    long = ends - starts > 1
    second[long] = data[starts[long] + 1]
    name = capital & quiet & ((second >= 97) & (second <= 122))
    tokens = value.copy()
    tokens[number], tokens[unit], tokens[name & ~unit] = NUMBER, UNIT, NAME
    return tokens, value, number | unit | name, whose


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW):
    """(window hash, position in its text, text, slot mask bits, slot values [n, size]) of the evidence windows."""
    tokens, value, slot, whose = canonical(data, offsets)
    h, at = shingles(tokens, whose, size)
    if not len(h):
        empty = np.zeros(0, np.int64)
        return h, empty, empty, empty, np.zeros((0, size), np.uint64)
    plain = np.zeros(len(at), np.int64)
    mask = np.zeros(len(at), np.int64)
    for k in range(size):
        plain += ~slot[at + k]
        mask |= slot[at + k].astype(np.int64) << k
    keep = plain >= 2
    h, at, mask = h[keep], at[keep], mask[keep]
    first = np.searchsorted(whose, whose[at])
    values = np.stack([np.where(slot[at + k], value[at + k], np.uint64(0)) for k in range(size)], axis=1)
    return h, at - first, whose[at], mask, values


SCHEMA = "id bigint, h bigint, pos int, slots array<bigint>"


def _window_rows(known: np.ndarray | None, size: int):
    table = None
    if known is not None:
        table = np.zeros(1 << 22, bool)
        table[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                h, pos, text, _, values = windows(data, offsets, size)
                if known is not None:
                    maybe = np.flatnonzero(table[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(known, h[maybe]), max(len(known) - 1, 0))
                    hit = maybe[known[place] == h[maybe]] if len(known) else maybe[:0]
                    h, pos, text, values = h[hit], pos[hit], text[hit], values[hit]
                ids = part.column(0).take(pa.array(text))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * size, pa.int32()), pa.array(values.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(pos, pa.int32()), rows], names=["id", "h", "pos", "slots"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, similarity: float = SIMILARITY, bound: int = BOUND) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_changed, similarity): texts that hold an item, its values changed or not."""
    pick = lambda df, i, t: df.select(F.col(i).cast("bigint").alias("id"), F.col(t).cast("string").alias("text"))
    items = cut(pick(benchmark, item_col, item_text).filter("id is not null").mapInArrow(_window_rows(None, size), SCHEMA))
    rows = pick(docs, id_col, text_col)
    if items.select("h").distinct().count() <= bound:
        got = items.select("h").distinct().toPandas()["h"].to_numpy(np.int64)
        hits = rows.mapInArrow(_window_rows(np.sort(got.view(np.uint64)), size), SCHEMA)
    else:
        hits = rows.mapInArrow(_window_rows(None, size), SCHEMA)
    total = items.groupBy("id").agg(F.countDistinct("h").alias("n_windows"))
    i = items.select(F.col("id").alias("item_id"), "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    both = hits.filter("id is not null").join(i, "h").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    both = both.groupBy("id", "item_id", "diagonal", "item_pos", "h", "item_slots", "slots").agg(F.lit(1).alias("x")).drop("x")
    both = cut(both)
    key = ["id", "item_id", "diagonal"]
    pair = both.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).select(*key, F.col("z.item_slots").alias("a"), F.col("z.slots").alias("b")).filter("a <> 0").distinct()
    # a function of the item's values: as many pairs as there are of these
    clean = pair.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("a").alias("na"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))
    kept = both.join(clean, key, "left").filter("n is null or n = na")
    found = kept.groupBy("id", "item_id").agg(F.countDistinct("h").alias("n_found"), F.coalesce(F.max("n_changed"), F.lit(0)).cast("bigint").alias("n_changed"))
    out = found.join(total.withColumnRenamed("id", "t"), F.col("item_id") == F.col("t"))
    out = out.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "n_found", "n_changed", (F.col("n_found") / F.col("n_windows")).alias("similarity"))
    return out.filter(F.col("similarity") >= similarity)


def op2_benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).withColumn("similarity", F.round("similarity", 6))
