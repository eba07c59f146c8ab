"""Fill-in-middle transformation with a sparse checkpoint index.

A text is read once, a piece of 64 KiB at a time, to count its units (a word with the white space before it, or closing
white space); every ``every`` units the byte and code-point offset is noted. A cut is found by binary search in these
checkpoints and a rescan of at most ``every`` units, so memory beside the text is one checkpoint for some three thousand
bytes, however long it is. Cuts, form and order follow from the sha256 of seed and id alone: a lost task gives the same
rows again. Rows are independent; nothing is shuffled.

Cases: a null text counts as empty and stays plain; a null id hashes as the empty text; repeated rows come out alike;
texts that hold a marker stay plain, so every output can be taken apart again (``restored``); an empty table gives no
rows; all columns of ``docs`` pass through, and the new struct takes a name they do not use.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, blocks, free_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EVERY, PIECE, WINDOW = 512, 1 << 16, 1 << 12
SHAPE = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))])


def _ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ends of units in (lo, hi]; white space at the end of the text closes one too."""
    word = ~SPACE[data[lo : hi + 1]]
    after = np.append(word[1:], False)[: hi - lo]
    at = np.flatnonzero(word[: hi - lo] & ~after) + lo + 1
    return np.append(at, hi) if hi == len(data) and hi and SPACE[data[-1]] else at


def _points(data: np.ndarray, lo: int, hi: int) -> int:
    """Code points that begin in [lo, hi)."""
    return int(np.count_nonzero((data[lo:hi] & 0xC0) != 0x80))


class Checkpoints:
    """Number of units of a text, and (units, bytes, code points) at every ``every``-th of them."""

    def __init__(self, data: np.ndarray, every: int = EVERY, piece: int = PIECE):
        self.units, self.bytes, self.points, self.n, self.data = [0], [0], [0], 0, data
        read = points = 0
        for lo in range(0, len(data), piece):
            ends = _ends(data, lo, min(lo + piece, len(data)))
            for at in ends[(-self.n - 1) % every :: every].tolist():
                points += _points(data, read, at)
                read = at
                self.units.append(self.units[-1] + every)
                self.bytes.append(at)
                self.points.append(points)
            self.n += len(ends)

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first ``unit`` units."""
        mark = bisect_right(self.units, unit) - 1
        at, left = self.bytes[mark], unit - self.units[mark]
        lo = at
        while left:
            hi = min(lo + WINDOW, len(self.data))
            ends = _ends(self.data, lo, hi)
            if len(ends) >= left:
                at, left = int(ends[left - 1]), 0
            else:
                left -= len(ends)
            lo = hi
        return at, self.points[mark] + _points(self.data, self.bytes[mark], at)


def _transformed(data: np.ndarray, name: str, seed: int, rate: int, spm: int, every: int) -> tuple:
    marks, text = Checkpoints(data, every), data.tobytes()
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or p in text or s in text or m in text or c % 100 >= rate:
        return marks.n, "plain", None, None, text
    (one, before), (two, upto) = (marks.locate(u) for u in sorted((a % (marks.n + 1), b % (marks.n + 1))))
    head, body, tail = text[:one], text[one:two], text[two:]
    form, out = ("spm", s + tail + p + head + m + body) if d % 100 < spm else ("psm", p + head + s + tail + m + body)
    return marks.n, form, before, upto - before, out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, every: int = EVERY, out: str = "fim") -> DataFrame:
    """All columns of ``docs`` and a struct (n, form, prefix_chars, middle_chars, output): of ``rate`` percent of the texts
    the middle moves to the end, ``spm`` percent of these with the suffix first. The struct is the last column, named
    ``out`` or, where that is taken, the next free name."""
    out = free_name(docs, out)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part, data, at in blocks(batch.rename_columns(names), f"c{text_at}"):
                ids = pc.fill_null(part.column(id_at).cast(pa.string()), "").to_pylist()
                got = [_transformed(data[at[k] : at[k + 1]], ids[k], seed, rate, spm, every) for k in range(len(ids))]
                n, form, before, middle, output = zip(*got)
                parts = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(parts, SHAPE.names)], names=[*batch.schema.names, out])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(out, SHAPE)]))


def restored(output: Column, form: Column) -> Column:
    """The text again: the outer parts stand between markers, and a marker's first place is its own."""

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, third, 1)
        return one, two, F.substring(rest, F.length(two) + len(third) + 1, F.length(rest))

    head, tail, middle = parts(PREFIX, SUFFIX, MIDDLE)
    tail2, head2, middle2 = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(head2, middle2, tail2)).otherwise(output)


def op12_fill_in_middle(docs: DataFrame) -> DataFrame:
    f = F.col("fim")
    done = fill_in_middle(docs.select("doc_id", "text"))
    back = restored(f["output"], f["form"])
    return done.select("doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS share, CAST('0x' || h[25:32] AS BIGINT) % 100 AS o FROM t),
d AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR share >= 50 THEN 'plain' WHEN o < 80 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM d"""
