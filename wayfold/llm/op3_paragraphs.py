"""Substring dedup by paragraph MinHash banding.

Paragraphs of two sizes are taken from each text: lines, and the sentences within them, of five words and more. Equal
paragraphs share a content hash and are one row from then on, with the number of places they stand for. Each sends
``BANDS`` bands of ``ROWS`` minima over its 5-word shingles (recall 0.985 at a similarity of 0.8, 0.9995 at 0.9) if it has 8
distinct ones or more. At 8 and fewer a near partner holds the same set, or one shingle more or less: the hash of the
set goes out, and that of the set without its first and without its last shingle. Where a run of four words comes twice,
shingles repeat or can be read in another order; such a paragraph sends the set without each of its shingles instead, and
below 4 distinct ones (where only equal sets are near) the set alone.
``near_sets`` verifies exact Jaccard among the paragraphs of a band, whatever component they lie in.

Verified pairs join into components; a place is removable if the first line or the first sentence of its component
stands before it (document id, then position) and does not overlap it. Removable places that touch form a run; runs of
``RUN`` words and more are removed, so single repeated headings stay.

Hot lines: equal paragraphs combine in each task before they move, so a band sees each of them once; only the texts of
colliding paragraphs are read again.

Cases: null and empty texts have no paragraphs; rows without an id are left out; repeated rows remove each other's
text as copies do, except that rows equal in id and text do not count as repeats; a text of any length is handled whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .near_sets import SIMILARITY, WORDS, band_keys, near_edges, wanted
from .shared import LOWER, SPACE, Scratch, blocks, checked, code_points, mix, owner, prefix_hash, runs, shingles, span_hash, word_runs_hash

BANDS, ROWS, RUN = 8, 4, 20
TRIMMED, BANDED = 4, 8  # distinct shingles from which on a paragraph sends sets less one shingle, and bands
TAKEN = 1 + BANDED  # hashes of sets: of all shingles, and of all but one
_SET = np.uint64(0x7A11)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
PLACES = "doc_id bigint, line boolean, w0 int, w1 int, c0 int, c1 int, h bigint"


def paragraphs(data: np.ndarray, offsets: np.ndarray, with_bands: bool = True):
    """(text, is a line, first word, end word, hash, bands, has band, byte start, byte end, first word of its text, own line) of
    all paragraphs of a block; keys and the mask of those sent have ``BANDS + TAKEN`` columns. ``own`` is the row of the line that
    a sentence is near to as its greatest part, else -1."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    whose = owner(starts, offsets)
    words = span_hash(prefix_hash(low), starts, ends)
    n = len(words)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    new_line = np.ones(n, bool)
    new_line[1:] = (lines[starts[1:]] != lines[starts[:-1]]) | (whose[1:] != whose[:-1])
    new_sentence = new_line.copy()
    new_sentence[1:] |= _END[data[ends[:-1] - 1]]
    line, sentence = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
    line_end, sentence_end = np.append(line[1:], n), np.append(sentence[1:], n)
    several = np.searchsorted(sentence, line_end) - np.searchsorted(sentence, line) > 1  # a line of one sentence is that sentence
    b, e = np.concatenate([line[several], sentence]), np.concatenate([line_end[several], sentence_end])
    is_line = np.arange(len(b)) < several.sum()
    keep = e - b >= WORDS
    b, e, is_line = b[keep], e[keep], is_line[keep]
    if not len(b):
        return None
    order = np.argsort(b, kind="stable")
    b, e, is_line = b[order], e[order], is_line[order]
    h = word_runs_hash(words, b, e)
    bands, sent, own = np.zeros((len(b), BANDS + TAKEN), np.uint64), np.zeros((len(b), BANDS + TAKEN), bool), np.full(len(b), -1)
    if with_bands:
        width = e - b - WORDS + 1
        # windows of all positions; those that leave a paragraph fall between its end and the next start
        grams = np.zeros(n, np.uint64)
        made, at = shingles(words, whose, WORDS)
        grams[at] = made
        distinct, loops = width.copy(), np.zeros(len(b), bool)
        suspect = np.flatnonzero(_repeating(words, whose, np.cumsum(new_line))[b])
        if len(suspect):
            distinct[suspect] = _distinct(grams, b[suspect], width[suspect])
            loops[suspect] = True
        wide = distinct >= BANDED
        if wide.any():
            bb, ww = b[wide], width[wide]
            first = np.cumsum(ww) - ww
            values = grams[np.repeat(bb - first, ww) + np.arange(int(ww.sum()))]
            bands[wide, :BANDS] = band_keys(values, first, BANDS, ROWS)
            sent[wide, :BANDS] = True
        few = np.flatnonzero((distinct <= BANDED) & (distinct >= TRIMMED) & ~loops)
        mixed = mix(grams)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=total[1:])
        whole = total[b[few] + width[few]] - total[b[few]]
        for k, less in enumerate((np.uint64(0), mixed[b[few]], mixed[b[few] + width[few] - 1])):
            bands[few, BANDS + k] = mix((whole - less) ^ _SET)
            sent[few, BANDS + k] = True
        for r in np.flatnonzero(loops & (distinct <= BANDED)).tolist():
            each = mix(np.unique(grams[b[r] : b[r] + width[r]]))
            keys = mix((each.sum() - np.append(np.uint64(0), each)) ^ _SET)
            keys = keys[: None if len(each) >= TRIMMED else 1]
            bands[r, BANDS : BANDS + len(keys)] = keys
            sent[r, BANDS : BANDS + len(keys)] = True
        rows = np.flatnonzero(is_line)
        line = rows[np.maximum(np.searchsorted(b[rows], b, side="right") - 1, 0)] if len(rows) else np.zeros(len(b), np.int64)
        part = np.flatnonzero(~is_line & (b >= b[line]) & (e <= e[line]) & is_line[line] & (width >= SIMILARITY * width[line]) & (width >= TRIMMED))
        if len(part):
            a, wide_line = _distinct(grams, b[part], width[part]), _distinct(grams, b[line[part]], width[line[part]])
            part = part[a >= SIMILARITY * wide_line]
            own[part] = line[part]
    return whose[b], is_line, b, e, h, bands, sent, starts[b], ends[e - 1], np.searchsorted(whose, whose[b]), own


def _repeating(words: np.ndarray, whose: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Mask of the words whose line holds a run of WORDS - 1 words twice. Without one, a paragraph's shingles are distinct
    and in one order only: another text with the same set is the same text."""
    made, at = shingles(words, whose, WORDS - 1)
    at, made = at[line[at] == line[at + WORDS - 2]], made[line[at] == line[at + WORDS - 2]]
    key = np.sort(line[at].astype(np.uint64) << np.uint64(40) | made >> np.uint64(24))
    hit = np.zeros(int(line[-1]) + 1, bool)
    hit[(key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return hit[line]


def _distinct(grams: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distinct shingles of each paragraph."""
    row = np.repeat(np.arange(len(begin)), width)
    index = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    both = np.unique(row.astype(np.uint64) << np.uint64(44) | grams[index] >> np.uint64(20))
    return np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=len(begin))


def _place_rows(batches):
    """Where each paragraph stands, in words and code points of its text."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            got = paragraphs(data, offsets, False)
            if got is None:
                continue
            text, is_line, b, e, h, _, _, s, t, first, _ = got
            points = code_points(data)
            base = points[offsets[:-1]][text]
            whole = lambda x: pa.array(x.astype(np.int32))
            arrays = [part.column(0).take(pa.array(text)), pa.array(is_line), whole(b - first), whole(e - first), whole(points[s] - base), whole(points[t] - base), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PLACES.split(", ")])


_BAND_NAMES = [f"b{k}" for k in range(BANDS + TAKEN)]


def _band_rows(batches):
    """(h, n, own, bands) of the paragraphs that may have near partners, each once a block with its number of places; own
    is the hash of a line that a sentence is near to as a part of it."""
    for batch in batches:
        for _, data, offsets in blocks(batch, "text", 1 << 20):
            got = paragraphs(data, offsets)
            if got is None:
                continue
            _, _, _, _, h, bands, sent, *_, line = got
            at = np.flatnonzero(sent.any(axis=1))
            each, first, n = np.unique(h[at], return_index=True, return_counts=True)
            at = at[first]
            columns = [pa.array(bands[at, k].view(np.int64), mask=~sent[at, k]) for k in range(BANDS + TAKEN)]
            own = pa.array(h[line[at]].view(np.int64), mask=line[at] < 0)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n), own, *columns], names=["h", "n", "own", *_BAND_NAMES])


def _body_rows(hits: np.ndarray):
    """(h, body) of the paragraphs that may be wanted; each once a block."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch, "text", 1 << 20):
                got = paragraphs(data, offsets, False)
                if got is None:
                    continue
                _, _, b, e, h, _, _, s, t, *_ = got
                h, keep = h.view(np.int64), e - b > WORDS  # of two with equal sets one at least is longer than a shingle
                at = np.flatnonzero(keep & wanted(hits, h))
                at = at[np.unique(h[at], return_index=True)[1]]
                raw = LOWER[data]
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array([raw[x:y].tobytes() for x, y in zip(s[at].tolist(), t[at].tolist())], pa.binary())], names=["h", "body"])

    return run


def near_pairs(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text) to verified pairs (a, b) of content hashes, whose components hold all near paragraphs that met."""
    row = "h bigint, n bigint, own bigint, " + ", ".join(f"{b} bigint" for b in _BAND_NAMES)

    def members() -> DataFrame:
        known = rows.mapInArrow(_band_rows, row).groupBy("h").agg(F.sum("n").alias("n"), F.max("own").alias("own"), *[F.max(b).alias(b) for b in _BAND_NAMES])
        as_row = lambda key, own: F.struct(key.alias("key"), own.alias("own"))
        none = F.lit(None).cast("bigint")
        each = F.array(*[F.when(F.col(b).isNotNull(), as_row(F.col(b), none)) for b in _BAND_NAMES], F.when(F.col("own").isNotNull(), as_row(F.col("h"), F.col("own"))))
        return known.select("h", "n", F.explode(F.array_compact(each)).alias("x")).select("x.key", "h", "n", "x.own")

    return near_edges(members, lambda hits: rows.mapInArrow(_body_rows(hits), "h bigint, body binary"), similarity)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, end, n_words, kept_doc_id): removable runs in code points, and a document that keeps the passage."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    roots = components(near_pairs(rows, similarity))
    places = scratch.table("places", rows.mapInArrow(_place_rows, PLACES))
    at = F.struct("doc_id", "w0", "w1")
    known = places.groupBy("h").agg(F.min(F.when(F.col("line"), at)).alias("line"), F.min(F.when(~F.col("line"), at)).alias("sentence"), F.min(at).alias("first"), F.max(at).alias("last"))
    classed = known.join(roots, F.col("h") == F.col("node"), "left").select("h", "line", "sentence", "first", "last", F.coalesce("root", "h").alias("class"))
    heads = classed.groupBy("class").agg(*[F.min(c).alias(c) for c in ("line", "sentence", "first")], F.max("last").alias("last")).filter("first <> last")
    heads = heads.select(F.col("class").alias("c"), F.col("line").alias("line_head"), F.col("sentence").alias("sentence_head"))
    multi = checked(classed.join(heads, F.col("class") == F.col("c")).select(F.col("h").alias("g"), "line_head", "sentence_head"), 100_000)
    here = F.struct("doc_id", "w0")

    def earlier(head: str):
        """The head's document, where the head stands before this place and does not overlap it."""
        h = F.col(head)
        before = F.struct(h["doc_id"].alias("doc_id"), h["w0"].alias("w0")) < here
        return F.when(h.isNotNull() & before & ((h["doc_id"] != F.col("doc_id")) | (h["w1"] <= F.col("w0"))), h["doc_id"])

    extra = places.join(multi, F.col("h") == F.col("g")).select("doc_id", "w0", "w1", "c0", "c1", F.least(earlier("line_head"), earlier("sentence_head")).alias("k")).filter("k is not null")
    by_doc = Window.partitionBy("doc_id").orderBy("w0", F.desc("w1"))
    before = F.max("w1").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = extra.withColumn("new", (before.isNull() | (F.col("w0") > before)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc_id", "island").agg(F.min("c0").alias("start"), F.max("c1").alias("end"), (F.max("w1") - F.min("w0")).alias("n_words"), F.min("k").alias("kept_doc_id"))
    return out.filter(F.col("n_words") >= run_words).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("n_words").cast("bigint").alias("n_words"), "kept_doc_id")


def op3_repeated_paragraphs(docs: DataFrame) -> DataFrame:
    return repeated_runs(docs)
