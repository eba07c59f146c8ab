"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier is removed.

1. Each 100-byte window belongs to its least 48-byte gram (a minimizer); windows in a row with one minimizer form a
   segment. Equal windows have equal minimizers at equal offsets, so a repeat can only lie between segments of one key,
   and a key that occurs once holds none. Keys are compared as narrow rows (key, document, start), without text.
   Of equal segments within a block of the scan only the least place goes on; the others are removable at once.
2. Segments of keys that occur again fetch their bytes by document and move to their key's partition. Equal segments are
   one entry there with its least place; the other places go whole.
3. Keys with several different segments are gathered into shards, and each shard is sorted by external induced sorting
   (``induced``): disk-backed queues carry suffixes and common prefixes. Neighbours with a common prefix of 100 form a
   group; all but the least place of a group are removed.
4. Removed runs are merged per document and cut out of its bytes.

Documents with equal texts are found first by digest, so that a hot group of copies is one document in steps 1 to 3; a
copy's windows all start earlier elsewhere. A passage that very many documents share sends a row a block, not a document.

Order of places: document id (null first), then, among different texts under one id (several null ids included), their
digest, then start. Cases: null and empty texts keep nothing and remove nothing; rows equal in id and text are the same
place and do not remove each other; rows with one id and several texts are several documents; a text of any length is
handled; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import suffix_order
from .shared import Scratch, blocks, checked, cut, mix, prefix_hash, release, span_hash

LENGTH, GRAM, SHARD, MEMORY = 100, 48, 1 << 20, 32 << 20
_LOW = np.uint64((1 << 28) - 1)
_NULL = -(1 << 63)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, first window, number of windows, key) of the minimizer segments of a block."""
    n = len(data) - gram + 1
    if n <= 0 or len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    at = np.arange(n)
    hashes = span_hash(prefix_hash(data), at, at + gram)
    # leftmost least gram of each window: hash above, position below, minima over doubling widths
    best = (hashes & ~_LOW) | at.astype(np.uint64)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = span - width
    if rest:
        best = np.minimum(best[:-rest], best[rest:])
    spot = (best & _LOW).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(spot)), side="right") - 1
    whole = np.arange(len(spot)) + length <= offsets[text + 1]
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    group = np.cumsum(new) - 1
    count = np.bincount(group[whole], minlength=int(group[-1]) + 1)[group[begin]]
    return text[begin], begin - offsets[text[begin]], count, hashes[spot[begin]].view(np.int64)


NARROW = "key bigint, id bigint, u bigint, at int, n int, gone boolean"
_NARROW = [x.split()[0] for x in NARROW.split(", ")]


def _segment_rows(batches):
    """Segments of documents (id, u, text); ``gone`` are those whose bytes stand at an earlier place of the block too, under
    keys that spread them."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            text, begin, count, key = segments(data, offsets)
            ids, us = (part.column(k).to_numpy()[text] for k in range(2))
            start = offsets[text] + begin
            body = span_hash(prefix_hash(data), start, start + count + LENGTH - 1)
            order = np.lexsort((begin, us, ids, body))
            again = np.zeros(len(body), bool)
            place = np.stack([ids, us, begin], 1)[order] if len(body) else np.zeros((0, 3), np.int64)
            same = body[order[1:]] == body[order[:-1]]
            # rows equal in id and text repeat a place, and do not remove each other
            least = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(body)), 0)) if len(body) else order
            again[order] = (place != place[least]).any(axis=1)
            twice = np.zeros(len(body), bool)
            twice[order[1:]] = same & (place[1:] == place[:-1]).all(axis=1)
            twice &= ~again
            key = np.where(again, mix((ids.astype(np.uint64) << np.uint64(20)) ^ start.astype(np.uint64)).view(np.int64), key)
            columns = [key, ids, us, begin.astype(np.int32), count.astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(x[~twice]) for x in columns], names=_NARROW)


def _again(batches):
    """Rows sorted by key: those whose key the row before or after has too, and all that are gone. One row of state."""
    held = last = None  # held: the last row, if its key is new so far
    for batch in batches:
        gone = batch.column(5)
        if pc.any(gone).as_py():
            yield batch.filter(gone)
            batch = batch.filter(pc.invert(gone))
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        same = np.concatenate([[last is not None and key[0] == last], key[1:] == key[:-1]])
        if held is not None and same[0]:
            yield held
        keep = same.copy()
        keep[:-1] |= same[1:]
        yield batch.filter(pa.array(keep))
        last = key[-1]
        held = None if keep[-1] else pa.RecordBatch.from_arrays(batch.slice(len(key) - 1).columns, names=_NARROW)


def _body_rows(batches):
    """Documents with their segment lists to (key, id, u, at, body)."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            lists = part.column(3)
            flat = lists.flatten()
            at, count, key = (flat.field(k).to_numpy() for k in range(3))
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            begin = offsets[owner] + at
            raw = data.tobytes()
            for a in range(0, len(at), 20_000):
                piece = slice(a, a + 20_000)
                bodies = [raw[x : x + n + LENGTH - 1] for x, n in zip(begin[piece].tolist(), count[piece].tolist())]
                who = pa.array(owner[piece])
                yield pa.RecordBatch.from_arrays([pa.array(key[piece]), part.column(0).take(who), part.column(1).take(who), pa.array(at[piece]), pa.array(bodies, pa.binary())], names=["key", "id", "u", "at", "body"])


def later_windows(bodies: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the windows that stand at an earlier place in the shard too, by suffix order; ``ids`` number the
    documents in their order."""
    sizes = np.array([len(b) for b in bodies])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int(sizes.sum()) + len(bodies) + 1, np.uint16)  # 1 between segments, 0 at the end
    index = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))
    text[index] = raw.astype(np.uint16) + 2
    text[-1] = 0
    order, lcp, _ = suffix_order(text, length, memory)
    segment = np.searchsorted(begin, order, side="right") - 1
    segment = np.maximum(segment, 0)
    window = order - begin[segment]
    whole = (window >= 0) & (window + length <= sizes[segment]) & (order < len(text) - 1)
    # a group is a run with common prefixes of `length`; windows cut short by a separator never have one
    group = np.cumsum(lcp < length)
    group, segment, window = group[whole], segment[whole], window[whole]
    rank = np.lexsort((starts[segment] + window, ids[segment], group))
    group, segment, window = group[rank], segment[rank], window[rank]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    least = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    place = lambda i: (ids[segment[i]], starts[segment[i]] + window[i])
    a, b = place(np.arange(len(group))), place(least)
    later = (a[0] != b[0]) | (a[1] != b[1])
    return segment[later], window[later]


RANGES = "id bigint, u bigint, a bigint, b bigint"


def _removed_rows(batches):
    """Segments sorted by key and place to removed byte ranges (id, u, a, b)."""
    entries: dict[bytes, tuple[int, int, int]] = {}  # of one key: least place of each distinct segment
    shard: list[tuple[bytes, tuple[int, int, int]]] = []
    size, last = 0, None
    found: list[tuple[int, int, int, int]] = []

    def rows(x):
        columns = list(zip(*x)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "u", "a", "b"])

    def flush_key():
        nonlocal size
        if len(entries) > 1:
            for body, place in entries.items():
                shard.append((body, place))
                size += len(body)
        entries.clear()

    def sort_shard():
        nonlocal size
        documents = sorted({p[:2] for _, p in shard})
        number = {d: k for k, d in enumerate(documents)}
        who, at = np.array([number[p[:2]] for _, p in shard]), np.array([p[2] for _, p in shard], np.int64)
        segment, window = later_windows([b for b, _ in shard], who, at)
        order = np.lexsort((window, segment))
        segment, window = segment[order], window[order]
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(segment)) - 1
        shard.clear()
        size = 0
        a, b = at[segment[first]] + window[first], at[segment[first]] + window[final] + LENGTH
        yield rows([(*documents[w], x, y) for w, x, y in zip(who[segment[first]].tolist(), a.tolist(), b.tolist())])

    for batch in batches:
        for key, i, u, at, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if key != last:
                flush_key()
                last = key
                if size >= SHARD:
                    yield from sort_shard()
            if body not in entries:  # rows of a key come by place: the first is the least
                entries[body] = (i, u, at)
            elif entries[body] != (i, u, at):
                found.append((i, u, at, at + len(body)))
        if found:
            yield rows(found)
            found = []
    flush_key()
    if shard:
        yield from sort_shard()


def _kept_rows(keep_bytes: bool):
    """(id, text, whole, list of ranges) to the result row, with the kept bytes if asked for."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                yield kept_row(part, data, offsets)

    def kept_row(part, data, offsets):
        out: list[list] = [[], [], [], [], []]
        whole, ranges = part.column(2).to_pylist(), part.column(3).to_pylist()
        for k in range(part.num_rows):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            cuts: list[list[int]] = []
            if whole[k] and len(text) >= LENGTH:
                cuts = [[0, len(text)]]
            else:
                for r in sorted((x["a"], x["b"]) for x in ranges[k] or ()):
                    if cuts and r[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], r[1])
                    else:
                        cuts.append([*r])
            kept, at = [], 0
            for a, b in cuts:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            body = b"".join(kept)
            for c, v in zip(out, (len(text), len(text) - len(body), len(cuts), hashlib.sha256(body).hexdigest(), body if keep_bytes else None)):
                c.append(v)
        arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row for each input row; ``kept`` is binary.

    What one step hands to the next is a table in the shared folder, so the shuffles behind it can go."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL)).alias("id"), text.alias("text"))
    digest = F.sha2("text", 256)
    digests = cut(plain.filter(F.octet_length("text") >= LENGTH).select("id", digest.alias("d")).distinct())
    # different texts under one id are told apart by their digest
    shared = checked(digests.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("s")), 100_000)
    number = lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("bigint") + 1
    # texts too short for a window hold no repeat, and must not meet the ranges of another text under their id
    own = F.when(F.octet_length("text") < LENGTH, -1).when(F.col("s").isNotNull(), number(digest)).otherwise(0)
    rows = plain.join(shared, F.col("id") == F.col("s"), "left").select("id", own.alias("u"), "text")
    # exact copies: of each digest the least id stays in play
    least = digests.groupBy("d").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).filter("i0 <> i1").select(F.col("d").alias("e"), "i0")
    copies = checked(digests.join(least, F.col("d") == F.col("e")).filter("id <> i0").select(F.col("id").alias("c"), "d"), 100_000)
    same = (F.col("id") == F.col("c")) & (digest == F.col("d"))
    played = rows.join(copies, same, "left_anti")
    narrow = played.mapInArrow(_segment_rows, NARROW)
    again = scratch.table("again", narrow.repartition("key").sortWithinPartitions("key").mapInArrow(_again, NARROW))
    del narrow
    release(spark)
    wanted = again.filter("not gone").groupBy(F.col("id").alias("w"), F.col("u").alias("v")).agg(F.collect_list(F.struct("at", "n", "key")).alias("parts"))
    with_text = played.join(wanted, (F.col("id") == F.col("w")) & (F.col("u") == F.col("v"))).select("id", "u", "text", "parts")
    bodies = with_text.mapInArrow(_body_rows, "key bigint, id bigint, u bigint, at int, body binary")
    ranges = bodies.repartition("key").sortWithinPartitions("key", "id", "u", "at").mapInArrow(_removed_rows, RANGES)
    at_once = again.filter("gone").select("id", "u", F.col("at").cast("bigint").alias("a"), (F.col("at") + F.col("n") + LENGTH - 1).cast("bigint").alias("b"))
    merged = ranges.union(at_once).groupBy(F.col("id").alias("r"), F.col("u").alias("v")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    merged = scratch.table("ranges", merged)
    del wanted, with_text, bodies, ranges
    scratch.drop("again")
    release(spark)
    all_rows = rows.join(copies, same, "left").join(merged, (F.col("id") == F.col("r")) & (F.col("u") == F.col("v")), "left")
    ready = all_rows.select("id", "text", F.col("c").isNotNull().alias("whole"), "ranges")
    made = ready.mapInArrow(_kept_rows(keep_bytes), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return made.select(F.nullif("id", F.lit(_NULL)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, keep_bytes=False).drop("kept")
