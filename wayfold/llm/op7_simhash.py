"""SimHash near-duplicates through a Gray-order hierarchical index.

Texts become 64-bit fingerprints of their 3-word shingles; equal fingerprints meet in one row first, so exact copies
cost nothing later. Two fingerprints at 3 or fewer differing bits agree in one of four 16-bit fields, so each goes to
the index four times, rotated so that the field leads; a field's value over ``LIMIT`` rows is dealt again by the same
argument over four parts of the other 48 bits (the table of such values has at most 4 * 65536 rows, which bounds its
broadcast). A task holds a share of these values, each whole, and builds an index over all its entries of a field, in ranges
of about ``RANGE``: entries are sorted by Gray rank, so that neighbours share long bit patterns; a node keeps the
bits all its entries share, less those already kept above it. A batch of queries goes down the hierarchy together,
adding up differences, and leaves a group once its field differs or the differences exceed 3. Entries reached are taken
out of the index and asked in their turn, so that a dense group costs edges in proportion to its size, never all pairs.
The edges of all tasks join in ``components``.

``near_copies`` applies fingerprints to whole texts at a Jaccard similarity of 0.8 over 5-word shingles: 64 bits cannot
reach that far (near texts differ in about 10 bits there), so what fingerprints link is verified, and MinHash bands give
the other candidates.

Cases: null and empty texts have fingerprint zero and link like others; fewer than three words give one shingle; rows
with equal texts share a component; a null id is never the smallest unless alone; a text of any length is handled whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .near_sets import SIMILARITY, WORDS, band_keys, near_edges, wanted
from .shared import blocks, cut, few, joined_words, prefix_hash, shingles, span_hash, word_runs_hash

LIMIT, FAN, RANGE, BATCH, BITS = 4096, 16, 100_000, 1024, 3
COPY_BANDS, COPY_ROWS = 10, 3  # recall 0.999 at a similarity of 0.8


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    n_texts = len(offsets) - 1
    text, starts, ends, whose = joined_words(data, offsets)
    counts = np.bincount(whose, minlength=n_texts)
    last = np.cumsum(counts)
    where = np.arange(len(starts))
    end_word = np.minimum(where + 2, last[whose] - 1) if len(starts) else where
    first_of = last - counts
    use = (where + 2 < last[whose]) | (where == first_of[whose]) if len(starts) else np.zeros(0, bool)
    s, e, whose = starts[use], ends[end_word[use]], whose[use]
    view, digest = memoryview(text.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(s.tolist(), e.tolist())), np.uint64, len(s))
    out = np.zeros(n_texts, np.uint64)
    if len(hashes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        has, begin, number = np.unique(whose, return_index=True, return_counts=True)
        sums = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        ones = np.packbits(sums * 2 > number[:, None], axis=1, bitorder="little")
        out[has] = ones.copy().view(np.uint64).ravel()
    return out


def _fingerprint_rows(batches):
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            prints = fingerprints(data, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; ``levels`` from leaves to top: (value, residual mask, live leaves)."""

    def __init__(self, prints: np.ndarray):
        self.leaves = prints
        value, mask = prints, np.full(len(prints), ~np.uint64(0))
        live = np.ones(len(prints), np.int64)
        levels = [[value, mask, live]]
        while len(value) > FAN:
            cut_at = np.arange(0, len(value), FAN)
            every = np.bitwise_and.reduceat(mask, cut_at)
            both, some = np.bitwise_and.reduceat(value, cut_at), np.bitwise_or.reduceat(value, cut_at)
            shared = ~(both ^ some) & every
            levels[-1][1] = mask & ~np.repeat(shared, FAN)[: len(value)]  # what the node above keeps already goes
            value, mask, live = both & shared, shared, np.add.reduceat(live, cut_at)
            levels.append([value, mask, live])
        self.levels = levels

    def near(self, queries: np.ndarray, exact: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """(query, live leaf) at ``bits`` or fewer differences, none of them in the query's ``exact`` bits."""
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        total = np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            value, residual, live = self.levels[depth]
            unlike = (value[node] ^ queries[q]) & residual[node]
            total = total + np.bitwise_count(unlike)
            keep = np.flatnonzero((total <= bits) & (unlike & exact[q] == 0) & (live[node] > 0))
            q, node, total = q[keep], node[keep], total[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, total = np.repeat(q, FAN), np.repeat(total, FAN)
                inside = node < below
                if not inside.all():
                    q, node, total = q[inside], node[inside], total[inside]
        return q, node

    def drop(self, leaves: np.ndarray) -> None:
        for _, _, live in self.levels:
            np.subtract.at(live, leaves, 1)
            leaves = leaves // FAN


def forest(prints: np.ndarray, exact: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Edges (leaf, leaf) that span the links of a range: breadth first, in batches of queries in order of the entries."""
    index, waiting = GrayIndex(prints), np.zeros(0, np.int64)
    fresh, seed = np.ones(len(prints), bool), 0
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        ask, waiting = waiting[:batch], waiting[batch:]
        if not len(ask):
            while seed < len(prints) and not len(ask):
                part = np.arange(seed, min(seed + batch, len(prints)))
                ask, seed = part[fresh[part]], seed + batch
            if not len(ask):
                break
            fresh[ask] = False
        q, leaf = index.near(prints[ask], exact[ask])
        other = ask[q] != leaf
        q, leaf = ask[q[other]], leaf[other]
        # the queries are answered now, the entries they reached wait for their turn; neither is reached again
        reached = np.unique(leaf[fresh[leaf]])
        fresh[reached] = False
        gone = np.union1d(reached, ask)
        index.drop(gone[index.levels[0][2][gone] > 0])
        waiting = np.concatenate([waiting, reached])
        # of all (query, leaf) one edge a leaf, and one edge for each two queries that reached the same leaf
        order = np.lexsort((q, leaf))
        q, leaf = q[order], leaf[order]
        first = np.ones(len(leaf), bool)
        first[1:] = leaf[1:] != leaf[:-1]
        head = q[np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))] if len(q) else q
        pairs = np.unique(np.stack([head[~first], q[~first]], 1), axis=0) if len(q) else np.zeros((0, 2), np.int64)
        left += [leaf[first], pairs[:, 0]]
        right += [q[first], pairs[:, 1]]
    return np.concatenate(left), np.concatenate(right)


def _without(x: np.ndarray, at: int, width: int) -> np.ndarray:
    """The bits of x but for ``width`` of them from ``at`` on, closed up."""
    low = x & np.uint64((1 << at) - 1)
    return low | x >> np.uint64(at + width) << np.uint64(at) if at + width < 64 else low


def range_edges(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among entries (key, fingerprint) of whole keys. A key names the field, and for a heavy value the part of the
    other bits, that its links must agree in; each such choice has an index of its own, as entries of another choice would
    not be pruned, with those bits in front, so that Gray order keeps equal ones together."""
    choice = (keys >> 15) // 65536 * 8 + ((keys & 32767) >> 12)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(choice).tolist():
        field, part = c // 8, c % 8 - 1
        some = prints[choice == c]
        exact, rest = 0xFFFF << 16 * field, _without(some, 16 * field, 16)
        front = some >> np.uint64(16 * field) & np.uint64(0xFFFF)
        if part >= 0:
            span = range(12 * part, 12 * part + 12)
            exact |= sum(1 << (b if b < 16 * field else b + 16) for b in span)
            front = front << np.uint64(12) | rest >> np.uint64(12 * part) & np.uint64(4095)
            rest = _without(rest, 12 * part, 12)
        some = some[np.argsort(gray_rank(front << np.uint64(36 if part >= 0 else 48) | rest), kind="stable")]
        if len(some) > 1:
            a, b = forest(some, np.full(len(some), np.uint64(exact)))
            left.append(some[a].view(np.int64))
            right.append(some[b].view(np.int64))
    return np.concatenate(left), np.concatenate(right)


def _edges(batches):
    """Partitions sorted by key: whole keys go on as soon as ``RANGE`` rows are there."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def give(k, p):
        a, b = range_edges(k, p)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) >= RANGE and keys[0] != keys[-1]:
            n = int(np.searchsorted(keys, keys[-1]))
            yield give(keys[:n], prints[:n])
            keys, prints = keys[n:], prints[n:]
    if len(keys):
        yield give(keys, prints)


def print_edges(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) whose components are those of all links at 3 or fewer bits."""
    fields = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    rows = prints.select("fp", F.posexplode(F.array(*fields)).alias("field", "value")).select("fp", "field", "value", (F.col("field") * 65536 + F.col("value")).alias("bucket"))
    heavy = F.broadcast(rows.groupBy("bucket").count().filter(F.col("count") > LIMIT).select(F.col("bucket").alias("h")))
    marked = rows.join(heavy, F.col("bucket") == F.col("h"), "left")
    # the other 48 bits, in order, as four parts of 12
    rest = F.lit(0).cast("bigint")
    for k in range(4):
        low = F.col("fp").bitwiseAND((1 << 16 * k) - 1)
        high = F.shiftleft(F.shiftrightunsigned("fp", 16 * (k + 1)), 16 * k) if k < 3 else F.lit(0).cast("bigint")
        rest = F.when(F.col("field") == k, low.bitwiseOR(high)).otherwise(rest)
    parts = F.array(*[F.lit((k + 1) * 4096).cast("bigint") + F.shiftrightunsigned(rest, 12 * k).bitwiseAND(4095) for k in range(4)])
    part = F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(parts))
    keyed = marked.select("fp", "bucket", part.alias("part")).select((F.col("bucket") * 32768 + F.col("part")).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_edges, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): a row for each input row; component_id is the smallest id reachable by links."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = cut(rows.mapInArrow(_fingerprint_rows, "doc_id bigint, fp bigint"))
    known = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(print_edges(known.select("fp")))
    placed = known.join(roots, known["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(least, "root").select(F.col("fp").alias("f"), "component_id"))
    return made.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


_COPY_BANDS = [f"b{k}" for k in range(COPY_BANDS)]


def text_sets(data: np.ndarray, offsets: np.ndarray):
    """(content hash of each text, joined bytes, byte borders, shingle hashes, where each text's shingles begin)."""
    n = len(offsets) - 1
    text, starts, ends, whose = joined_words(data, offsets)
    words = span_hash(prefix_hash(text), starts, ends)
    border = np.searchsorted(whose, np.arange(n + 1))
    made, at = shingles(words, whose, WORDS)
    return word_runs_hash(words, border[:-1], border[1:]).view(np.int64), text, np.append(starts, len(text))[border], made, np.searchsorted(whose[at], np.arange(n + 1))


def _copy_rows(batches):
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            h, _, _, made, border = text_sets(data, offsets)
            some = np.flatnonzero(border[1:] > border[:-1])
            prints, keys = np.zeros(len(h), np.uint64), np.zeros((len(h), COPY_BANDS), np.uint64)
            if len(some):
                first = border[some]
                ones = np.add.reduceat(np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
                prints[some] = np.packbits(ones * 2 > (border[some + 1] - first)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
                keys[some] = band_keys(made, first, COPY_BANDS, COPY_ROWS)
            none = border[1:] == border[:-1]
            columns = [pa.array(x.view(np.int64), mask=none) for x in (prints, *np.ascontiguousarray(keys.T))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(h), *columns], names=["doc_id", "text_hash", "h", "fp", *_COPY_BANDS])


def _copy_bodies(hits: np.ndarray):
    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch, "text", 1 << 20):
                h, text, border, *_ = text_sets(data, offsets)
                at = np.unique(h, return_index=True)[1]
                at = at[wanted(hits, h[at])]
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array([text[border[t] : border[t + 1]].tobytes() for t in at.tolist()], pa.binary())], names=["h", "body"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, component_id): a row for each input row, with xxhash64 of its text; texts equal in words, or near by exact Jaccard similarity of their
    5-word shingles, share a component, named by its smallest id. Texts under five words have equal copies only."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    made = cut(hashed.mapInArrow(_copy_rows, "doc_id bigint, text_hash bigint, h bigint, fp bigint, " + ", ".join(f"{b} bigint" for b in _COPY_BANDS)))
    known = cut(made.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("fp", *_COPY_BANDS)]))
    some = known.filter("fp is not null")
    # the most frequent text of a fingerprint stands for it
    heads = cut(some.groupBy("fp").agg(F.max(F.struct("n", "h")).alias("x")).select("fp", F.col("x.h").alias("lead")))
    links = print_edges(heads.select("fp"))
    head = lambda c: heads.select(F.col("fp").alias(f"{c}_fp"), F.col("lead").alias(c))
    linked = links.join(head("h"), F.col("a") == F.col("h_fp")).join(head("lead"), F.col("b") == F.col("lead_fp")).select("h", "lead")
    same = some.select("h", "fp").join(heads, "fp").filter("h <> lead").select("h", "lead")
    members = lambda: some.select(F.explode(F.array(*_COPY_BANDS)).alias("key"), "h", "n", F.lit(None).cast("bigint").alias("own"))
    body_rows = lambda hits: rows.mapInArrow(_copy_bodies(hits), "h bigint, body binary")
    roots = components(near_edges(members, body_rows, similarity, linked.union(same), chunk=300))
    placed = known.join(roots, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(least, "root").select(F.col("h").alias("g"), "component_id"))
    return made.join(named, F.col("h") == F.col("g")).select("doc_id", "text_hash", "component_id")


def op7_simhash_components(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
