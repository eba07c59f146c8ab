"""Near pairs among sets of word shingles that share candidate keys: the part that operators on near copies have in common.

Input are rows (key, h, n, own): content hash ``h``, which stands for ``n`` rows of the corpus, is a member of candidate group
``key``. Members of a group are first verified against its most frequent member (edited copies are near their original,
which is the text found most often, while two edited copies need not be near each other). Verified pairs join into
components. In a group that still spans several components, every member outside the group's largest component is then
compared with all its members, in blocks of at most ``CHUNK`` by ``CHUNK`` sets; of two near members in different
components one at least lies outside the largest, so no link between members of a group is lost. A block gives only the
edges that join components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import SPACE, cut, few, mix, owner, prefix_hash, release, runs, shingles, span_hash, texts_of

WORDS, SIMILARITY, CHUNK = 5, 0.8, 1000
HIT_BITS = 1 << 24  # of the table that tells readers which bodies are wanted: 2 MB at every size
_HASH = np.uint64(16)  # bits given up for the row number in a block's keys
_RNG = np.random.default_rng(404)
_A = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64)


def band_keys(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys, a row for each set: ``values`` are the sets' shingle hashes one after another, ``first`` where
    each (non-empty) set begins. A band holds ``rows`` minima; bands are never equal to each other's."""
    out = np.zeros((len(first), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(first), 2 * k + 1, np.uint64)
        for r in range(k * rows, (k + 1) * rows):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) ^ np.minimum.reduceat((values * _A[r] + _B[r]) >> np.uint64(8), first))
        out[:, k] = key
    return out


def leaders(batches):
    """Rows (key, h, own) sorted by key and rank to (key, h, lead, known): of each further hash of a key, and of edges (h,
    own) that are known; one row of state."""
    last, lead = None, 0
    names = ["key", "h", "lead", "known"]
    for batch in batches:
        edge = batch.column(2).is_valid()
        if pa.compute.any(edge).as_py():
            e = batch.filter(edge)
            yield pa.RecordBatch.from_arrays([e.column(0), e.column(1), e.column(2), pa.array(np.ones(e.num_rows, bool))], names=names)
            batch = batch.filter(pa.compute.invert(edge))
        keys, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = last is None or keys[0] != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        leads = np.where(at >= 0, h[np.maximum(at, 0)], lead)
        pick = ~new & (h != leads)
        last, lead = keys[-1], leads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array(h[pick]), pa.array(leads[pick]), pa.array(np.zeros(int(pick.sum()), bool))], names=names)


def set_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row number, shingle hash) keys of the shingle sets of a column of bodies, and the set sizes.

    A column of up to 65,536 bodies; 48 bits of each hash are kept."""
    data, offsets = texts_of(column)
    starts, ends = runs(~SPACE[data], offsets)
    whose = owner(starts, offsets)
    made, at = shingles(span_hash(prefix_hash(data), starts, ends), whose, WORDS)
    keys = np.unique(whose[at].astype(np.uint64) << np.uint64(48) | made >> _HASH)
    return keys, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(column))


def verified(similarity: float):
    """(h, lead, x, y) to the pairs (a, b) whose sets are near."""

    def run(batches):
        for batch in batches:
            sizes = pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3))).to_numpy()
            ends, row = np.cumsum(sizes), 0
            while row < batch.num_rows:
                before = ends[row - 1] if row else 0
                end = min(row + 60_000, max(row + 1, int(np.searchsorted(ends, before + (1 << 20), side="right"))))
                part = batch.slice(row, end - row)
                row = end
                (a, na), (b, nb) = set_keys(part.column(2)), set_keys(part.column(3))
                both = np.sort(np.concatenate([a, b]))
                twice = both[1:][both[1:] == both[:-1]]
                same = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=part.num_rows)
                ok = (same > 0) & (same >= similarity * (na + nb - same) - 1e-9)
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    return run


def _joining(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the row pairs that join components, each in its turn."""
    parent, out = list(range(int(label.max(initial=0)) + 1)), np.zeros(len(a), bool)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            out[k] = True
    return out


def _wide(keys: np.ndarray, sizes: np.ndarray, border: np.ndarray, sets: np.ndarray, asks: np.ndarray, label: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Edges of one large block: each ask marks its shingles, which are summed over the sets; of the near sets in each
    other component one makes an edge, and ``label`` follows."""
    low = np.uint64((1 << 48) - 1)
    values, flat = np.unique(keys[border[sets[0]] : border[sets[-1] + 1]] & low, return_inverse=True)
    rows = sets[sizes[sets] > 0]
    first = np.cumsum(sizes[rows]) - sizes[rows]
    mask, left, right = np.zeros(len(values), bool), [], []
    for q in asks.tolist():
        own = keys[border[q] : border[q + 1]] & low
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        at = at[values[at] == own]
        mask[at] = True
        same = np.add.reduceat(mask[flat], first, dtype=np.int32)
        mask[at] = False
        near = rows[(same >= similarity * (sizes[q] + sizes[rows] - same) - 1e-9) & (label[rows] != label[q])]
        if len(near):
            other, one = np.unique(label[near], return_index=True)
            left += [q] * len(other)
            right += near[one].tolist()
            label[np.isin(label, other)] = label[q]
    return left, right


def _slices(border: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = sizes[rows]
    return np.repeat(border[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _narrow(keys: np.ndarray, sizes: np.ndarray, border: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Mask of the row pairs that are near: shingles of both sides, numbered by pair, sorted together."""
    low, out, at = np.uint64((1 << 48) - 1), np.zeros(len(a), bool), 0
    ends = np.cumsum(sizes[a] + sizes[b])
    while at < len(a):
        before = ends[at - 1] if at else 0
        end = min(at + 60_000, max(at + 1, int(np.searchsorted(ends, before + 1_000_000, side="right"))))
        x, y = a[at:end], b[at:end]
        number = np.arange(len(x), dtype=np.uint64) << np.uint64(48)
        both = np.concatenate([np.repeat(number, sizes[r]) | keys[_slices(border, sizes, r)] & low for r in (x, y)])
        both.sort()
        same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(x))
        out[at:end] = same >= similarity * (sizes[x] + sizes[y] - same) - 1e-9
        at = end
    return out


def resolve(block: np.ndarray, ask: np.ndarray, h: np.ndarray, root: np.ndarray, bodies: pa.Array, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join components in whole blocks, rows sorted by block with the sets before those that ask."""
    keys, sizes = set_keys(bodies)
    border = np.searchsorted((keys >> np.uint64(48)).astype(np.int64), np.arange(len(h) + 1))
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    n = np.diff(np.append(first, len(block)))
    asks = np.add.reduceat(ask.astype(np.int64), first)
    sets = n - asks
    label = np.unique(root, return_inverse=True)[1]
    left, right = [], []
    wide = (asks * sets > 20_000) & (sets > 1)
    for s, m, k in zip(first[wide].tolist(), sets[wide].tolist(), asks[wide].tolist()):
        rows, q = np.arange(s, s + m), np.arange(s + m, s + m + k)
        q = q[sizes[q] > 0]
        if len(q) and sizes[rows].any():
            a, b = _wide(keys, sizes, border, rows, q, label, similarity)
            left += a
            right += b
    s, m, k = first[~wide], sets[~wide], asks[~wide]
    count = m * k
    ends, at = np.cumsum(count), 0
    while at < len(count):  # some 100,000 pairs at a time
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, side="right")))
        n = count[at:end]
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start, wides = np.repeat(s[at:end], n), np.repeat(m[at:end], n)
        at = end
        a, b = start + wides + number // np.maximum(wides, 1), start + number % np.maximum(wides, 1)
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        keep = (small > 0) & (small >= similarity * large - 1e-9) & (label[a] != label[b])
        a, b = a[keep], b[keep]
        near = _narrow(keys, sizes, border, a, b, similarity)
        a, b = a[near], b[near]
        joins = _joining(label, a, b)
        left += a[joins].tolist()
        right += b[joins].tolist()
    return h[np.array(left, np.int64)], h[np.array(right, np.int64)]


def _blocks(similarity: float):
    """Rows (key, i, j, ask, h, root, body) sorted by block to the edges that blocks add, several whole blocks at a time."""

    def run(batches):
        held, size, last = [], 0, None

        def give(rows):
            table = pa.Table.from_batches(rows).combine_chunks()
            column = lambda c: table.column(c).to_numpy()
            new = np.ones(table.num_rows, bool)
            new[1:] = False
            for c in ("key", "i", "j"):
                x = column(c)
                new[1:] |= x[1:] != x[:-1]
            a, b = resolve(np.cumsum(new), column("ask"), column("h"), column("root"), table.column("body").combine_chunks(), similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            start = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]).any(axis=1)]))
            length = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(6)).to_numpy())])
            at = 0
            for a in start.tolist():
                # a border between blocks, unless the batch begins within the last one
                if (a or last is not None and tuple(blocks[0]) != last) and size + length[a] - length[at] >= 1 << 20:
                    if a > at:
                        held.append(batch.slice(at, a - at))
                    yield give(held)
                    held, size, at = [], 0, a
            held.append(batch.slice(at))
            size += length[-1] - length[at]
            last = tuple(blocks[-1])
        if held:
            yield give(held)

    return run


def hit_table(ids: DataFrame) -> np.ndarray:
    """A bit for each of HIT_BITS values of the low bits of the ids (i), set where one has it; built by the tasks."""
    bit = F.col("i").bitwiseAND(HIT_BITS - 1) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((HIT_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def wanted(hits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mask of the hashes that may be wanted."""
    low = h.view(np.int64) & (HIT_BITS - 1)
    return hits[low >> 3] >> (low & 7).astype(np.uint8) & 1 == 1


def near_edges(members: Callable[[], DataFrame], body_rows: Callable[[np.ndarray], DataFrame], similarity: float = SIMILARITY, extra: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows (key, h, n, own) of ``members()`` to verified edges (a, b) whose components are those of all near pairs that
    share a key. Rows with ``own`` are no members but edges (h, own) known to be near.

    ``body_rows(hits)`` reads (h, body), words parted by white space, of the hashes that ``wanted`` finds in the table
    ``hits`` (others may come too, and are dropped in a join). ``extra`` are further candidate pairs (h, lead). The rows
    of ``members`` are made here so that nothing holds their shuffle files once the groups are known."""
    dealt = members().repartition("key").sortWithinPartitions("key", F.desc("n"), "h").select("key", "h", "own")
    all_ = cut(dealt.mapInArrow(leaders, "key bigint, h bigint, lead bigint, known boolean"))
    del dealt
    release(all_.sparkSession)
    todo = all_.filter("not known").select("key", "h", "lead")
    known = all_.filter("known").select(F.col("h").alias("a"), F.col("lead").alias("b"))
    pairs = todo.select("h", "lead")
    if extra is not None:
        pairs = pairs.union(extra.select("h", "lead"))
    both = known.select(F.least("a", "b").alias("k0"), F.greatest("a", "b").alias("k1"))
    pairs = pairs.join(both, (F.least("h", "lead") == F.col("k0")) & (F.greatest("h", "lead") == F.col("k1")), "left_anti")
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.col("h").alias("i")).union(pairs.select("lead")).distinct())
    n_ids = ids.count()
    if not n_ids:
        return known
    bodies = body_rows(hit_table(ids)).join(ids, F.col("h") == F.col("i"), "left_semi")
    bodies = cut(bodies.dropDuplicates(["h"]))
    left, right = bodies.select(F.col("h").alias("l"), F.col("body").alias("x")), bodies.select(F.col("h").alias("r"), F.col("body").alias("y"))
    full = pairs.join(left, F.col("h") == F.col("l")).join(right, F.col("lead") == F.col("r")).select("h", "lead", "x", "y")
    good = full.mapInArrow(verified(similarity), "a bigint, b bigint")
    good = cut(good.union(known))
    roots = components(good)
    of = lambda c: roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
    rooted = todo.join(of("h"), F.col("h") == F.col("h_node"), "left").join(of("lead"), F.col("lead") == F.col("lead_node"), "left")
    rooted = cut(rooted.select("key", "h", "lead", F.coalesce("h_root", "h").alias("root"), F.coalesce("lead_root", "lead").alias("lead_root")))
    # groups in more than one component, with their leader as a member
    unlike = rooted.filter("root <> lead_root").select(F.col("key").alias("k")).distinct()
    rest = rooted.join(unlike, F.col("key") == F.col("k"), "left_semi")
    rest = few(rest.select("key", "h", "root").union(rest.select("key", F.col("lead").alias("h"), F.col("lead_root").alias("root"))).distinct(), n_ids)
    rest = cut(rest)
    sizes = rest.groupBy("key", "root").agg(F.count("*").alias("m"))
    plan = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m"))
    part = lambda n: F.greatest(F.ceil(n / chunk), F.lit(1)).cast("int")
    plan = plan.select(F.col("key").alias("k"), F.col("top.root").alias("largest"), part(F.col("m")).alias("mi"), part(F.col("m") - F.col("top.m")).alias("qj"))
    placed = rest.join(plan, F.col("key") == F.col("k"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    slot = lambda n, salt: F.pmod(F.xxhash64("h", F.lit(salt)), n).cast("int")
    sets = placed.select("key", slot(F.col("mi"), 1).alias("i"), spread(F.col("qj")).alias("j"), F.lit(False).alias("ask"), "h", "root")
    asks = placed.filter("root <> largest").select("key", spread(F.col("mi")).alias("i"), slot(F.col("qj"), 2).alias("j"), F.lit(True).alias("ask"), "h", "root")
    met = sets.union(asks).join(bodies.withColumnRenamed("h", "g"), F.col("h") == F.col("g")).select("key", "i", "j", "ask", "h", "root", "body")
    more = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "ask").mapInArrow(_blocks(similarity), "a bigint, b bigint")
    return good.union(cut(more))
