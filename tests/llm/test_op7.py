import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import op7_simhash as op


def slow_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, prints):
    label = list(range(len(ids)))
    for _ in ids:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
        if not changed:
            break
    least = {}
    for i, l in zip(ids, label):
        least[l] = min(least.get(l, i), i)
    return {i: least[l] for i, l in zip(ids, label)}


def test_texts_and_components(spark):
    texts = ["a b c d e", "A  b\nc d e ", None, "", "one", "one two", "ñandú Ñ É x", "x " * 500, "x " * 499]
    rows = [(7 * i + 3, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    got = {r.doc_id: r for r in op.op7_simhash_components(df).collect()}
    assert len(got) == len(rows)
    prints = [slow_print(t) for _, t, *_ in rows]
    want = slow_components([r[0] for r in rows], prints)
    for (i, *_), p in zip(rows, prints):
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == want[i]
    assert op.op7_simhash_components(df.limit(0)).count() == 0


def test_bucket_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(op, "LIMIT", 40)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set(base.tolist())
    for x in base[:12].tolist():
        for _ in range(25):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            prints.add(y)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in op.components(op.print_edges(df)).collect()}
    want = slow_components([int(x) for x in prints.view(np.int64)], [int(x) for x in prints])
    groups, mine = {}, {}
    for k in want:
        groups.setdefault(want[k], set()).add(k)
        mine.setdefault(got.get(k, k), set()).add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_tree_search_prunes_nothing_due():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 14, 700, dtype=np.uint64))
    x = x[np.argsort(op.gray_rank(x))]
    index = op.GrayIndex(x)
    some = x[::37]
    q, leaf = index.near(some, np.zeros(len(some), np.uint64))
    for k, want in enumerate(some):
        assert set(leaf[q == k].tolist()) == set(np.flatnonzero(np.bitwise_count(x ^ want) <= 3).tolist())
    high = np.full(len(some), np.uint64(0xFF00))
    q, leaf = index.near(some, high)
    for k, want in enumerate(some):
        near = (np.bitwise_count(x ^ want) <= 3) & ((x ^ want) & np.uint64(0xFF00) == 0)
        assert set(leaf[q == k].tolist()) == set(np.flatnonzero(near).tolist())


def test_forest_spans_dense_groups():
    """A dense ball of fingerprints in small batches: edges stay in proportion, components equal brute force."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    x = np.unique(np.concatenate([centre[rng.integers(0, 4, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)), centre]))
    x = x[np.argsort(op.gray_rank(x))]
    a, b = op.forest(x, np.zeros(len(x), np.uint64), batch=16)
    assert len(a) < 40 * len(x)
    label = np.arange(len(x))
    for _ in range(200):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    want = np.arange(len(x))
    for _ in range(200):
        new = np.where(near, want[None], len(x)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


def test_null_ids_and_ties(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "z y x w v")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in op.op7_simhash_components(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


def test_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (2, long + " tail"), (3, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in op.op7_simhash_components(df).orderBy("doc_id").collect()]
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3)]
