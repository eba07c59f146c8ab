import hashlib
import random

import numpy as np

from wayfold.llm import op8_suffixes as op
from wayfold.llm.induced import suffix_order


def slow(rows, length=op.LENGTH):
    first = {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda x: x[0]):
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            first[w] = min(first.get(w, (i, a)), (i, a))
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < (i, a):
                gone[a : a + length] = True
        keep = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), len(t) - len(keep), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(keep).hexdigest())
    return out


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.op8_suffix_dedup(df).collect()}
    want = slow([(i, (t or "").encode()) for i, t in rows])
    assert got == want


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    long = lambda n: "".join(word() for _ in range(n))
    base = [long(60) for _ in range(6)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, "b" + "ab" * 120, *base]
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randint(0, len(a)), rng.randint(0, len(b))
        texts.append(a[x : x + rng.randint(50, 300)] + long(rng.randint(0, 6)) + b[y : y + rng.randint(50, 300)])
    texts += [texts[10], texts[10], texts[40]]
    check(spark, texts)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.op8_suffix_dedup(df).count() == 0
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, t), (1, t), (None, "z" + t)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in op.op8_suffix_dedup(df).collect())
    assert got == [(0, 0), (1, len(t)), (1, len(t))]


def test_induced_order_with_spills():
    rng = np.random.default_rng(0)
    for turn in range(60):
        k, limit = int(rng.integers(1, 5)), int(rng.integers(3, 30))
        body = rng.integers(1, k + 1, int(rng.integers(1, 120))) if turn % 3 else np.tile(rng.integers(1, k + 1, 5), 15)
        text = np.append(body, 0).astype(np.uint16)
        order, lcp, _ = suffix_order(text, limit, memory=200 if turn % 2 else 1 << 20)
        cuts = [tuple(text[i : i + limit]) for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and cuts == sorted(cuts)
        for j in range(1, len(cuts)):
            same = next((c for c, (x, y) in enumerate(zip(cuts[j], cuts[j - 1])) if x != y), min(len(cuts[j]), len(cuts[j - 1])))
            assert same == lcp[j]


def slow_rows(rows, length=op.LENGTH):
    """Rows (id or None, bytes), ids repeated at will: one result a row, sorted."""
    null = min([i for i, _ in rows if i is not None], default=0) - 1
    places = sorted({(null if i is None else i, hashlib.sha256(t).hexdigest() if len(t) >= length else "", t) for i, t in rows})
    first = {}
    for i, d, t in places:
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], (i, d, a))
    out = []
    for i, t in rows:
        key = (null if i is None else i, hashlib.sha256(t).hexdigest() if len(t) >= length else "")
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < (*key, a):
                gone[a : a + length] = True
        keep = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i if i is not None else -1, len(t), len(t) - len(keep), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def test_shared_and_null_ids_hot_passages(spark):
    rng = random.Random(16)
    long = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    t, w, hot = long(200), long(120), long(260)
    rows = [(None, t), (None, "zzz" + t + "y"), (None, long(150)), (None, t + w), (None, long(130)), (5, "q" + t), (5, long(110) + w), (5, "short"), (None, "short")]
    rows += [(100 + k, long(rng.randint(0, 40)) + hot + long(rng.randint(0, 40))) for k in range(60)] + [(7, t), (7, t)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.op8_suffix_dedup(df).collect())
    assert got == slow_rows([(i, x.encode()) for i, x in rows])


def test_a_text_beyond_a_block(spark):
    rng = np.random.default_rng(2)
    big = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    df = spark.createDataFrame([(1, big), (2, "x" * 50 + big[700_000:701_000] + "y" * 60), (3, big[:500])], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op.op8_suffix_dedup(df).collect()}
    assert got == {1: (1_300_000, 0, 0), 2: (1110, 1000, 1), 3: (500, 500, 1)}


def test_short_texts_under_a_long_ones_id(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(1, passage), (5, passage + "zz"), (5, "short text"), (5, ""), (5, None), (None, passage[:150]), (None, "brief"), (None, passage + "y" * 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in op.op8_suffix_dedup(df).collect()}
    assert len(got) == len(rows) - 1  # the empty and the null text give equal rows
    assert all(got[k] == (0, 0) for k in ((5, 10), (5, 0), (None, 5)))
    assert got[5, 202] == (200, 1) and got[1, 200] == (200, 1)
