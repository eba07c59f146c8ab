import random
import zlib

import numpy as np

from wayfold.llm import op10_quality as op


def corpus(n=900, bad=0.2, seed=3):
    """Prose and junk: (id, text, quality)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rng.random() < bad:
            text = " ".join(rng.choice(["$$$", "click", "|", "BUY", "###", "1234", "win!!!"]) for _ in range(rng.randint(20, 80)))
            rows.append((i, text, 0))
        else:
            text = " ".join(" ".join(rng.choices(words, k=rng.randint(5, 12))).capitalize() + "." for _ in range(rng.randint(2, 8)))
            rows.append((i, text, 1))
    return rows


def tables(spark, rows, labelled=0.5):
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if zlib.crc32(f"l{i}".encode()) % 100 < 100 * labelled], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in op.op10_quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, got[i].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.3) for i, *_ in rows)
    good, bad = (np.array([s for s, _, q in held if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.98 and np.mean([p == q for _, p, q in held]) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    """Turning every label of the held-out fold around changes nothing."""
    rows = corpus(300)
    docs, labels = tables(spark, rows)
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 0) for r in labels.collect()], labels.schema)
    score = lambda l: {r.doc_id: round(r.score, 12) for r in op.op10_quality_scores(docs, l).collect()}
    assert score(labels) == score(turned)


def test_prior_is_near_the_share(spark):
    rng = np.random.default_rng(4)
    for share in (0.4, 0.7, 0.9):
        good, bad = rng.normal(0, 1, (6000, op.WIDTH)), rng.normal(0, 1, (6000, op.WIDTH)) + np.eye(op.WIDTH)[0] * 6
        u = np.concatenate([good[: int(3000 * share)], bad[: 3000 - int(3000 * share)]])
        got = op.estimate_prior(good[3000:].astype(np.float32), rng.permutation(u).astype(np.float32))
        assert 0.6 * share < got < share + 0.03  # two standard errors below the least ratio: cautious


def test_odd_rows(spark):
    rows = corpus(200)
    docs, labels = tables(spark, rows)
    odd = docs.union(spark.createDataFrame([(None, None, "s", 0.5), (None, "", "s", 0.5), (7, rows[7][1], "s", 0.5), (900, "word " * 200_000, "s", 0.5)], docs.schema))
    got = op.op10_quality_scores(odd, labels.union(spark.createDataFrame([(None, 1, 0), (7, 1, 0)], labels.schema))).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1 and len({r.score for r in got if r.doc_id is None}) == 1
    assert {r.score for r in op.op10_quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert op.op10_quality_scores(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    """A table that is one row over and over, or one id: the driver sees a bounded number of rows."""
    seen = []
    fit = op.fit
    monkeypatch.setattr(op, "fit", lambda p, u, *a, **k: seen.append(len(p) + len(u)) or fit(p, u, *a, **k))
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(3000)], "doc_id bigint, text string")
    op.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"), sample=40)
    assert all(n <= 240 for n in seen)


def test_scored_rows_may_bear_the_name(spark):
    docs, labels = tables(spark, corpus(120))
    assert "score" in docs.columns
    got = op.with_score(docs, op.train(docs, labels))
    assert got.columns == [*docs.columns, "score_"] and got.filter("score <> 0.5D").count() == 0
    assert got.filter("score_ between 0 and 1").count() == 120


def test_ties_and_repeated_rows(spark):
    rows = corpus(150)
    docs, labels = tables(spark, rows + rows + [(None, rows[0][1], 1)])
    scores = {}
    for r in op.op10_quality_scores(docs, labels).collect():
        scores.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert len(scores) == 151 and all(len(v) == 1 for v in scores.values())


def test_memory_of_scored_batches_is_bounded():
    """A batch of texts needs the memory of one block, not of its own size or of 2 MB of text at once."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"labelled": list(range(4000)), "text": ["some words of a text, " * 50] * 4000})
    op.features(np.zeros(1 << 22, np.uint8), np.array([0, 1 << 22]))  # tables of powers are made
    tracemalloc.start()
    assert sum(b.num_rows for b in op._feature_rows(iter([batch]))) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20, peak


def test_texts_of_the_sample_stay_where_they_are_read(spark):
    """Numbers, not texts, go to the one task that ends the sample."""
    rows = corpus(200)
    docs, labels = tables(spark, rows)
    kind = type(docs)
    plans, collect = [], kind.toPandas
    try:
        kind.toPandas = lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self)
        op.train(docs, labels)
    finally:
        kind.toPandas = collect
    assert len(plans) == 1 and 0 <= plans[0].find("GlobalLimit") < plans[0].find("MapInArrow")
