"""Sequence labellers: gradients, unbroken state, held-out scores, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import gradients as G
from wayfold.operators import labellers as L
from wayfold.operators import sequences as Q

FEATURES = ["a", "b"]


def slopes(params, loss, n=6, eps=1e-6):
    """Largest difference between gradients and central differences at some entries of each parameter."""
    _, grads = G.gradients(params, loss)
    rng, worst = np.random.default_rng(0), 0.0
    for k, v in params.items():
        for _ in range(n):
            at = tuple(rng.integers(0, s) for s in v.shape)
            value = []
            for sign in (1, -1):
                moved = {**params, k: v.copy()}
                moved[k][at] += sign * eps
                value.append(float(loss({m: G.Node(x) for m, x in moved.items()}).data))
            worst = max(worst, abs((value[0] - value[1]) / (2 * eps) - grads[k][at]))
    return worst


def test_recurrent_gradients_equal_differences():
    rng = np.random.default_rng(1)
    p = L.recurrent_params(rng, 3, 5, 2)
    x, seen, speed = rng.normal(size=(4, 7, 3)), rng.integers(0, 2, (4, 7)).astype(float), rng.normal(size=(4, 7)) * 2
    mask = (np.arange(7) < np.array([7, 5, 3, 1])[:, None]).astype(float)
    assert slopes(p, lambda q: L.recurrent_loss(q, x, seen, speed, mask, 3.0, 2)) < 1e-6


def test_attention_gradients_equal_differences():
    rng = np.random.default_rng(2)
    p = L.attention_params(rng, 6, 2, 4)
    mask = (np.arange(8) < np.array([8, 6, 2])[:, None]).astype(float)
    x = L.boundary_inputs(np.cumsum(rng.random((3, 8)), axis=1), rng.random((3, 8)), mask)
    y = rng.integers(0, 2, (3, 8)).astype(float) * mask
    assert slopes(p, lambda q: L.boundary_loss(L.attend(q, x, mask), y, mask)) < 1e-5


def test_losses_equal_their_formulas():
    rng = np.random.default_rng(3)
    z, y, mask = rng.normal(size=(3, 5)) * 3, rng.integers(0, 2, (3, 5)).astype(float), np.ones((3, 5))
    mask[1, 3:] = 0
    p = 1 / (1 + np.exp(-z))
    want = -(18 * y * np.log(p) + (1 - y) * np.log(1 - p))[mask > 0].mean()
    assert np.isclose(G.bce(G.Node(z), y, mask, 18.0).data, want)
    e = np.abs((p * mask).sum(1) - (y * mask).sum(1))
    assert np.isclose(G.count_loss(G.Node(z), y, mask).data, np.where(e < 1, 0.5 * e * e, e - 0.5).mean())
    assert np.isclose(G.sparsity(G.Node(z), mask).data, 0.1 * (p * mask).sum() / mask.sum())


def test_padding_is_never_attended_to():
    rng = np.random.default_rng(4)
    p = {k: G.Node(v) for k, v in L.attention_params(rng).items()}
    mask = np.ones((1, 9))
    mask[0, 6:] = 0
    x = rng.normal(size=(1, 9, 5))
    other = x.copy()
    other[0, 6:] = 99
    assert np.allclose(L.attend(p, x, mask).data[0, :6], L.attend(p, other, mask).data[0, :6])


def untrained(seed=5, inputs=2, hidden=6):
    return L.Recurrent(L.recurrent_params(np.random.default_rng(seed), inputs, hidden, 2), 2, np.zeros(inputs), np.ones(inputs), (1.0, 2.0))


def test_state_carries_over_batches(spark):
    """Batches of 7 rows give what a whole pass over each sequence gives."""
    rng = np.random.default_rng(6)
    rows = [(str(s) if s else None, i, float(rng.normal()), float(rng.normal()) if rng.random() > 0.1 else None) for s, n in enumerate((40, 1, 7, 14, 0, 3, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double").repartition(3)
    model = untrained()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.i): (r.visible_prob, r.speed_pred) for r in L.label_recurrent(df, model, ["k"], ["i"], FEATURES).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        x = np.array([[[np.nan if v is None else v for v in r[2:]] for r in own]], float)
        p, v = model.label(x, np.array([len(own)]), model.states(1))
        assert np.allclose(p[0], [got[k, r[1]][0] for r in own]) and np.allclose(v[0], [got[k, r[1]][1] for r in own])


def streams(n=60, length=90, seed=8):
    """Frame sizes with rising and falling spells; seen from a value of 700 on until one of 300."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(n):
        level, on = 500.0, False
        for i in range(length):
            level = float(np.clip(level + rng.normal(0, 130), 50, 950))
            on = True if level >= 700 else False if level <= 300 else on
            rows.append((s, i, level, on, level / 100 if on else 0.0))
    return rows


def f1(truth, got):
    tp = sum(t and g for t, g in zip(truth, got))
    return 2 * tp / max(sum(truth) + sum(got), 1)


def test_held_out_score_beats_the_threshold_detector(spark):
    df = spark.createDataFrame(streams(), "seq_id int, i int, size double, seen boolean, speed double").withColumn("log_size", F.log1p("size")).withColumn("held_out", L.held_out(F.col("seq_id"), 4)).cache()
    model = L.fit_recurrent(df.filter("not held_out"), ["seq_id"], "i", ["size", "log_size"], "seen", "speed", size=60, stride=30, hidden=24, epochs=30, patience=6)
    got = L.label_recurrent(df, model, ["seq_id"], ["i"], ["size", "log_size"]).filter("held_out").collect()
    truth = [r.seen for r in got]
    learned = f1(truth, [r.visible_prob > 0.5 for r in got])
    plain = max(f1([r.seen for r in x], [r.visible == 1 for r in x]) for x in (Q.threshold_detector(df, ["seq_id"], ["i"], "size", t).filter("held_out").collect() for t in (0.0, 0.5, 1.0)))
    error = np.sqrt(np.mean([(r.speed - r.speed_pred) ** 2 for r in got]))
    spread = np.std([r.speed for r in got])
    assert learned > 0.9 and learned > plain + 0.05 and error < 0.5 * spread, (learned, plain, error, spread)


def test_attention_finds_the_first_row_after_a_pause(spark):
    rng, rows = np.random.default_rng(9), []
    for s in range(40):
        t = 0.0
        for i in range(80):
            pause = rng.random() < 0.15
            t += float(rng.uniform(5, 9)) if pause else float(rng.uniform(0.1, 1))
            rows.append((s, i, t, float(rng.integers(100, 900)), pause))
    df = spark.createDataFrame(rows, "seq_id int, i int, t_s double, size double, opening boolean").withColumn("held_out", L.held_out(F.col("seq_id"), 4)).cache()
    model = L.fit_attention(df.filter("not held_out"), ["seq_id"], "i", "t_s", "size", "opening", window=40, stride=10, epochs=40, patience=10, pos_weight=3.0, rate=6e-3)
    got = L.label_attention(df, model, ["seq_id"], "i", "t_s", "size", 40, 10)
    n = got.groupBy("seq_id").count().collect()
    assert len(n) == 40 and all(r["count"] == 80 for r in n)
    held = got.join(df.filter("held_out").select("seq_id", "i", "opening"), ["seq_id", "i"]).collect()
    base = np.mean([r.opening for r in held])
    on = [r.boundary_prob > 0.5 for r in held]
    assert f1([r.opening for r in held], on) > 2 * base + 0.2, (f1([r.opening for r in held], on), base)
    starts = {r.n_windows for r in got.filter("seq_id = 0 and i = 35").collect()}
    assert starts == {4}  # windows 0, 10, 20 and 30


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "seq_id int, i int, a double, b double, seen boolean, speed double")
    model = L.fit_recurrent(df, ["seq_id"], "i", FEATURES, "seen", "speed")
    assert L.label_recurrent(df, model, ["seq_id"], ["i"], FEATURES).count() == 0
    one = spark.createDataFrame([(1, 0, 0.5, None, True, 1.0)], df.schema)
    r = L.label_recurrent(one, model, ["seq_id"], ["i"], FEATURES).first()
    assert r.visible_prob == 0.5 and r.speed_pred == 0.0
    got = L.fit_attention(df, ["seq_id"], "i", "a", "b", "seen")
    assert L.label_attention(one, got, ["seq_id"], "i", "a", "b").first().boundary_prob == pytest.approx(0.5)


def test_queries_label_every_row(spark):
    from wayfold.queries import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    for name, column in (("recurrent_labels", "visible_prob"), ("attention_labels", "boundary_prob")):
        out = queries()[name](spark, sf)
        assert out.filter(f"{column} between 0 and 1").count() == n
