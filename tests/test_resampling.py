"""Bootstrap by partial sums: draws, sums and intervals against numpy and SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import resampling as B


def test_draws_are_poisson_and_independent():
    w = B.weights(np.arange(2000), 0, 1000)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    c = np.corrcoef(w[:300])
    assert np.abs(c - np.eye(300)).max() < 0.2 and abs((c - np.eye(300)).mean()) < 2e-3
    c = np.corrcoef(w[:, :300].T)
    assert np.abs(c - np.eye(300)).max() < 0.15


def test_draws_equal_their_sql():
    got = duckdb.execute(f"SELECT i, b, {B.weight_sql('i', 'b')} AS w FROM range(500) x(i), range(200) y(b) ORDER BY 1, 2").fetchnumpy()["w"].reshape(500, 200)
    assert (got == B.weights(np.arange(500), 0, 200)).all()
    assert (B.weights(np.arange(500), 150, 50) == got[:, 150:]).all()


def sample(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, g, float(rng.normal(m, 2))) for i, (g, m) in enumerate([("x", 5)] * 400 + [("y", 7)] * 150 + [(None, 1)] * 60)]
    rows += [(900, "one", 3.5), (901, "none", None), (902, "none", float("nan")), (903, "x", float("inf")), (904, "x", None)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double").repartition(6)


def test_sums_equal_numpy(spark):
    rows, df = sample(spark)
    got = {(r.g, r.b): (r.w, r.s1) for r in B.resampled(df, ["g"], "id", ["v"], 700).collect()}
    for g in ("x", "y", None, "one"):
        own = [(i, v) for i, k, v in rows if k == g and v is not None and np.isfinite(v)]
        w = B.weights(np.array([i for i, _ in own]), 0, 700)
        v = np.array([v for _, v in own])
        for b in (0, 1, 499, 500, 699):
            assert np.allclose(got[g, b], (w[:, b].sum(), (w[:, b] * v).sum()))
    assert not any(g == "none" for g, _ in got) and len(got) == 4 * 700


def test_intervals(spark):
    """Near the normal interval of the mean; defined for one value and for none."""
    rows, df = sample(spark)
    got = {r.g: r for r in B.mean_interval(df, ["g"], "id", "v", 4000).collect()}
    for g in ("x", "y"):
        v = np.array([x for _, k, x in rows if k == g and x is not None and np.isfinite(x)])
        half = 1.96 * v.std(ddof=1) / len(v) ** 0.5
        assert got[g].n == len(v) and abs(got[g].mean - v.mean()) < 1e-9
        assert abs(got[g].lo - (v.mean() - half)) < 0.15 * half + 0.01 and abs(got[g].hi - (v.mean() + half)) < 0.15 * half + 0.01
    assert (got["one"].n, got["one"].mean, got["one"].lo, got["one"].hi) == (1, 3.5, 3.5, 3.5)
    assert got["none"].n == 0 and got["none"].mean is None and got["none"].lo is None
    assert B.mean_interval(df.limit(0), ["g"], "id", "v", 10).count() == 0
    again = {r.g: r for r in B.mean_interval(df.repartition(2), ["g"], "id", "v", 4000).collect()}
    assert all(abs(again[g].lo - got[g].lo) < 1e-9 for g in ("x", "y", None))


def test_difference_and_its_p(spark):
    rows, df = sample(spark)
    s = B.resampled(df, ["g"], "id", ["v"], 3000)
    r = B.difference(s, "g", "x", "y").first()
    x, y = (np.array([v for _, k, v in rows if k == g and v is not None and np.isfinite(v)]) for g in "xy")
    gap, half = y.mean() - x.mean(), 1.96 * (x.var() / len(x) + y.var() / len(y)) ** 0.5
    assert abs(r.lo - (gap - half)) < 0.1 * half and abs(r.hi - (gap + half)) < 0.1 * half and r.p == 0
    r = B.difference(s, "g", "y", "x").first()
    assert r.p == 1


def test_correlations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = 0.6 * x + rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b), 2.0) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double, c double")
    d = df.select("id", "x", "y", "c", *[(F.col(p[0]) * F.col(p[1])).alias(p) for p in ("xx", "yy", "xy", "cc", "xc")])
    s = B.resampled(d, [], "id", ["x", "y", "xx", "yy", "xy", "c", "cc", "xc"], 600)
    got = {r.b: r for r in s.select("b", B.pearson(1, 2, 3, 4, 5).alias("r"), B.pearson(1, 6, 3, 7, 8).alias("flat")).collect()}
    for b in (0, 77, 599):
        w = B.weights(np.arange(300), b, 1)[:, 0].astype(int)
        assert abs(got[b].r - np.corrcoef(np.repeat(x, w), np.repeat(y, w))[0, 1]) < 1e-9 and got[b].flat is None
