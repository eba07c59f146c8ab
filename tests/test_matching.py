"""Matching operators against brute force on small inputs."""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayfold.operators import assignment as A
from wayfold.operators import blocks as B
from wayfold.operators import graph as G
from wayfold.operators import matching as M


def test_greedy_takes_the_nearest_pair(spark):
    rows = [("a", 4, 1, 1, 0), ("a", 6, 2, 1, 10), ("b", 0, 1, 1, 0), ("b", 0, 1, 2, 0)]
    out = M.greedy_match(spark.createDataFrame(rows, "k string, delta long, pi long, gi long, t long"), ["k"], "t", 20).collect()
    assert sorted((x.k, x.pi, x.gi) for x in out) == [("a", 1, 1), ("b", 1, 1)]


def test_greedy_equals_the_sorted_pass(spark):
    """Ties in plenty, clusters of time of all sizes."""
    rng = np.random.default_rng(11)
    p, g, tol = np.sort(rng.integers(0, 900, 120)), np.sort(rng.integers(0, 900, 100)), 6
    pairs = [(int(abs(a - b)), i, j, int(a)) for i, a in enumerate(p) for j, b in enumerate(g) if abs(a - b) <= tol]
    used_p, used_g, want = set(), set(), set()
    for _, i, j, _ in sorted(pairs):
        if i not in used_p and j not in used_g:
            used_p.add(i)
            used_g.add(j)
            want.add((i, j))
    df = spark.createDataFrame([("k", *x) for x in pairs], "k string, delta long, pi long, gi long, t long")
    assert {(r.pi, r.gi) for r in M.greedy_match(df, ["k"], "t", 2 * tol).collect()} == want


def test_assignment_is_cheapest():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 3), (5, 5)):
        cost = rng.integers(0, 50, (n, m)).astype(float)
        got = sum(cost[a, b] for a, b in M.assign(cost))
        small, big = sorted((n, m))
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert got == best


def test_gate_drops_pairs(spark):
    x = spark.createDataFrame(pd.DataFrame({"k": [1, 1], "pi": [1, 2], "gi": [1, 1], "cost": [9.0, 5.0]}))
    assert [(r.pi, r.gi) for r in A.gated_assignment(x, ["k"], 6.0).collect()] == [(2, 1)]
    assert A.gated_assignment(x, ["k"], 5.0).count() == 0


def test_nearest_in_time_prefers_the_earlier(spark):
    a = spark.createDataFrame([(1, 10), (1, 0), (2, 5)], "k int, t long")
    b = spark.createDataFrame([(1, 8, 1), (1, 12, 2)], "k int, t long, v long")
    out = {(r.k, r.t): r.near_v for r in M.nearest_in_time(a, b, ["k"], "t", "v").collect()}
    assert out == {(1, 10): 1, (1, 0): 1, (2, 5): None}


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    left, right = rng.integers(-50, 50, 40).tolist(), rng.integers(-50, 50, 40).tolist()
    a, b = spark.createDataFrame([(1, x) for x in left], "k int, l long"), spark.createDataFrame([(1, x) for x in right], "k int, r long")
    got = sorted((x.l, x.r) for x in M.band_join(a, b, ["k"], "l", "r", 7).collect())
    assert got == sorted((x, y) for x in left for y in right if abs(x - y) <= 7)


def test_sites_at_one_place_are_looked_up_once(spark, monkeypatch):
    """300 sites at three places: what the rings join is the three places, and the lowest id speaks for each."""
    written, durable = [], M.durable
    monkeypatch.setattr(M, "durable", lambda df: written.append(durable(df)) or written[-1])
    sites = spark.createDataFrame([(i, (i % 3) * 10, 0) for i in range(7, 307)], "sensor_id long, x long, y long")
    points = spark.createDataFrame([(0, 1, 0), (1, 12, 3), (2, 900, 0)], "id long, x long, y long")
    got = {r.id: (r.sensor_id, r.d2) for r in M.nearest_site(points, sites).collect()}
    assert got == {0: (9, 1.0), 1: (7, 13.0), 2: (8, 774400.0)}
    assert written[0].count() == 3


def test_blocks_bring_every_pair_together_once(spark):
    import pyarrow as pa

    a = spark.createDataFrame([(i % 3, i) for i in range(200)], "k long, a long")
    b = spark.createDataFrame([(i % 4, i) for i in range(90)], "k long, b long")

    def pairs(x, y):
        assert len(x) <= 60 and len(y) <= 40, (len(x), len(y))
        return pa.table({"a": np.repeat(x["a"].to_numpy(), len(y)), "b": np.tile(y["b"].to_numpy(), len(x))})

    got = sorted((r.a, r.b) for r in B.meet_in_blocks(a, b, ["k"], pairs, "a bigint, b bigint", 20, 10).collect())
    assert got == sorted((i, j) for i in range(200) for j in range(90) if i % 3 == j % 4)


def test_snap_lists_no_samples_and_leaves_far_edges_out(spark, monkeypatch):
    """Edges of a million samples each, and a thousand edges out of sight: nearest samples by brute force over those near."""
    monkeypatch.setattr(G, "samples", None)
    joined, meet = [], G.meet_in_blocks
    monkeypatch.setattr(G, "meet_in_blocks", lambda p, e, *rest: joined.append(e.count()) or meet(p, e, *rest))
    near = [(1, 0.0, 0.0, 500_000.0, 0.0), (2, 0.0, 7.0, 30.0, 7.0), (3, 0.0, 0.0, 0.0, 7.3)]
    far = [(10 + i, 1e6 + 30 * i, 9e5, 1e6 + 30 * i, 9e5 + 20) for i in range(1000)]
    edges = spark.createDataFrame(near + far, "edge_id long, ax double, ay double, tx double, ty double")
    at = [(1, 3.3, 2.0), (2, 3.3, 5.0), (3, -2.0, 3.6), (4, 60.0, 40.0), (5, 3.25, 3.5)]
    got = {r.id: (r.edge_id, r.r) for r in G.snap(spark.createDataFrame(at, "id long, x double, y double"), edges).collect()}
    want = {}
    for i, x, y in at:
        some = []
        for edge, ax, ay, tx, ty in near:
            size = math.hypot(tx - ax, ty - ay)
            n = max(2, int(size / 0.5) + 1)
            some += [(((ax + k / (n - 1) * (tx - ax)) - x) ** 2 + ((ay + k / (n - 1) * (ty - ay)) - y) ** 2, edge, k, k / (n - 1) * size) for k in range(min(n, 400))]
        want[i] = (min(some)[1], min(some)[3])
    assert got == want and max(joined) < 200, (got, want, joined)


def test_nearest_site_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(i, *map(int, rng.integers(-100, 100, 2))) for i in range(60)] + [(60, 5000, -4000), (61, 5000, -4000)]
    for n in (1, 20, 300):
        sites = [(i, *map(int, rng.integers(-100, 100, 2))) for i in range(n)]
        got = {r.id: (r.sensor_id, r.d2) for r in M.nearest_site(spark.createDataFrame(pts, "id long, x long, y long"), spark.createDataFrame(sites, "sensor_id long, x long, y long")).collect()}
        want = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in sites) for i, x, y in pts}
        assert got == {i: (k, float(d)) for i, (d, k) in want.items()}
    none = spark.createDataFrame([], "sensor_id long, x long, y long")
    assert {r.sensor_id for r in M.nearest_site(spark.createDataFrame(pts, "id long, x long, y long"), none).collect()} == {None}


def test_prices_prove_the_assignment(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(p), int(g), float(c)) for k, n, m in (("a", 9, 7), (None, 5, 8), ("c", 30, 30)) for p in range(n) for g in range(m) if (c := rng.integers(1, 60)) < 25]
    rows += [("a", 100, 100, 3.0), ("a", 100, 100, 2.0), ("a", 101, 100, None)]  # a component of its own, a repeated pair
    df = spark.createDataFrame(rows, "k string, pi bigint, gi bigint, cost double")
    got = A.assigned(df, ["k"], 20.0).collect()
    for key in ("a", None, "c"):
        own = [r for r in rows if r[0] == key and r[3] is not None and r[3] < 20]
        cost = np.full((102, 102), 1e6)
        for _, p, g, c in own:
            cost[p, g] = min(cost[p, g], c)
        best = [(a, b) for a, b in M.assign(cost) if cost[a, b] < 1e6]
        mine = [r for r in got if r.k == key and r.cost is not None]
        assert len(mine) == len(best) and abs(sum(r.cost for r in mine) - sum(cost[a, b] for a, b in best)) < 1e-6
    assert len({(r.k, r.component) for r in got}) >= 4
    solution = spark.createDataFrame(got, A.assigned(df, ["k"], 20.0).schema)
    assert {tuple(r)[1:] for r in A.certificate(df.fillna("x", ["k"]), solution.fillna("x", ["k"]), ["k"], 20.0).collect()} == {(0, 0, 0)}
    worse = solution.fillna("x", ["k"]).withColumn("left_price", F.col("left_price") + 5)
    assert all(r.n_uneven for r in A.certificate(df.fillna("x", ["k"]), worse, ["k"], 20.0).collect())
    assert A.assigned(df.limit(0), ["k"], 20.0).count() == 0
