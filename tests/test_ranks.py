"""Ranks, quantiles, recursions and sliding windows: equal to plain numpy, one sequence over several tasks, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import ranks as R
from wayfold.operators import sequences as Q


@pytest.fixture(scope="module")
def table(spark):
    """One long sequence, some short ones, a null key; rows in no order, over several partitions."""
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.integers(0, 50)) / 4 if rng.random() > 0.05 else None) for k, n in (("a", 3000), ("b", 1), ("c", 40), (None, 25), ("d", 2)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "k string, i int, v double").repartition(5).cache()


def by_key(table):
    p = table.toPandas()
    return {k if isinstance(k, str) else None: g.sort_values("i") for k, g in p.groupby("k", dropna=False)}


@pytest.fixture
def split(spark):
    """Small ranges: the long sequence lies in many partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_sequence_lies_in_several_tasks(table, split):
    n = R.in_ranges(table, ["k"], ["i"]).filter("k = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert n >= 5


def test_positions(table, split):
    got = R.positions(table, ["k"], ["i"]).collect()
    assert len(got) == table.count() and all(r.pos == r.i + 1 for r in got)
    whole = R.positions(table, [], ["k", "i"]).collect()
    assert sorted(r.pos for r in whole) == list(range(1, len(got) + 1))
    order = sorted(whole, key=lambda r: r.pos)
    assert [(r.k is not None, r.k or "", r.i) for r in order] == sorted((r.k is not None, r.k or "", r.i) for r in order)


def test_smoothed_equals_the_recursion(table, split):
    got = {(r.k, r.i): r.y for r in R.smoothed(table, ["k"], ["i"], "v", 0.3, "y").collect()}
    for k, g in by_key(table).items():
        y = None
        for i, v in zip(g["i"], g["v"]):
            if v == v and v is not None:
                y = v if y is None else 0.3 * v + 0.7 * y
            assert (got[k, i] is None) == (y is None) and (y is None or abs(got[k, i] - y) < 1e-9)


def test_recursion_over_small_batches(spark, table, split):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        test_smoothed_equals_the_recursion(table, None)
        assert all(r.pos == r.i + 1 for r in R.positions(table, ["k"], ["i"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bound", [0, 10**6])
def test_quantiles(table, split, bound):
    shares = {"q0": 0.0, "q2": 0.2, "med": 0.5, "hi": 0.995, "q1": 1.0}
    got = {r.k: r for r in R.quantiles(table, ["k"], "v", shares, bound).collect()}
    for k, g in by_key(table).items():
        v = g["v"].dropna().to_numpy()
        if not len(v):
            assert k not in got
            continue
        assert got[k].n == len(v)
        for c, q in shares.items():
            assert abs(got[k][c] - np.quantile(v, q)) < 1e-9
    odd = table.withColumn("v", F.when(F.col("i") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    r = R.quantiles(odd.filter("k = 'a'"), ["k"], "v", {"med": 0.5}, bound).first()
    v = by_key(table)["a"]
    assert abs(r.med - v[v["i"] % 3 != 0]["v"].median()) < 1e-9
    assert R.quantiles(table.limit(0), ["k"], "v", shares, bound).count() == 0


def centred(v, half, q):
    out = []
    for i in range(len(v)):
        w = [x for x in v[max(0, i - half) : i + half + 1] if x == x]
        out.append(np.quantile(w, q) if w else np.nan)
    return np.array(out)


def test_ordered_window():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 9, 200):
        v = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n) / 3)
        for half in (0, 1, 3, 150):
            for q in (0.2, 0.5, 1.0):
                assert np.allclose(R.centred_quantile(v, half, q), centred(v, half, q), equal_nan=True)
            want = [np.nanmean(w) if len(w := [x for x in v[max(0, i - half) : i + half + 1] if x == x]) else np.nan for i in range(n)]
            assert np.allclose(R.centred_mean(v, half), want, equal_nan=True)


def test_rolling_quantile_in_chunks(table, split):
    """Chunks of 64 rows: the long sequence is dealt to many groups, and borders do not show."""
    got = {(r.k, r.i): r.q for r in R.in_chunks(table, ["k"], "i", ["v"], 30, lambda v: R.centred_quantile(v, 30, 0.2), "q", chunk=64).collect()}
    assert len(got) == table.count()
    for k, g in by_key(table).items():
        want = centred(g["v"].to_numpy(float), 30, 0.2)
        have = np.array([np.nan if got[k, i] is None else got[k, i] for i in g["i"]], float)
        assert np.allclose(have, want, equal_nan=True)
    gaps = table.filter("i % 7 <> 0")
    some = {(r.k, r.i): r.q for r in Q.rolling_quantile(gaps, ["k"], ["i"], "v", 9, 0.5, "q").collect()}
    a = by_key(gaps)["a"]
    assert np.allclose([np.nan if some["a", i] is None else some["a", i] for i in a["i"]], centred(a["v"].to_numpy(float), 4, 0.5), equal_nan=True)


@pytest.mark.parametrize("nz, np_", [(40, 7), (5, 9), (1, 0), (33, 0), (12, 11), (0, 4), (100, 99)])
def test_surplus_goes_at_even_ranks(spark, nz, np_):
    rows = [(i, i % 5, False) for i in range(nz)] + [(1000 + i, 0, True) for i in range(np_)]
    got = {r.s for r in Q.drop_surplus(spark.createDataFrame(rows, "s int, start int, label boolean"), "label", ["s"]).collect()}
    k = nz - min(nz, np_)
    gone = {int(np.floor(j * float(nz - 1) / max(k - 1, 1))) for j in range(k)}
    assert got == {i for i in range(nz) if i not in gone} | {1000 + i for i in range(np_)}


def test_no_sequence_is_one_task(table):
    """No window over a whole sequence in the plans of ranks, recursions and rolling quantiles."""
    for df in (R.smoothed(table, ["k"], ["i"], "v", 0.3, "y"), Q.rolling_quantile(table, ["k"], ["i"], "v", 9, 0.5, "q"), R.quantiles(table, ["k"], "v", {"m": 0.5}, 0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "ArrowEvalPython" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i int, v double")
    assert R.positions(none, ["k"], ["i"]).count() == 0 and R.smoothed(none, ["k"], ["i"], "v", 0.5, "y").count() == 0
    assert Q.rolling_quantile(none, ["k"], ["i"], "v", 9, 0.5, "q").count() == 0


def test_places_hold_in_a_union_and_in_fewer_tasks(spark, split):
    """In a union the second side's tasks have other numbers than its partitions; after coalesce a task reads several."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    at = R.positions(df, [], ["v"], "at")
    assert at.rdd.getNumPartitions() > 1
    for some in (df.select("v", F.lit(-1).cast("bigint").alias("at")).filter("v < 0").unionByName(at), at.coalesce(1), at.coalesce(2)):
        assert [(r.v, r.at) for r in some.orderBy("v").collect()] == [(v, v + 1) for v in range(5000)]
