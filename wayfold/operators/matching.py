"""Joins by position, time, distance and one-to-one assignment.

As-of joins run as one window over the union of both sides; band and radius joins first meet in buckets of the tolerance,
so no side is compared with all of the other; greedy matching folds clusters of candidates that share no time with others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import durable

Names = Sequence[str]


def positional_zip(left: DataFrame, right: DataFrame, keys: Names, index: str) -> DataFrame:
    """Rows of equal position, as many as the shorter side has."""
    return left.join(right, [*keys, index])


def length_guard(left: DataFrame, right: DataFrame, keys: Names, tolerance: float) -> DataFrame:
    """Row counts of both sides, and whether they drift by more than ``tolerance`` of the right side."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n_left")), right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    j = a.join(b, list(keys), "full").fillna(0, ["n_left", "n_right"])
    return j.withColumn("drift", F.abs(F.col("n_left") - F.col("n_right")) > tolerance * F.greatest("n_right", F.lit(1))).withColumn("n", F.least("n_left", "n_right"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Names, time: str, payload: str) -> DataFrame:
    """Each left row with the right row nearest in time, the earlier one in ties: columns near_<time>, near_<payload>."""
    both = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast("struct<t:bigint,v:bigint>").alias("_r"))
    other = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.struct(F.col(time).cast("bigint").alias("t"), F.col(payload).cast("bigint").alias("v")).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    u = both.unionByName(other)
    u = u.withColumns({"_p": F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    pick = F.when(F.col("_n").isNull() | (F.col("_t") - F.col("_p.t") <= F.col("_n.t") - F.col("_t")), F.col("_p")).otherwise(F.col("_n"))
    return u.filter("_side = 1").withColumn("_m", F.coalesce(pick, "_n")).select("_row.*", F.col("_m.t").alias(f"near_{time}"), F.col("_m.v").alias(f"near_{payload}"))


def band_join(left: DataFrame, right: DataFrame, keys: Names, lt: str, rt: str, tolerance: int) -> DataFrame:
    """Pairs with |lt - rt| <= tolerance, by buckets of the tolerance: a left row looks into three buckets."""
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lt) / tolerance) - 1, F.floor(F.col(lt) / tolerance) + 1)))
    b = right.withColumn("_b", F.floor(F.col(rt) / tolerance))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(lt) - F.col(rt)) <= tolerance).drop("_b")


def greedy_match(candidates: DataFrame, keys: Names, time: str, reach: float) -> DataFrame:
    """Greedy one-to-one matching of candidate rows (keys, delta, pi, gi, time): least (delta, pi, gi) first.

    Rows whose times differ by more than ``reach`` share neither side, so a sequence falls apart into clusters of time; a
    cluster is one short sorted array, folded on the JVM. Long sequences are many clusters, not one group."""
    w = Window.partitionBy(*keys).orderBy(time, "pi", "gi")
    gap = F.col(time) - F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = candidates.withColumn("_new", (F.coalesce(gap, F.lit(0)) > reach).cast("int")).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pair = F.struct("delta", "pi", "gi")
    clusters = marked.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(pair)).alias("_all"))

    def take(kept, x):
        free = ~F.exists(kept, lambda k: (k["pi"] == x["pi"]) | (k["gi"] == x["gi"]))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("_all", F.slice("_all", 1, 0), take)
    return clusters.select(*keys, F.inline(kept))


def nearest_site(points: DataFrame, sites: DataFrame, per_cell: float = 4.0) -> DataFrame:
    """Each point with its nearest site (lowest id in ties) and the squared distance.

    Distinct positions are looked up, once each, among distinct places of sites: of sites at one place the lowest id speaks
    for all. Each place goes to the cells of a square grid around its own up to a ring; a position is settled once a site lies
    within that ring, as no other can be nearer then. Those left look into a grid of sixteen times the cell; the last ring
    covers the box of everything. Positions, not points, move in these joins, and a cell of the finest grid holds about
    ``per_cell`` places."""
    s = sites.select("sensor_id", F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))
    s = durable(s.groupBy("sx", "sy").agg(F.min("sensor_id").alias("sensor_id")))
    box = s.agg(F.count("*").alias("n"), *[fn(c).alias(f"{k}{c}") for k, fn in (("lo", F.min), ("hi", F.max)) for c in ("sx", "sy")]).first()
    if not box.n:
        return points.withColumns({"sensor_id": F.lit(None).cast("bigint"), "d2": F.lit(None).cast("double")})
    todo = durable(points.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct())
    span = todo.agg(*[fn(c).alias(f"{k}{c}") for k, fn in (("lo", F.min), ("hi", F.max)) for c in ("_x", "_y")]).first()
    if span[0] is None:
        return points.withColumns({"sensor_id": F.lit(None).cast("bigint"), "d2": F.lit(None).cast("double")})
    width = max(box.hisx - box.losx, box.hisy - box.losy, 1.0)
    cell = max((width * width / box.n * per_cell) ** 0.5, 1e-6)
    far = max(abs(a - b) for a in (span.lo_x, span.hi_x) for b in (box.losx, box.hisx)) + max(abs(a - b) for a in (span.lo_y, span.hi_y) for b in (box.losy, box.hisy)) + 1.0
    d2 = (F.col("_x") - F.col("sx")) * (F.col("_x") - F.col("sx")) + (F.col("_y") - F.col("sy")) * (F.col("_y") - F.col("sy"))
    done = None
    while True:
        last = cell >= far
        around = lambda c: F.explode(F.array(*[F.floor(F.col(c) / cell) + k for k in (-1, 0, 1)]))  # noqa: B023, E731
        spread = s.withColumn("_cx", around("sx")).withColumn("_cy", around("sy"))
        placed = todo.withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
        # each ring is written, so the next one starts from its rows; the loop ends with the last open position
        best = durable(placed.join(spread, ["_cx", "_cy"], "left").groupBy("_x", "_y").agg(F.min(F.struct(d2.alias("d2"), F.col("sensor_id").alias("id"))).alias("_m")))
        near = F.coalesce(F.col("_m.d2") <= cell * cell, F.lit(False))
        got = best if last else best.filter(near)
        done = got if done is None else done.unionByName(got)
        todo, cell = best.filter(~near).select("_x", "_y"), cell * 16
        if last or todo.isEmpty():
            break
    found = done.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_m.id").alias("sensor_id"), F.col("_m.d2").alias("d2"))
    return points.join(found, ["x", "y"]).select(*points.columns, "sensor_id", "d2")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns; pairs in row order."""
    return solve(cost)[0]


def solve(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Least-cost assignment by shortest augmenting paths, with the prices of rows and columns: nowhere is their sum above the
    cost, and in all they add up to the total."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = np.concatenate([[np.inf], c[i0 - 1] - u[i0] - v[1:]])
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs), *((v[1:], u[1:]) if flip else (u[1:], v[1:]))


def last_wins(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
