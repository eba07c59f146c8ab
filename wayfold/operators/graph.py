"""Road graphs as tables: nearest edges and samples, crossings of a region, greedy placement of sensors, reachability,
routes, components. Edges are (edge_id, a, b, ax, ay, tx, ty): from node a to node b, with both end points."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import meet_in_blocks
from .ranks import positions
from .store import durable


def length() -> Column:
    dx, dy = F.col("tx") - F.col("ax"), F.col("ty") - F.col("ay")
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def at_range(r: Column) -> tuple[Column, Column]:
    """The point ``r`` metres along an edge."""
    share = r / length()
    return F.col("ax") + share * (F.col("tx") - F.col("ax")), F.col("ay") + share * (F.col("ty") - F.col("ay"))


def samples(edges: DataFrame, spacing: float = 0.5, least: float = 0.01) -> DataFrame:
    """Points along each edge, both ends included: (edge_id, k, r, x, y)."""
    n = F.greatest(F.lit(2), (length() / spacing).cast("int") + 1)
    t = F.col("k") / (F.col("n") - 1)
    e = edges.filter(length() >= least).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return e.select("edge_id", F.col("k").cast("bigint").alias("k"), (t * length()).alias("r"), (F.col("ax") + t * (F.col("tx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("ty") - F.col("ay"))).alias("y"))


def _look_around(points: DataFrame, edges: DataFrame, measured, names: list[str], cell: float = 25.0) -> DataFrame:
    """Each point (x, y) with the edge nearest to it (lowest id in ties) and ``names``. ``measured`` takes arrays of positions
    (n, 1) and of edges (ax, ay, dx, dy; 1, m) and gives the squared distances, then ``names`` but for edge_id.

    Edges lie in the grid cells of their boxes and one more on each side; distinct positions look into their own, in cells of
    four times the width until an edge is found within a cell's width. Edges beyond the box of the positions still open stay
    out of the join, so of a large graph only the surroundings of the positions move. Pairs are measured where blocks of both
    meet and never become rows."""
    todo = durable(points.select(F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).distinct())
    lo, hi = F.least, F.greatest
    box = edges.agg(F.min(lo("ax", "tx")).alias("x0"), F.max(hi("ax", "tx")).alias("x1"), F.min(lo("ay", "ty")).alias("y0"), F.max(hi("ay", "ty")).alias("y1")).first()
    lines = edges.select("edge_id", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "tx", "ty")])
    schema = "_x double, _y double, d2 double, edge_id bigint, " + ", ".join(f"{c} double" for c in names)

    def nearest(p: pa.Table, e: pa.Table) -> pa.Table:
        x, y = (p[c].to_numpy() for c in ("_x", "_y"))
        order = np.argsort(e["edge_id"].to_numpy())
        ids, ax, ay, tx, ty = (e[c].to_numpy()[order] for c in ("edge_id", "ax", "ay", "tx", "ty"))
        out = []
        for k in range(0, len(x) if len(ids) else 0, step := max(1, (1 << 17) // max(1, len(ids)))):
            some = slice(k, k + step)
            d2, *more = measured(x[some, None], y[some, None], ax[None], ay[None], (tx - ax)[None], (ty - ay)[None])
            best = d2.argmin(axis=1)  # the first of equals
            at = np.arange(len(best)), best
            out.append([x[some], y[some], d2[at], ids[best], *(m[at] for m in more)])
        kinds = [pa.int64() if c == "edge_id" else pa.float64() for c in ("_x", "_y", "d2", "edge_id", *names)]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_x", "_y", "d2", "edge_id", *names])

    done = None
    while True:
        span = todo.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
        if box.x0 is None or span[0] is None:
            break
        far = max(abs(a - b) for a in span[:2] for b in (box.x0, box.x1)) + max(abs(a - b) for a in span[2:] for b in (box.y0, box.y1)) + 1.0
        last = cell >= far
        first, end = (lambda a, b: F.floor(lo(a, b) / cell) - 1), (lambda a, b: F.floor(hi(a, b) / cell) + 1)  # noqa: B023, E731
        cells = [math.floor(v / cell) for v in span]
        met = lambda a, b, k: (end(a, b) >= cells[k]) & (first(a, b) <= cells[k + 1])  # noqa: B023, E731
        reach = lambda a, b, k: F.explode(F.sequence(F.greatest(first(a, b), F.lit(cells[k])), F.least(end(a, b), F.lit(cells[k + 1]))))  # noqa: B023, E731
        spread = lines.filter(met("ax", "tx", 0) & met("ay", "ty", 2)).withColumn("_cx", reach("ax", "tx", 0)).withColumn("_cy", reach("ay", "ty", 2))
        placed = todo.withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
        found = meet_in_blocks(placed, spread, ["_cx", "_cy"], nearest, schema, 16384, 16384)
        w = Window.partitionBy("_x", "_y").orderBy("d2", "edge_id")
        # each ring is written, so the next one starts from its rows; the loop ends with the last open position
        best = durable(found.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k"))
        got = best if last else best.filter(F.col("d2") <= cell * cell)
        done = got if done is None else done.unionByName(got)
        if last:
            break
        todo, cell = durable(todo.join(got, ["_x", "_y"], "left_anti")), cell * 4
        if todo.isEmpty():
            break
    if done is None:
        return points.limit(0).select("*", F.lit(None).cast("bigint").alias("edge_id"), *[F.lit(None).cast("double").alias(c) for c in names])
    found = done.select(F.col("_x").alias("x"), F.col("_y").alias("y"), "edge_id", *names)
    return points.join(found, ["x", "y"]).select(*points.columns, "edge_id", *names)


def _share(x, y, ax, ay, dx, dy):
    """Where the position lies along the edge, from 0 to 1."""
    square = dx * dx + dy * dy
    return np.where(square > 0, np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0), 0.0)


def snap(points: DataFrame, edges: DataFrame, spacing: float = 0.5, least: float = 0.01) -> DataFrame:
    """Each point (x, y) with its nearest sample (see ``samples``): edge_id, r, sx, sy; lowest edge and sample in ties.

    Samples are not listed: of an edge the nearest one lies just before or after the foot of the perpendicular."""

    def measured(x, y, ax, ay, dx, dy):
        size = np.sqrt(dx * dx + dy * dy)
        n = np.maximum(2, (size / spacing).astype(np.int64) + 1)
        before = np.minimum(np.floor(_share(x, y, ax, ay, dx, dy) * (n - 1)), n - 2)
        two = []
        for k in (before, before + 1):
            t = k / (n - 1)
            sx, sy = ax + t * dx, ay + t * dy
            two.append(((sx - x) * (sx - x) + (sy - y) * (sy - y), t * size, sx, sy))
        later = two[1][0] < two[0][0]
        return [np.where(later, b, a) for a, b in zip(*two)]

    return _look_around(points, edges.filter(length() >= least), measured, ["r", "sx", "sy"])


def project(points: DataFrame, edges: DataFrame, cell: float = 25.0) -> DataFrame:
    """Each point (x, y) with the nearest point of any edge: edge_id, px, py, distance; lowest edge in ties."""

    def measured(x, y, ax, ay, dx, dy):
        t = _share(x, y, ax, ay, dx, dy)
        px, py = ax + t * dx, ay + t * dy
        d2 = (px - x) * (px - x) + (py - y) * (py - y)
        return d2, px, py, np.sqrt(d2)

    return _look_around(points, edges, measured, ["px", "py", "distance"], cell)


# --- regions and placement ---------------------------------------------------------------------------------------------


def inside(x: Column, y: Column) -> Column:
    """In the closed box (x0, x1, y0, y1) of the row."""
    return x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1"))


def crossings(edges: DataFrame, regions: DataFrame, steps: int = 30) -> DataFrame:
    """Edges with one end inside a region (region, x0, x1, y0, y1): (region, edge_id, a, b, inward, cx, cy); the crossing is
    found by halving."""
    both = edges.join(F.broadcast(regions))
    start, end = inside(F.col("ax"), F.col("ay")), inside(F.col("tx"), F.col("ty"))
    c = both.filter(start != end).withColumn("inward", end)

    def half(s, _):
        m = (s["a"] + s["b"]) / 2
        same = inside(F.col("ax") + m * (F.col("tx") - F.col("ax")), F.col("ay") + m * (F.col("ty") - F.col("ay"))) != F.col("inward")
        return F.struct(F.when(same, m).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(m).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), half, lambda s: (s["a"] + s["b"]) / 2)
    t = c.withColumn("t", found)
    return t.select("region", "edge_id", "a", "b", "inward", (F.col("ax") + F.col("t") * (F.col("tx") - F.col("ax"))).alias("cx"), (F.col("ay") + F.col("t") * (F.col("ty") - F.col("ay"))).alias("cy"))


def _close(points: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """(region, p, q, gap): pairs of points of a region closer than ``radius``, p before q in their order ``_at``. Points meet
    in the cells of a grid as wide as the radius, so a join sees a point's surroundings only."""
    cell = lambda c: F.floor(F.col(c) / radius)
    one = points.select("region", F.col("_at").alias("p"), F.col(x).alias("px"), F.col(y).alias("py"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)]))
    two = points.select("region", F.col("_at").alias("q"), F.col(x).alias("qx"), F.col(y).alias("qy"), cell(x).alias("cx"), cell(y).alias("cy"))
    two = two.withColumn("cx", around("cx")).withColumn("cy", around("cy"))
    gap = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    return one.join(two, ["region", "cx", "cy"]).filter((F.col("p") < F.col("q")) & (gap < radius)).select("region", "p", "q", gap.alias("gap"))


def first_independent(points: DataFrame, close: DataFrame) -> DataFrame:
    """(region, p) of the points that a greedy pass in order would choose: a point is chosen once no open point before it is
    close, and then closes those after it. Rounds, not a fold: as many as the longest chain of close points in falling order
    (about the logarithm of the points where the order is a hash)."""
    open_, chosen = durable(points.select("region", F.col("_at").alias("p"))), None
    while True:
        links = close.join(open_, ["region", "p"]).join(open_.select("region", F.col("p").alias("q")), ["region", "q"])
        later = links.select("region", F.col("q").alias("p")).distinct()
        now = durable(open_.join(later, ["region", "p"], "left_anti"))
        chosen = now if chosen is None else chosen.unionByName(now)
        closed = close.join(now, ["region", "p"]).select("region", F.col("q").alias("p")).distinct()
        open_ = durable(open_.join(now, ["region", "p"], "left_anti").join(closed, ["region", "p"], "left_anti"))
        if open_.isEmpty():
            return chosen


def _in_order(points: DataFrame, order: list[str]) -> DataFrame:
    return durable(positions(points, ["region"], order, "_at"))


def merge_sites(points: DataFrame, radius: float, order: list[str]) -> DataFrame:
    """Greedy merging in the given order (x and y first): a point closer than ``radius`` to a placed site joins the nearest one
    (first in ties), else it becomes a site. Adds ``site`` (from 0) and ``placed``."""
    rows = _in_order(points, order)
    close = durable(_close(rows, order[0], order[1], radius))
    sites = durable(positions(first_independent(rows, close), ["region"], ["p"], "site").withColumn("site", F.col("site") - 1))
    nearest = close.join(sites, ["region", "p"]).groupBy("region", "q").agg(F.min(F.struct("gap", "site")).alias("m")).select("region", F.col("q").alias("_at"), F.col("m.site").alias("_near"))
    own = sites.select("region", F.col("p").alias("_at"), F.col("site").alias("_own"))
    out = rows.join(own, ["region", "_at"], "left").join(nearest, ["region", "_at"], "left")
    return out.withColumns({"site": F.coalesce("_own", "_near"), "placed": F.col("_own").isNotNull()}).drop("_at", "_own", "_near")


def spaced_sites(points: DataFrame, spacing: float, order: list[str]) -> DataFrame:
    """Greedy choice in the given order of points (x, y) at least ``spacing`` from all chosen before; adds ``site``."""
    rows = _in_order(points, order)
    chosen = first_independent(rows, durable(_close(rows, "x", "y", spacing)))
    site = positions(chosen, ["region"], ["p"], "site").select("region", F.col("p").alias("_at"), (F.col("site") - 1).alias("site"))
    return rows.join(site, ["region", "_at"]).drop("_at")


def thinned(sites: DataFrame, density: float) -> DataFrame:
    """A share of each region's sites in hash order, one at least, renumbered in order."""
    w = Window.partitionBy("region")
    keep = F.greatest(F.lit(1.0), F.rint(F.count("*").over(w) * density))
    some = sites.withColumn("_k", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", "region", "site"))))).filter(F.col("_k") <= keep) if density < 1 else sites
    return some.withColumn("site", (F.row_number().over(w.orderBy("site")) - 1).cast("bigint")).drop("_k")


# --- paths and components ------------------------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree, neighbours) of all nodes of the edges; neighbours sorted, either direction."""
    both = edges.select(F.col("a").alias("node_id"), F.col("b").alias("o"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("node_id"), F.col("a").alias("o"), F.lit(0).alias("out")))
    return both.groupBy("node_id").agg(F.sum("out").cast("bigint").alias("out_degree"), F.sum(1 - F.col("out")).cast("bigint").alias("in_degree"), F.array_sort(F.collect_set("o")).alias("neighbours"))


def reach(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node_id, distance, hops): least length over at most ``hops`` edges, and the edges of the shortest."""
    steps = edges.select(F.col("a").alias("node_id"), F.col("b"), length().alias("len"))
    all_ = front = sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("hops"))
    for k in range(hops):
        onward = front.join(steps, "node_id").select("source", F.col("b").alias("node_id"), (F.col("distance") + F.col("len")).alias("distance"), (F.col("hops") + 1).alias("hops"))
        best = onward.groupBy("source", "node_id").agg(F.min(F.struct("distance", "hops")).alias("m"))
        front = best.select("source", "node_id", "m.distance", "m.hops")
        all_ = all_.unionByName(front)
        if k % 8 == 7:
            front, all_ = durable(front), durable(all_)
    return all_.groupBy("source", "node_id").agg(F.min(F.struct("distance", "hops")).alias("m")).select("source", "node_id", "m.distance", "m.hops")


#: Hops between two checkpoints of a search.
HOPS = 6


def distances(edges: DataFrame, sources: DataFrame, width: float = 12.0, together: bool = False) -> DataFrame:
    """(source, node_id, distance) of all nodes that can be reached, over any number of edges; ``together`` counts all sources
    as one, numbered 0.

    Nodes are relaxed in buckets of ``width`` times the mean edge length: the nodes of the nearest open bucket go out until
    none of it improves, then the next bucket follows. Labels are written every ``HOPS`` hops, and the loop ends when no node
    waits. A hop moves the waiting nodes and their edges only."""
    steps = durable(edges.select(F.col("a").alias("node_id"), F.col("b"), length().alias("len")))
    mean = steps.agg(F.avg("len")).first()[0] or 1.0
    bucket = max(mean * width, 1e-9)
    source = F.lit(0).cast("bigint") if together else F.col("node_id")
    label = durable(sources.select(source.alias("source"), "node_id", F.lit(0.0).alias("distance"), F.lit(True).alias("waits")).distinct())
    def relaxed(label: DataFrame, end: float) -> DataFrame:
        goes = F.col("waits") & (F.col("distance") < end)
        out = label.filter(goes).join(steps, "node_id").select("source", F.col("b").alias("node_id"), (F.col("distance") + F.col("len")).alias("d"), F.lit(True).alias("new"))
        kept = label.select("source", "node_id", F.col("distance").alias("d"), F.lit(False).alias("new"), (F.col("waits") & ~goes).alias("w"))
        both = kept.unionByName(out, allowMissingColumns=True).groupBy("source", "node_id").agg(F.min("d").alias("distance"), F.min(F.when(~F.col("new"), F.col("d"))).alias("was"), F.max("w").alias("w"))
        waits = F.coalesce("w", F.lit(False)) | F.col("was").isNull() | (F.col("distance") < F.col("was"))
        return both.select("source", "node_id", "distance", waits.alias("waits"))

    while True:
        least = label.filter("waits").agg(F.min("distance")).first()[0]
        if least is None:
            return label.drop("waits")
        for _ in range(HOPS):
            label = relaxed(label, (int(least / bucket) + 1) * bucket)
        label = durable(label)


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(source, target, seq, edge_id, a, b, distance): the edges of the shortest way to each target that can be reached, in
    order from 0; of equally short ways the one whose last edges have the lowest ids. ``distance`` is that of the edge's end.

    The search keeps to nodes from which a target can be reached, found from the targets first. The edge before a node is
    recovered from the distances, then all ways are walked back at once, ``HOPS`` edges a round."""
    turned = edges.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.col("ax").alias("tx"), F.col("ay").alias("ty"))
    useful = distances(turned, targets.select("node_id").distinct(), together=True).select(F.col("node_id").alias("b"))
    edges = durable(edges.join(useful, "b", "left_semi"))
    far = distances(edges, sources)
    a = far.select("source", F.col("node_id").alias("a"), F.col("distance").alias("da"))
    b = far.select("source", F.col("node_id").alias("b"), F.col("distance").alias("db"))
    tight = edges.select("edge_id", "a", "b", length().alias("len")).join(a, "a").join(b, ["source", "b"]).filter((F.abs(F.col("da") + F.col("len") - F.col("db")) <= tolerance) & (F.col("db") > 0))
    before = durable(tight.groupBy("source", "b").agg(F.min(F.struct("edge_id", "a", "db")).alias("m")).select("source", "b", "m.edge_id", "m.a", "m.db"))
    at = durable(far.join(targets.select("node_id").distinct(), "node_id").filter(F.col("node_id") != F.col("source")).select("source", F.col("node_id").alias("target"), F.col("node_id").alias("b")))
    found, back = None, 0
    while not at.isEmpty():
        round_, ends = None, at
        for _ in range(HOPS):
            step = ends.join(before, ["source", "b"]).select("source", "target", F.lit(back).cast("bigint").alias("back"), "edge_id", "a", "b", F.col("db").alias("distance"))
            round_ = step if round_ is None else round_.unionByName(step)
            ends, back = step.filter(F.col("a") != F.col("source")).select("source", "target", F.col("a").alias("b")), back + 1
        round_ = durable(round_)
        at = round_.filter((F.col("back") == back - 1) & (F.col("a") != F.col("source"))).select("source", "target", F.col("a").alias("b"))
        found = round_ if found is None else found.unionByName(round_)
    if found is None:
        return before.limit(0).select("source", F.col("b").alias("target"), F.lit(0).cast("bigint").alias("seq"), "edge_id", "a", "b", F.col("db").alias("distance"))
    longest = Window.partitionBy("source", "target")
    return found.withColumn("seq", F.max("back").over(longest) - F.col("back")).select("source", "target", "seq", "edge_id", "a", "b", "distance")


def connected(links: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): least node reachable over links (keys, a, b), by label spreading with pointer jumps; rounds
    are as the logarithm of the longest chain, each a few shuffles of nodes and links."""
    both = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = durable(both)
    label = durable(nodes.select(*keys, F.col("node"), F.col("node").alias("component")).distinct())
    while True:
        other = label.select(*keys, F.col("node").alias("b"), F.col("component").alias("c"))
        seen = both.join(other, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = label.join(seen, [*keys, "node"], "left").select(*keys, "node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        roots = lower.select(*keys, F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lower.join(roots, [*keys, "component"], "left").select(*keys, "node", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        jumped = durable(jumped)
        label = jumped.drop("was")
        if jumped.filter("component <> was").isEmpty():
            return label


def route_topology(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each route (route_id, edge_id): edges, junctions (ends with several ways on), mean and largest branching,
    junctions a kilometre."""
    out = edges.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("ways"))
    e = routes.join(edges.select("edge_id", "b", length().alias("len")), "edge_id").join(out, "b", "left").fillna(0, ["ways"])
    junctions = F.count_if(F.col("ways") > 1)
    return e.groupBy("route_id").agg(F.count("*").alias("n_edges"), junctions.alias("n_junctions"), F.avg("ways").alias("mean_branch"), F.max("ways").alias("max_branch"), (junctions / F.greatest(F.sum("len") / 1000, F.lit(1e-6))).alias("junctions_per_km"))


def dissolve(clusters: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Clusters (keys, cluster, mass, x, y) with their ``target``: weak ones (mass under ``least``) join the strong one with
    the nearest centre; where none is strong, the heaviest counts as such."""
    w = Window.partitionBy(*keys)
    top = F.max(F.struct("mass", (-F.col("cluster")).alias("c"))).over(w)
    c = clusters.withColumn("strong", (F.col("mass") >= least) | ((F.max("mass").over(w) < least) & (-top["c"] == F.col("cluster"))))
    strong = c.filter("strong").select(*keys, F.col("cluster").alias("target"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    d = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    near = c.filter("not strong").join(strong, keys).groupBy(*keys, "cluster").agg(F.min_by("target", F.struct(d.alias("d"), "target")).alias("near"))
    return c.join(near, [*keys, "cluster"], "left").withColumn("target", F.coalesce("near", "cluster")).drop("near")
