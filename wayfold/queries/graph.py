"""Queries on the road graph: snapping, projection, crossings, placement, reachability, components, particle clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import readouts as R
from ..operators.matching import band_join
from .base import VIEWS, edges, nodes, points, query, table
from .experiments import q, r

LEN = "sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay))"
BOXES = ((0, -60.0, 60.0, -60.0, 60.0), (1, -100.0, 20.0, -100.0, 20.0), (2, -35.0, 95.0, -75.0, 55.0))
VIEWS["regions"] = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in BOXES) + ") t(region, x0, x1, y0, y1))"
VIEWS["crossings"] = """ends AS (SELECT r.region, e.edge_id, e.a, e.b, r.x0, r.x1, r.y0, r.y1, tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1 AS inward, ax, ay, tx, ty FROM edges e, regions r
  WHERE (ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1) <> (tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1)),
io AS (SELECT *, CASE WHEN inward THEN tx ELSE ax END AS ix, CASE WHEN inward THEN ty ELSE ay END AS iy, CASE WHEN inward THEN ax ELSE tx END AS ox, CASE WHEN inward THEN ay ELSE ty END AS oy FROM ends),
tt AS (SELECT *, least(CASE WHEN ox > x1 THEN (x1 - ix) / (ox - ix) WHEN ox < x0 THEN (x0 - ix) / (ox - ix) ELSE 1 END, CASE WHEN oy > y1 THEN (y1 - iy) / (oy - iy) WHEN oy < y0 THEN (y0 - iy) / (oy - iy) ELSE 1 END) AS t FROM io),
crossings AS (SELECT region, edge_id, a, b, inward, round(ix + t * (ox - ix), 6) AS cx, round(iy + t * (oy - iy), 6) AS cy FROM tt)"""


def regions(s):
    return s.createDataFrame(list(BOXES), "region int, x0 double, x1 double, y0 double, y1 double")


def crossings(s, d):
    c = G.crossings(edges(s, d), regions(s))
    return c.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("boundary_crossings", "SELECT region, edge_id, inward, cx, cy FROM crossings", "nodes edges regions crossings")
def _(s, d):
    return crossings(s, d).select("region", "edge_id", "inward", "cx", "cy")


@query("out_degree", "WITH u AS (SELECT a AS n, b AS o, 1 AS k FROM edges UNION ALL SELECT b, a, 0 FROM edges) SELECT n.node_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS out_degree, CAST(coalesce(sum(1 - k), 0) AS BIGINT) AS in_degree, coalesce(string_agg(DISTINCT lpad(o::VARCHAR, 9, '0'), ',' ORDER BY lpad(o::VARCHAR, 9, '0')), '') AS neighbours FROM nodes n LEFT JOIN u ON u.n = n.node_id GROUP BY 1", "nodes edges")
def _(s, d):
    g = nodes(s, d).select("node_id").join(G.degrees(edges(s, d)), "node_id", "left").fillna(0, ["out_degree", "in_degree"])
    names = F.transform("neighbours", lambda x: F.lpad(x.cast("string"), 9, "0"))
    return g.select("node_id", "out_degree", "in_degree", F.coalesce(F.array_join(names, ","), F.lit("")).alias("neighbours"))


@query("edge_neighbours", "SELECT DISTINCT e.edge_id, f.edge_id AS next_id FROM edges e JOIN edges f ON f.a IN (e.a, e.b) OR f.b IN (e.a, e.b)", "nodes edges")
def _(s, d):
    """Edges that share a node, either end, itself included."""
    ends = lambda name: edges(s, d).select(F.col("edge_id").alias(name), F.explode(F.array("a", "b")).alias("node"))
    return ends("edge_id").join(ends("next_id"), "node").select("edge_id", "next_id").distinct()


@query("xy_from_re", f"SELECT e.edge_id, t.k, round(ax + t.k * 0.15::DOUBLE * {LEN} / {LEN} * (tx - ax) + 1e-9, 6) AS x, round(ay + t.k * 0.15::DOUBLE * {LEN} / {LEN} * (ty - ay) + 1e-9, 6) AS y FROM edges e, range(7) t(k)", "nodes edges")
def _(s, d):
    """Points at seven ranges of each edge."""
    e = edges(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("k", F.col("k").cast("bigint"))
    x, y = G.at_range(F.col("k") * 0.15 * G.length())
    return e.select("edge_id", "k", r(x, "x"), r(y, "y"))


VIEWS["spots"] = "spots AS (SELECT DISTINCT x, y FROM points)"


@query("project_to_graph", f"""WITH c AS (SELECT p.x, p.y, e.edge_id, greatest(0, least(1, ((p.x - ax) * (tx - ax) + (p.y - ay) * (ty - ay)) / (({LEN}) * ({LEN})))) AS t, ax, ay, tx, ty FROM spots p, edges e),
d AS (SELECT x, y, edge_id, ax + t * (tx - ax) AS px, ay + t * (ty - ay) AS py FROM c), m AS (SELECT x, y, min((px - x) * (px - x) + (py - y) * (py - y)) AS d2 FROM d GROUP BY 1, 2)
SELECT x, y, {q('sqrt(d2)', 'distance')} FROM m""", "packets points spots nodes edges")
def _(s, d):
    """Distances; among several nearest edges the projected point may differ, the distance does not."""
    return G.project(points(s, d).select("x", "y").distinct(), edges(s, d)).select("x", "y", r("distance", "distance"))


@query("snap_to_edge", f"""WITH e AS (SELECT *, greatest(2, CAST(floor({LEN} / 0.5::DOUBLE) AS INT) + 1) AS n FROM edges), sm AS (SELECT edge_id, k, ax + k / (n - 1) * (tx - ax) AS sx, ay + k / (n - 1) * (ty - ay) AS sy FROM e, range(100) t(k) WHERE k < n)
SELECT x, y, {q('sqrt(min((sx - x) * (sx - x) + (sy - y) * (sy - y)))', 'distance')} FROM spots, sm GROUP BY 1, 2""", "packets points spots nodes edges")
def _(s, d):
    near = G.snap(points(s, d).select("x", "y").distinct(), edges(s, d))
    gap = F.sqrt((F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y")))
    return near.select("x", "y", r(gap, "distance"))


MERGED = """pts AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY cx, cy, edge_id) AS i FROM crossings),
g AS (SELECT region, i, edge_id, [cx] AS xs, [cy] AS ys, 0::BIGINT AS site FROM pts WHERE i = 1 UNION ALL SELECT region, i, edge_id, CASE WHEN m < 20 THEN xs ELSE list_append(xs, cx) END, CASE WHEN m < 20 THEN ys ELSE list_append(ys, cy) END, CASE WHEN m < 20 THEN list_position(ds, m) - 1 ELSE len(xs) END FROM (
  SELECT *, list_min(ds) AS m FROM (SELECT p.region, p.i, p.edge_id, p.cx, p.cy, g.xs, g.ys, list_transform(list_zip(g.xs, g.ys), lambda z: sqrt((z[1] - p.cx) * (z[1] - p.cx) + (z[2] - p.cy) * (z[2] - p.cy))) AS ds FROM g JOIN pts p ON p.region = g.region AND p.i = g.i + 1)))"""


@query("perimeter_sites", f"WITH RECURSIVE {MERGED} SELECT region, edge_id, CAST(site AS BIGINT) AS site, row_number() OVER (PARTITION BY region, site ORDER BY i) = 1 AS placed FROM g", "nodes edges regions crossings")
def _(s, d):
    c = crossings(s, d).select("region", "cx", "cy", "edge_id")
    return G.merge_sites(c, 20.0, ["cx", "cy", "edge_id"]).select("region", "edge_id", "site", "placed")


SPACED = f"""mids AS (SELECT r.region, e.edge_id, (ax + tx) / 2 AS x, (ay + ty) / 2 AS y, md5(e.edge_id || '|42') AS o FROM edges e, regions r WHERE {LEN} >= 1.5 AND (ax + tx) / 2 BETWEEN x0 + 30 AND x1 - 30 AND (ay + ty) / 2 BETWEEN y0 + 30 AND y1 - 30),
pts AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY o) AS i FROM mids),
g AS (SELECT region, i, edge_id, [x] AS xs, [y] AS ys, true AS ok FROM pts WHERE i = 1 UNION ALL SELECT region, i, edge_id, CASE WHEN m < 50 THEN xs ELSE list_append(xs, x) END, CASE WHEN m < 50 THEN ys ELSE list_append(ys, y) END, m >= 50 FROM (
  SELECT p.region, p.i, p.edge_id, p.x, p.y, g.xs, g.ys, list_min(list_transform(list_zip(g.xs, g.ys), lambda z: sqrt((z[1] - p.x) * (z[1] - p.x) + (z[2] - p.y) * (z[2] - p.y)))) AS m FROM g JOIN pts p ON p.region = g.region AND p.i = g.i + 1))"""


@query("interior_sites", f"WITH RECURSIVE {SPACED} SELECT region, edge_id, row_number() OVER (PARTITION BY region ORDER BY i) - 1 AS site FROM g WHERE ok", "nodes edges regions")
def _(s, d):
    """Middles of edges, 30 m within the region, 50 m apart, in the order of a hash."""
    mids = edges(s, d).filter(G.length() >= 1.5).select("edge_id", ((F.col("ax") + F.col("tx")) / 2).alias("x"), ((F.col("ay") + F.col("ty")) / 2).alias("y")).join(F.broadcast(regions(s)))
    inner = F.col("x").between(F.col("x0") + 30, F.col("x1") - 30) & F.col("y").between(F.col("y0") + 30, F.col("y1") - 30)
    c = mids.filter(inner).select("region", F.md5(F.concat_ws("|", "edge_id", F.lit("42"))).alias("o"), "edge_id", "x", "y")
    return G.spaced_sites(c, 50.0, ["o", "edge_id"]).select("region", "edge_id", "site")


@query("shortest_path_hops", f"""WITH RECURSIVE src AS (SELECT DISTINCT a AS node FROM crossings WHERE region = 0 AND inward), w AS (SELECT node AS source, node AS node_id, 0.0::DOUBLE AS d, 0 AS h FROM src
UNION ALL SELECT w.source, e.b, w.d + {LEN}, w.h + 1 FROM w JOIN edges e ON e.a = w.node_id WHERE w.h < 6) SELECT source, node_id, {q('min(d)', 'distance')}, CAST(min(h) AS BIGINT) AS hops FROM w GROUP BY 1, 2""", "nodes edges regions crossings")
def _(s, d):
    """Least lengths over six edges at most from where the region is entered; on equal edges also the fewest hops."""
    src = crossings(s, d).filter("region = 0 and inward").select(F.col("a").alias("node_id")).distinct()
    return G.reach(edges(s, d), src, 6).select("source", "node_id", r("distance", "distance"), "hops")


@query("shortest_paths", f"""WITH RECURSIVE src AS (SELECT DISTINCT a AS node FROM crossings WHERE region = 0 AND inward), dst AS (SELECT DISTINCT b AS node FROM crossings WHERE region = 2 AND NOT inward),
w AS (SELECT node AS source, node AS node_id, 0 AS h FROM src UNION SELECT w.source, e.b, w.h + 1 FROM w JOIN edges e ON e.a = w.node_id WHERE w.h < (SELECT count(*) // 14 + 40 FROM nodes)),
far AS (SELECT source, node_id, min(h) * 20.0::DOUBLE AS d FROM w GROUP BY 1, 2), pre AS (SELECT a.source, e.b, min(e.edge_id) AS edge_id FROM edges e JOIN far a ON a.node_id = e.a JOIN far b ON b.source = a.source AND b.node_id = e.b WHERE a.d + 20 = b.d AND b.d > 0 GROUP BY 1, 2),
p AS (SELECT f.source, f.node_id AS target, f.node_id AS at, CAST(NULL AS BIGINT) AS edge_id, f.d, 0 AS k FROM far f JOIN dst ON dst.node = f.node_id WHERE f.node_id <> f.source UNION ALL
  SELECT p.source, p.target, e.a, pre.edge_id, far.d, p.k + 1 FROM p JOIN pre ON pre.source = p.source AND pre.b = p.at JOIN edges e ON e.edge_id = pre.edge_id JOIN far ON far.source = p.source AND far.node_id = p.at)
SELECT source, target, max(k) OVER (PARTITION BY source, target) - k AS seq, edge_id, {q('d', 'distance')} FROM p WHERE edge_id IS NOT NULL""", "nodes edges regions crossings")
def _(s, d):
    """Edges of the shortest ways from where one region is entered to where another is left, over any number of edges."""
    c = crossings(s, d)
    src = c.filter("region = 0 and inward").select(F.col("a").alias("node_id")).distinct()
    dst = c.filter("region = 2 and not inward").select(F.col("b").alias("node_id")).distinct()
    return G.shortest_paths(edges(s, d), src, dst).select("source", "target", "seq", "edge_id", r("distance", "distance"))


@query("route_topology", f"""WITH rt AS (SELECT CAST(a // 14 AS BIGINT) AS route_id, edge_id, b, {LEN} AS len FROM edges WHERE b = a + 1), o AS (SELECT a, count(*) AS ways FROM edges GROUP BY 1), j AS (SELECT rt.*, coalesce(ways, 0) AS ways FROM rt LEFT JOIN o ON o.a = rt.b)
SELECT route_id, count(*) AS n_edges, count(*) FILTER (ways > 1) AS n_junctions, {q('avg(ways)', 'mean_branch')}, max(ways) AS max_branch, {q('count(*) FILTER (ways > 1) / greatest(sum(len) / 1000, 1e-6)', 'junctions_per_km')} FROM j GROUP BY 1""", "nodes edges")
def _(s, d):
    e = edges(s, d)
    routes = e.filter("b = a + 1").select(F.floor(F.col("a") / 14).cast("bigint").alias("route_id"), "edge_id")
    return G.route_topology(routes, e).select("route_id", "n_edges", "n_junctions", r("mean_branch", "mean_branch"), "max_branch", r("junctions_per_km", "junctions_per_km"))


# --- particle clouds -----------------------------------------------------------------------------------------------------

VIEWS["cloud"] = """cloud AS (SELECT vec_id % 5 AS cloud, vec_id, embedding[1]::DOUBLE * 400 AS x, embedding[2]::DOUBLE * 400 AS y, label AS edge, CAST(vec_id % 17 + 1 AS DOUBLE) AS weight FROM embeddings),
share AS (SELECT *, weight / sum(weight) OVER (PARTITION BY cloud) AS w FROM cloud)"""


def cloud(s, d):
    """Embeddings as weighted particles: position, edge, weight of five clouds."""
    e = table(s, d, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double") * 400
    c = e.select((F.col("vec_id") % 5).alias("cloud"), "vec_id", at(0).alias("x"), at(1).alias("y"), F.col("label").alias("edge"), (F.col("vec_id") % 17 + 1).cast("double").alias("weight"))
    return R.normalised(c, ["cloud"])


@query("readout_weighted_mean", f"SELECT cloud, {q('sum(w * x)', 'x')}, {q('sum(w * y)', 'y')} FROM share GROUP BY 1", "cloud")
def _(s, d):
    return R.weighted_mean(cloud(s, d), ["cloud"]).select("cloud", r("x", "x"), r("y", "y"))


@query("readout_map", f"SELECT cloud, vec_id, {q('x', 'x')}, {q('y', 'y')} FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY w DESC, vec_id) AS k FROM share) WHERE k = 1", "cloud")
def _(s, d):
    return R.heaviest(cloud(s, d), ["cloud"], "vec_id").select("cloud", "vec_id", r("x", "x"), r("y", "y"))


MODES = "m AS (SELECT cloud, edge, sum(w) AS mass, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM share GROUP BY 1, 2), n AS (SELECT a.cloud, a.edge, sum(b.mass) AS score FROM m a JOIN m b ON b.cloud = a.cloud AND abs(b.edge - a.edge) <= 1 GROUP BY 1, 2)"


@query("readout_mode", f"""WITH {MODES}, d AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY round(mass, 12) DESC, edge) AS k FROM m), h AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY round(score, 12) DESC, edge) AS k FROM n)
SELECT d.cloud, d.edge, {q('d.x', 'x')}, {q('d.y', 'y')}, h.edge AS hop_edge, {q('m.x', 'hop_x')}, {q('m.y', 'hop_y')} FROM d JOIN h ON h.cloud = d.cloud AND h.k = 1 JOIN m ON m.cloud = h.cloud AND m.edge = h.edge WHERE d.k = 1""", "cloud")
def _(s, d):
    """The mean on the heaviest edge, and on the edge whose neighbourhood is heaviest (edges in a row are neighbours)."""
    labels = table(s, d, "embeddings").select(F.col("label").alias("edge")).distinct()
    near = labels.select("edge", F.explode(F.array(F.col("edge") - 1, "edge", F.col("edge") + 1)).alias("neighbour"))
    return R.modes(cloud(s, d), ["cloud"], near).select("cloud", "edge", r("x", "x"), r("y", "y"), "hop_edge", r("hop_x", "hop_x"), r("hop_y", "hop_y"))


@query("posterior_diagnostics", f"""WITH {MODES}, k AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY mass DESC) AS k FROM m), c AS (SELECT cloud, sum(w * x) AS mx, sum(w * y) AS my FROM share GROUP BY 1),
e AS (SELECT s.cloud, 1 / sum(w * w) / count(*) AS ess, max(w) - min(w) <= 1e-12 AS uniform, sqrt(sum(w * ((x - mx) * (x - mx) + (y - my) * (y - my)))) AS spread FROM share s JOIN c ON c.cloud = s.cloud GROUP BY 1)
SELECT e.cloud, (SELECT count(*) FROM m WHERE m.cloud = e.cloud) AS n_edges, round((SELECT max(mass) FROM k WHERE k.cloud = e.cloud AND k = 1) + 1e-9, 6) AS top_mass, round(coalesce((SELECT max(mass) FROM k WHERE k.cloud = e.cloud AND k = 2), 0) + 1e-9, 6) AS second_mass, {q('ess', 'ess')}, uniform, {q('spread', 'spread')} FROM e""", "cloud")
def _(s, d):
    return R.diagnostics(cloud(s, d), ["cloud"]).select("cloud", "n_edges", r("top_mass", "top_mass"), r("second_mass", "second_mass"), r("ess", "ess"), "uniform", r("spread", "spread"))


@query("dissolve_clusters", f"""WITH {MODES}, t AS (SELECT *, max(mass) OVER (PARTITION BY cloud) AS top FROM m), s AS (SELECT *, mass >= 0.11 OR (top < 0.11 AND row_number() OVER (PARTITION BY cloud ORDER BY mass DESC, edge) = 1) AS strong FROM t),
j AS (SELECT a.cloud, a.edge, arg_min(b.edge, {{'d': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 'e': b.edge}}) AS target FROM s a JOIN s b ON b.cloud = a.cloud AND b.strong WHERE NOT a.strong GROUP BY 1, 2)
SELECT s.cloud, s.edge, s.strong, coalesce(j.target, s.edge) AS target FROM s LEFT JOIN j ON j.cloud = s.cloud AND j.edge = s.edge""", "cloud")
def _(s, d):
    m = R.edge_means(cloud(s, d), ["cloud"]).withColumnRenamed("edge", "cluster")
    return G.dissolve(m, ["cloud"], 0.11).select("cloud", F.col("cluster").alias("edge"), "strong", "target")


@query("topk_modes", f"""WITH {MODES}, t AS (SELECT *, max(mass) OVER (PARTITION BY cloud) AS top FROM m), s AS (SELECT *, mass >= 0.11 OR (top < 0.11 AND row_number() OVER (PARTITION BY cloud ORDER BY mass DESC, edge) = 1) AS strong FROM t),
j AS (SELECT a.cloud, a.edge, arg_min(b.edge, {{'d': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 'e': b.edge}}) AS target FROM s a JOIN s b ON b.cloud = a.cloud AND b.strong WHERE NOT a.strong GROUP BY 1, 2),
f AS (SELECT s.cloud, s.edge, s.mass, s.x, s.y, coalesce(j.target, s.edge) AS target FROM s LEFT JOIN j ON j.cloud = s.cloud AND j.edge = s.edge),
g AS (SELECT cloud, target, sum(mass) AS mass, sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y FROM f GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY round(mass, 12) DESC, target) AS k FROM g)
SELECT cloud, k AS rk, target, round(mass / sum(mass) OVER (PARTITION BY cloud) + 1e-9, 6) AS mass, {q('x', 'x')}, {q('y', 'y')} FROM k WHERE k <= 3""", "cloud")
def _(s, d):
    """The three heaviest modes once weak ones are dissolved, with masses that add up to one."""
    m = R.edge_means(cloud(s, d), ["cloud"]).withColumnRenamed("edge", "cluster")
    return R.top_modes(G.dissolve(m, ["cloud"], 0.11), ["cloud"], 3).select("cloud", "rk", "target", r("mass", "mass"), r("x", "x"), r("y", "y"))


OCCUPIED = "occ AS (SELECT DISTINCT c.cloud, e.edge_id, e.a, e.b FROM cloud c JOIN edges e ON e.a = c.edge * 13 + c.cloud)"
VIEWS["occupied"] = OCCUPIED


@query("graph_components", """WITH RECURSIVE l AS (SELECT DISTINCT p.cloud, p.edge_id AS e, q.edge_id AS f FROM occ p JOIN occ q ON q.cloud = p.cloud AND (q.a IN (p.a, p.b) OR q.b IN (p.a, p.b))),
w AS (SELECT cloud, edge_id AS e, edge_id AS f FROM occ UNION SELECT w.cloud, w.e, l.f FROM w JOIN l ON l.cloud = w.cloud AND l.e = w.f) SELECT cloud, e AS edge_id, min(f) AS component FROM w GROUP BY 1, 2""", "cloud nodes edges occupied")
def _(s, d):
    """Occupied edges joined by shared nodes."""
    pick = cloud(s, d).select("cloud", (F.col("edge") * 13 + F.col("cloud")).alias("a")).distinct()
    occ = edges(s, d).join(pick, "a").select("cloud", "edge_id", "a", "b").distinct()
    ends = lambda name: occ.select("cloud", F.col("edge_id").alias(name), F.explode(F.array("a", "b")).alias("n"))
    links = ends("a").join(ends("b"), ["cloud", "n"]).filter("a < b").select("cloud", "a", "b")
    return G.connected(links, occ.select("cloud", F.col("edge_id").alias("node")), ["cloud"]).select("cloud", F.col("node").alias("edge_id"), "component")


@query("euclid_components", """WITH RECURSIVE l AS (SELECT p.cloud, p.vec_id AS e, q.vec_id AS f FROM cloud p JOIN cloud q ON q.cloud = p.cloud AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 144),
w AS (SELECT cloud, vec_id AS e, vec_id AS f FROM cloud UNION SELECT w.cloud, w.e, l.f FROM w JOIN l ON l.cloud = w.cloud AND l.e = w.f AND l.f < w.e) SELECT cloud, e AS vec_id, min(f) AS low FROM w GROUP BY 1, 2""".replace("AND l.f < w.e", ""), "cloud")
def _(s, d):
    """Particles within 12 m of each other, over chains; candidates meet in bands of x."""
    c = cloud(s, d)
    a, b = (c.select("cloud", F.col("vec_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in ("a", "b"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    links = band_join(a, b, ["cloud"], "ax", "bx", 12).filter((F.col("a") < F.col("b")) & (d2 <= 144)).select("cloud", "a", "b")
    return G.connected(links, c.select("cloud", F.col("vec_id").alias("node")), ["cloud"]).select("cloud", F.col("node").alias("vec_id"), F.col("component").alias("low"))


@query("systematic_resample", "WITH c AS (SELECT *, sum(w) OVER (PARTITION BY cloud ORDER BY vec_id) AS hi, sum(w) OVER (PARTITION BY cloud ORDER BY vec_id) - w AS lo, count(*) OVER (PARTITION BY cloud) AS n, row_number() OVER (PARTITION BY cloud ORDER BY vec_id DESC) AS back FROM share) SELECT cloud, vec_id, CAST(greatest(0, CASE WHEN back = 1 THEN n ELSE ceil(round(hi * n - 0.37::DOUBLE, 9)) END - greatest(0, ceil(round(lo * n - 0.37::DOUBLE, 9)))) AS BIGINT) AS copies FROM c", "cloud")
def _(s, d):
    """How often each particle is drawn by evenly spaced positions (offset 0.37): from cumulative weights, without a loop."""
    return R.systematic(cloud(s, d), ["cloud"], "vec_id", 0.37).select("cloud", "vec_id", "copies")
