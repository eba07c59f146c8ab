"""Queries over trajectories, sensors and the road graph, and time windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import matching as M
from ..operators import sequences as Q
from .base import edges, nodes, packets, points, query, sensors, table
from .experiments import q, r

K, O = ["traj_id"], ["step"]
NEAR = "packets points sensors nearest"


def own():
    return Q.over(K, O)


@query("region_filter", "SELECT traj_id, step, x, y FROM points WHERE x BETWEEN -130 AND 130 AND y BETWEEN -130 AND 130", "packets points")
def _(s, d):
    return points(s, d).filter("x BETWEEN -130 AND 130 AND y BETWEEN -130 AND 130").select("traj_id", "step", "x", "y")



def near(s, d):
    """Each point sees its nearest interior sensor only, even inside the radius of another."""
    return M.nearest_site(points(s, d), sensors(s, d).filter("role = 'interior'"))


@query("nearest_sensor", "SELECT traj_id, step, near.sensor_id, s.x AS sx, s.y AS sy, d2 FROM near JOIN sensors s USING (sensor_id)", NEAR)
def _(s, d):
    """The nearest sensor with its position and the squared distance."""
    at = sensors(s, d).select("sensor_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return near(s, d).join(at, "sensor_id").select("traj_id", "step", "sensor_id", "sx", "sy", F.col("d2").cast("bigint").alias("d2"))


SEEN = """inside AS (SELECT *, (d2 <= 625) AS ok FROM near), cg AS (SELECT *, CASE WHEN lag(ok) OVER w IS NOT DISTINCT FROM ok AND lag(sensor_id) OVER w IS NOT DISTINCT FROM sensor_id THEN 0 ELSE 1 END AS c FROM inside WINDOW w AS (PARTITION BY traj_id ORDER BY step)),
rg AS (SELECT *, sum(c) OVER (PARTITION BY traj_id ORDER BY step) AS run FROM cg),
visits AS (SELECT traj_id, sensor_id, min(step) AS enter, max(step) AS leave, min(d2) AS d2 FROM rg WHERE ok GROUP BY traj_id, run, sensor_id)"""


def visits(s, d):
    n = near(s, d).withColumn("ok", F.col("d2") <= 625)
    runs = Q.run_ids(n.withColumn("state", F.when(F.col("ok"), F.col("sensor_id")).otherwise(-1)), K, O, "state").filter("ok")
    return runs.groupBy("traj_id", "run", "sensor_id").agg(F.min("step").alias("enter"), F.max("step").alias("leave"), F.min("d2").alias("d2")).drop("run")



@query("coverage_fraction", f"SELECT traj_id, {q('avg((d2 <= 625)::INT)', 'coverage')} FROM near GROUP BY 1", NEAR)
def _(s, d):
    return near(s, d).groupBy("traj_id").agg(r(F.avg((F.col("d2") <= 625).cast("double")), "coverage"))




MOVES = "moves AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY step))"


def moves(s, d):
    return points(s, d).withColumns({"dx": F.col("x") - F.lag("x").over(own()), "dy": F.col("y") - F.lag("y").over(own())})


@query("integrate_speed", f"WITH {MOVES} SELECT traj_id, step, round(coalesce(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY traj_id ORDER BY step), 0) + 1e-9, 6) AS dist FROM moves", "packets points")
def _(s, d):
    m = moves(s, d)
    total = F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).over(own().rowsBetween(Window.unboundedPreceding, 0))
    return m.select("traj_id", "step", r(F.coalesce(total, F.lit(0.0)), "dist"))


@query("heading_hold", f"WITH {MOVES}, h AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN atan2(dy, dx) END AS h FROM moves) SELECT traj_id, step, round(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY step), 0) + 1e-9, 6) AS heading FROM h", "packets points")
def _(s, d):
    h = F.when(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") > 0, F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")))
    held = F.last("h", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0))
    return moves(s, d).withColumn("h", h).select("traj_id", "step", r(F.coalesce(held, F.lit(0.0)), "heading"))


@query("lagged_pose", "SELECT traj_id, step, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS lx, coalesce(lag(y, 2) OVER w, first_value(y) OVER w) AS ly FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY step)", "packets points")
def _(s, d):
    first = own().rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c, n: F.coalesce(F.lag(c, 2).over(own()), F.first(c).over(first)).alias(n)
    return points(s, d).select("traj_id", "step", at("x", "lx"), at("y", "ly"))


@query("active_window", "SELECT traj_id, min(step) AS first_step, max(step) AS last_step FROM points WHERE abs(x) <= 130 AND abs(y) <= 130 GROUP BY 1", "packets points")
def _(s, d):
    return points(s, d).filter("abs(x) <= 130 AND abs(y) <= 130").groupBy("traj_id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))



@query("stall_detect", "WITH b AS (SELECT *, lag(x, 3) OVER w AS px, lag(y, 3) OVER w AS py FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY step)) SELECT traj_id, step FROM b WHERE (x - px) * (x - px) + (y - py) * (y - py) < 64", "packets points")
def _(s, d):
    b = points(s, d).withColumns({"px": F.lag("x", 3).over(own()), "py": F.lag("y", 3).over(own())})
    return b.filter("(x - px) * (x - px) + (y - py) * (y - py) < 64").select("traj_id", "step")



@query("edge_geometry", f"SELECT edge_id, a, b, {q('sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay))', 'length')}, {q('atan2(ty - ay, tx - ax)', 'heading')} FROM edges", "nodes edges")
def _(s, d):
    dx, dy = (F.col("tx") - F.col("ax")).cast("double"), (F.col("ty") - F.col("ay")).cast("double")
    return edges(s, d).select("edge_id", "a", "b", r(F.sqrt(dx * dx + dy * dy), "length"), r(F.atan2(dy, dx), "heading"))




@query("node_partition", "SELECT node_id, CASE WHEN abs(x) <= 60 AND abs(y) <= 60 THEN 'interior' ELSE 'exterior' END AS side FROM nodes", "nodes")
def _(s, d):
    return nodes(s, d).select("node_id", F.when(F.expr("abs(x) <= 60 AND abs(y) <= 60"), "interior").otherwise("exterior").alias("side"))




HOUR = 3_600_000_000


@query("tumbling_window", f"SELECT epoch_us(ts) // {6 * HOUR} * {6 * HOUR} AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query("sliding_window", f"SELECT (epoch_us(ts) // {3 * HOUR} - k) * {3 * HOUR} AS start_us, count(*) AS n FROM events, range(2) t(k) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours", "3 hours")).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "n")


@query("session_window", f"""WITH g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS c FROM packets WINDOW w AS (PARTITION BY seq_id ORDER BY t_us, event_id)), k AS (SELECT *, sum(c) OVER (PARTITION BY seq_id ORDER BY t_us, event_id) AS k FROM g)
SELECT seq_id, min(t_us) AS start_us, max(t_us) + {6 * HOUR} AS end_us, count(*) AS n FROM k GROUP BY seq_id, k""", "packets")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("seq_id"), F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("seq_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return g.select("seq_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")
