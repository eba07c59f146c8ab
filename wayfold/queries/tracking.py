"""Queries on oracle events, their corruption, trackers and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import matching as M
from ..operators import particles as PF
from ..operators import sequences as Q
from ..operators import simulation as X
from ..operators import trackers as T
from .base import VIEWS, edges, packets, points, query, sensors, table
from .experiments import q, r
from .geometry import NEAR, near, own

K, O = ["traj_id"], ["step"]
UNIFORM = "(('0x' || substr(md5({0}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"


def uni(*parts: str) -> str:
    """DuckDB's twin of the counter uniform."""
    return UNIFORM.format(" || '|' || ".join(p if p.startswith("'") else f"({p})::VARCHAR" for p in parts))


def normal_sql(*parts: str) -> str:
    return f"sqrt(-2 * ln({uni(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uni(*parts, chr(39) + 'b' + chr(39))})"


VIEWS["visits"] = """inside AS (SELECT *, (d2 <= 625) AS ok FROM near), cg AS (SELECT *, CASE WHEN lag(ok) OVER w IS NOT DISTINCT FROM ok AND lag(sensor_id) OVER w IS NOT DISTINCT FROM sensor_id THEN 0 ELSE 1 END AS c FROM inside WINDOW w AS (PARTITION BY traj_id ORDER BY step)),
rg AS (SELECT *, sum(c) OVER (PARTITION BY traj_id ORDER BY step) AS run FROM cg),
visits AS (SELECT v.*, s.x AS sx, s.y AS sy FROM (SELECT traj_id, sensor_id, min(step) AS enter, max(step) AS leave, arg_min(step, {'d': d2, 's': step}) AS step, arg_min(t_us, {'d': d2, 's': step}) AS t_us, min(d2) AS d2 FROM rg WHERE ok GROUP BY traj_id, run, sensor_id) v JOIN sensors s USING (sensor_id))"""
VIEWS["active"] = "active AS (SELECT traj_id, min(step) AS lo, max(step) AS hi, min(t_us) AS t_in, max(t_us) AS t_out FROM points WHERE abs(x) <= 130 AND abs(y) <= 130 GROUP BY 1)"
SEEN = f"{NEAR} visits"


def visits(s, d):
    """Runs of points that see their nearest sensor, with the first closest step."""
    n = near(s, d).withColumn("ok", F.col("d2") <= 625)
    runs = Q.run_ids(n.withColumn("state", F.when(F.col("ok"), F.col("sensor_id")).otherwise(-1)), K, O, "state").filter("ok")
    first = F.struct("d2", "step")
    v = runs.groupBy("traj_id", "run", "sensor_id").agg(F.min("step").alias("enter"), F.max("step").alias("leave"), F.min_by("step", first).alias("step"), F.min_by("t_us", first).alias("t_us"), F.min("d2").alias("d2")).drop("run")
    return v.join(sensors(s, d).select("sensor_id", F.col("x").alias("sx"), F.col("y").alias("sy")), "sensor_id")


def active(s, d):
    return points(s, d).filter("abs(x) <= 130 AND abs(y) <= 130").groupBy("traj_id").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.min("t_us").alias("t_in"), F.max("t_us").alias("t_out"))


@query("interior_events", "SELECT traj_id, sensor_id, enter, leave, step, t_us, CAST(d2 AS BIGINT) AS d2 FROM visits", SEEN)
def _(s, d):
    return visits(s, d).select("traj_id", "sensor_id", "enter", "leave", "step", "t_us", F.col("d2").cast("bigint").alias("d2"))


@query("event_count_summary", f"WITH n AS (SELECT p.traj_id, count(v.step) AS n FROM (SELECT DISTINCT traj_id FROM points) p LEFT JOIN visits v USING (traj_id) GROUP BY 1) SELECT count(*) AS n_traj, {q('avg(n)', 'mean')}, {q('quantile_cont(n, 0.5)', 'median')}, min(n) AS least, max(n) AS most, {q('avg((n = 0)::INT)', 'share_zero')} FROM n", SEEN)
def _(s, d):
    """Trajectories without events count as zero; counted by value before the median is read."""
    n = points(s, d).select("traj_id").distinct().join(visits(s, d).groupBy("traj_id").agg(F.count("*").alias("n")), "traj_id", "left").fillna(0, ["n"])
    h, m = n.groupBy("n").agg(F.count("*").alias("m")), F.col("m")
    each = lambda v: F.sum(m * v) / F.sum(m)
    return h.agg(F.sum(m).alias("n_traj"), r(each(F.col("n")), "mean"), r(F.percentile("n", 0.5, m), "median"), F.min("n").alias("least"), F.max("n").alias("most"), r(each((F.col("n") == 0).cast("int")), "share_zero"))


@query("blind_gap", "WITH t AS (SELECT traj_id, t_in AS t FROM active UNION ALL SELECT traj_id, t_out FROM active UNION ALL SELECT v.traj_id, v.t_us FROM visits v JOIN active USING (traj_id)), g AS (SELECT traj_id, t - lag(t) OVER (PARTITION BY traj_id ORDER BY t) AS g FROM t) SELECT traj_id, max(g) AS gap_us FROM g GROUP BY 1", f"{SEEN} active")
def _(s, d):
    """Longest time between entry, events and exit."""
    a = active(s, d)
    t = a.select("traj_id", F.explode(F.array("t_in", "t_out")).alias("t")).unionByName(visits(s, d).join(a.select("traj_id"), "traj_id", "left_semi").select("traj_id", F.col("t_us").alias("t")))
    g = t.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("traj_id").orderBy("t")))
    return g.groupBy("traj_id").agg(F.max("g").alias("gap_us"))


@query("trim_active", f"WITH k AS (SELECT p.traj_id, p.step, p.x, p.y, a.lo, a.hi FROM points p JOIN active a ON a.traj_id = p.traj_id AND p.step <= a.hi + 8) SELECT traj_id, count(*) AS n_steps, min(lo) AS active_start, min(hi) AS active_end, {q('sum(len)', 'length')} FROM (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS len FROM k WINDOW w AS (PARTITION BY traj_id ORDER BY step)) GROUP BY 1", "packets points active")
def _(s, d):
    """Points up to eight steps past the last one inside, and what is left of the path."""
    k = points(s, d).join(active(s, d), "traj_id").filter("step <= hi + 8")
    dx, dy = (F.col(c) - F.lag(c).over(own()) for c in ("x", "y"))
    k = k.withColumn("len", F.sqrt((dx * dx + dy * dy).cast("double")))
    return k.groupBy("traj_id").agg(F.count("*").alias("n_steps"), F.min("lo").alias("active_start"), F.min("hi").alias("active_end"), r(F.sum("len"), "length"))


# --- vehicles together -------------------------------------------------------------------------------------------------

PAIRS = "pr AS (SELECT a.traj_id % 10 AS scenario, a.traj_id AS a, b.traj_id AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, least(a.hi - a.lo, b.hi - b.lo) AS shortest FROM active a JOIN active b ON a.traj_id % 10 = b.traj_id % 10 AND a.traj_id < b.traj_id)"


def pairs(s, d):
    a = active(s, d).withColumn("scenario", F.col("traj_id") % 10)
    side = lambda n: a.select("scenario", F.col("traj_id").alias(n), F.col("lo").alias(f"{n}lo"), F.col("hi").alias(f"{n}hi"))
    p = side("a").join(side("b"), "scenario").filter("a < b")
    return p.select("scenario", "a", "b", F.greatest("alo", "blo").alias("lo"), F.least("ahi", "bhi").alias("hi"), F.least(F.col("ahi") - F.col("alo"), F.col("bhi") - F.col("blo")).alias("shortest"))


@query("pairwise_overlap", f"WITH {PAIRS} SELECT scenario, count(*) AS n_pairs, {q('min(greatest(0, hi - lo) / greatest(shortest, 1e-6))', 'worst')} FROM pr GROUP BY 1", "packets points active")
def _(s, d):
    """Least share of the shorter active window that two vehicles of a scenario spend together."""
    share = F.greatest(F.lit(0), F.col("hi") - F.col("lo")) / F.greatest(F.col("shortest"), F.lit(1e-6))
    return pairs(s, d).groupBy("scenario").agg(F.count("*").alias("n_pairs"), r(F.min(share), "worst"))


@query("closest_approach", f"WITH {PAIRS} SELECT pr.scenario, pr.a, pr.b, {q('sqrt(min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)))', 'distance')} FROM pr JOIN points p ON p.traj_id = pr.a AND p.step BETWEEN pr.lo AND pr.hi JOIN points o ON o.traj_id = pr.b AND o.step = p.step WHERE pr.hi > pr.lo GROUP BY 1, 2, 3", "packets points active")
def _(s, d):
    """Least distance at one step of the common active window; the result has a row for each pair, so it grows with the square
    of a scenario's vehicles. Vehicles meet in blocks, and only the pairs of the result become rows."""
    inside = points(s, d).join(active(s, d), "traj_id").filter("step between lo and hi")
    way = inside.groupBy("traj_id").agg(F.collect_list("step").alias("steps"), F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    near = X.closest(way.withColumn("scenario", F.col("traj_id") % 10), "scenario")
    return near.select("scenario", "a", "b", r(F.sqrt("d2"), "distance"))


@query("densify_grid", "WITH m AS (SELECT traj_id % 10 AS scenario, max(step) AS last FROM points GROUP BY 1), g AS (SELECT t.traj_id, k.step FROM (SELECT DISTINCT traj_id FROM points) t JOIN m ON m.scenario = t.traj_id % 10, range(1000) k(step) WHERE k.step <= m.last) SELECT g.traj_id, g.step, p.x, p.y FROM g LEFT JOIN points p ON p.traj_id = g.traj_id AND p.step = g.step", "packets points")
def _(s, d):
    """Vehicles of a scenario on one grid of steps; null past a vehicle's end."""
    p = points(s, d).select("traj_id", "step", "x", "y").withColumn("scenario", F.col("traj_id") % 10)
    ends = p.groupBy("scenario").agg(F.max("step").alias("last"))
    grid = p.select("scenario", "traj_id").distinct().join(ends, "scenario").select("traj_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("step"))
    return grid.join(p.drop("scenario"), ["traj_id", "step"], "left")


@query("entity_history", "SELECT traj_id, string_agg(step || ':' || x || ':' || y, ' ' ORDER BY step) AS history FROM points GROUP BY 1", "packets points")
def _(s, d):
    """The ordered positions of each vehicle as one list."""
    p = points(s, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("h"))
    return p.select("traj_id", F.array_join(F.transform("h", lambda e: F.concat_ws(":", e["step"], e["x"], e["y"])), " ").alias("history"))


VIEWS["assoc"] = "assoc AS (SELECT seq_id % 10 AS scenario, seq_id % 3 AS truth, nullif(event_id % 4, 3) AS assigned, event_id % 11 = 0 AS ghost, t_us, event_id FROM packets)"


def assoc(s, d):
    e = F.col("event_id")
    return packets(s, d).select((F.col("seq_id") % 10).alias("scenario"), (F.col("seq_id") % 3).alias("truth"), F.nullif(e % 4, F.lit(3)).alias("assigned"), (e % 11 == 0).alias("ghost"), "t_us", "event_id")


@query("association_metrics", f"SELECT scenario, count(*) FILTER (NOT ghost) AS n_real, count(*) FILTER (ghost) AS n_ghost, {q('count(*) FILTER (NOT ghost AND assigned = truth) / nullif(count(*) FILTER (NOT ghost), 0)', 'accuracy')}, count(*) FILTER (NOT ghost AND assigned IS NULL) AS rejected, {q('count(*) FILTER (ghost AND assigned IS NULL) / nullif(count(*) FILTER (ghost), 0)', 'ghosts_rejected')} FROM assoc GROUP BY 1", "packets assoc")
def _(s, d):
    real, none = ~F.col("ghost"), F.col("assigned").isNull()
    ratio = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    right = real & (F.col("assigned") == F.col("truth"))
    return assoc(s, d).groupBy("scenario").agg(F.count_if(real).alias("n_real"), F.count_if("ghost").alias("n_ghost"), r(ratio(right, real), "accuracy"), F.count_if(real & none).alias("rejected"), r(ratio(F.col("ghost") & none, F.col("ghost")), "ghosts_rejected"))


@query("id_switches", "WITH a AS (SELECT *, lag(assigned) OVER (PARTITION BY scenario, truth ORDER BY t_us, event_id) AS before FROM assoc WHERE NOT ghost AND assigned IS NOT NULL) SELECT scenario, truth, count(*) FILTER (before IS NOT NULL AND before <> assigned) AS switches FROM a GROUP BY 1, 2", "packets assoc")
def _(s, d):
    """Changes between consecutive assignments of a true vehicle; rejected events do not break the chain."""
    before = F.lag("assigned").over(Window.partitionBy("scenario", "truth").orderBy("t_us", "event_id"))
    a = assoc(s, d).filter("not ghost and assigned is not null").withColumn("before", before)
    return a.groupBy("scenario", "truth").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("assigned"))).alias("switches"))


@query("stream_digest", "SELECT traj_id, count(*) AS n, substr(sha1(string_agg(step || ',' || sensor_id || ',' || t_us, ';' ORDER BY step, sensor_id)), 1, 16) AS digest FROM visits GROUP BY 1", SEEN)
def _(s, d):
    """A digest of each ordered event stream; equal streams have equal digests whatever order their rows come in."""
    rows = F.array_sort(F.collect_list(F.struct("step", "sensor_id", "t_us")))
    text = F.array_join(F.transform("rows", lambda e: F.concat_ws(",", e["step"], e["sensor_id"], e["t_us"])), ";")
    return visits(s, d).groupBy("traj_id").agg(F.count("*").alias("n"), rows.alias("rows")).select("traj_id", "n", F.substring(F.sha1(text), 1, 16).alias("digest"))


# --- oracle events and their corruption ----------------------------------------------------------------------------------

VIEWS["perimeter"] = f"""near_p AS (SELECT e.traj_id, e.kind, e.step, e.t_us, e.x, e.y, arg_min(s.sensor_id, {{'d': (e.x - s.x) * (e.x - s.x) + (e.y - s.y) * (e.y - s.y), 'i': s.sensor_id}}) AS sensor_id FROM (
  SELECT p.traj_id, k.kind, p.step, p.t_us, p.x, p.y FROM active a, (VALUES ('entry'), ('exit')) k(kind) JOIN points p ON p.traj_id = a.traj_id AND p.step = CASE WHEN k.kind = 'entry' THEN a.lo ELSE a.hi END) e, sensors s WHERE s.role = 'perimeter' GROUP BY ALL),
perimeter AS (SELECT traj_id, kind, step, t_us, sensor_id, x AS px, y AS py, x + 2 * {normal_sql('traj_id', 'kind', "'x'")} AS zx, y + 2 * {normal_sql('traj_id', 'kind', "'y'")} AS zy FROM near_p)"""
PERIMETER = f"{SEEN} active perimeter"


def perimeter(s, d):
    """Entry and exit of each vehicle: nearest perimeter sensor at any distance, own position with 2 m of noise."""
    a = active(s, d).select("traj_id", F.inline(F.array(F.struct(F.lit("entry").alias("kind"), F.col("lo").alias("step")), F.struct(F.lit("exit").alias("kind"), F.col("hi").alias("step")))))
    p = points(s, d).select("traj_id", "step", "t_us", "x", "y").join(a, ["traj_id", "step"])
    e = M.nearest_site(p, sensors(s, d).filter("role = 'perimeter'"))
    noisy = lambda c: F.col(c) + 2 * S.normal(F.col("traj_id"), F.col("kind"), F.lit(c))
    return e.select("traj_id", "kind", "step", "t_us", "sensor_id", F.col("x").alias("px"), F.col("y").alias("py"), noisy("x").alias("zx"), noisy("y").alias("zy"))


@query("perimeter_events", f"SELECT traj_id, kind, step, t_us, sensor_id, {q('zx', 'zx')}, {q('zy', 'zy')} FROM perimeter", PERIMETER)
def _(s, d):
    return perimeter(s, d).select("traj_id", "kind", "step", "t_us", "sensor_id", r("zx", "zx"), r("zy", "zy"))


#: Rates of the corruption: misses (half at every seventh sensor), ghosts a true event, jitter and bias in seconds.
MISS, MISS_AT, GHOSTS, JITTER, BIAS, SEEDS = 0.2, 0.5, 0.3, 1800.0, 300.0, 3
DRAW = f"{uni('v.traj_id', 'v.sensor_id', 'v.step', 'k.seed', chr(39) + 'drop' + chr(39))}"
VIEWS["kept"] = f"span AS (SELECT traj_id, min(t_us) AS t0, max(t_us) AS t1 FROM points GROUP BY 1), kept AS (SELECT v.*, CAST(k.seed AS BIGINT) AS seed, t0, t1 FROM visits v JOIN span USING (traj_id), range({SEEDS}) k(seed) WHERE {DRAW} >= CASE WHEN v.sensor_id % 7 = 0 THEN {MISS_AT} ELSE {MISS} END)"


def observation():
    return X.Corruption(miss=MISS, ghosts=GHOSTS, jitter_s=JITTER, bias_s=BIAS)


def oracle(s, d):
    span = points(s, d).groupBy("traj_id").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    return visits(s, d).join(span, "traj_id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)).cast("array<bigint>")))


def overrides(s, d):
    return sensors(s, d).filter("sensor_id % 7 = 0").select("sensor_id", F.lit(MISS_AT).alias("miss"))


@query("corrupt_drop", "SELECT traj_id, seed, sensor_id, step FROM kept", f"{SEEN} kept")
def _(s, d):
    return X.drop_events(oracle(s, d), observation(), overrides(s, d)).select("traj_id", "seed", "sensor_id", "step")


@query("corrupt_jitter", f"SELECT traj_id, seed, sensor_id, step, CAST(floor(greatest(t0, least(t1, t_us + 1e6 * ({BIAS} + {JITTER} * {normal_sql('traj_id', 'sensor_id', 'step', 'seed', chr(39) + 'jitter' + chr(39))}))) / 1000 + 0.5::DOUBLE) AS BIGINT) AS t_ms FROM kept", f"{SEEN} kept")
def _(s, d):
    """Real events only, clipped to the whole span of the trajectory; milliseconds."""
    k = X.jitter_events(X.drop_events(oracle(s, d), observation(), overrides(s, d)), observation())
    return k.select("traj_id", "seed", "sensor_id", "step", F.floor(F.col("t_us") / 1000 + 0.5).cast("bigint").alias("t_ms"))


GHOST_SQL = f"""n AS (SELECT traj_id, seed, count(*) * {GHOSTS} AS rate, min(t0) AS t0, max(t1) AS t1 FROM (SELECT v.traj_id, CAST(k.seed AS BIGINT) AS seed, t0, t1 FROM visits v JOIN span USING (traj_id), range({SEEDS}) k(seed)) GROUP BY 1, 2),
pm AS (SELECT n.*, i, exp(-rate) * power(rate, i) / gamma(i + 1) AS p FROM n, range(60) t(i)), cd AS (SELECT *, sum(p) OVER (PARTITION BY traj_id, seed ORDER BY i) AS c FROM pm),
gn AS (SELECT traj_id, seed, t0, t1, count(*) FILTER (c <= {uni('traj_id', 'seed', chr(39) + 'ghosts' + chr(39))}) AS g FROM cd GROUP BY 1, 2, 3, 4),
si AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS i, count(*) OVER () AS n FROM sensors WHERE role = 'interior'),
ghosts AS (SELECT gn.traj_id, gn.seed, t.k AS number, si.sensor_id, t0 + (t1 - t0) * {uni('gn.traj_id', 'gn.seed', 't.k', chr(39) + 'time' + chr(39))} AS t FROM gn, range(1, 61) t(k), si WHERE t.k <= g AND si.i = CAST(floor({uni('gn.traj_id', 'gn.seed', 't.k', chr(39) + 'sensor' + chr(39))} * si.n) AS BIGINT))"""
VIEWS["ghosts"] = GHOST_SQL


@query("ghost_events", "SELECT traj_id, seed, number, sensor_id, CAST(floor(t / 1000 + 0.5::DOUBLE) AS BIGINT) AS t_ms FROM ghosts", f"{SEEN} kept ghosts")
def _(s, d):
    """Poisson many for each stream, by the true events before any is lost; none without true events; no vehicle."""
    g = X.ghost_events(oracle(s, d), sensors(s, d).filter("role = 'interior'"), observation())
    return g.select("traj_id", "seed", "number", "sensor_id", F.floor(F.col("t_us") / 1000 + 0.5).cast("bigint").alias("t_ms"))


JITTERED = f"CAST(floor(greatest(t0, least(t1, t_us + 1e6 * ({BIAS} + {JITTER} * {normal_sql('traj_id', 'sensor_id', 'step', 'seed', chr(39) + 'jitter' + chr(39))}))) / 1000 + 0.5::DOUBLE) AS BIGINT)"


@query("condition_streams", f"""WITH a AS (SELECT traj_id, t_us // 1000 AS t_ms, kind, sensor_id FROM perimeter), tracked AS (SELECT DISTINCT traj_id FROM perimeter), b AS (SELECT v.traj_id, v.t_us // 1000 AS t_ms, 'passage' AS kind, v.sensor_id FROM visits v JOIN tracked USING (traj_id)),
c AS (SELECT seed, traj_id, {JITTERED} AS t_ms, 'passage' AS kind, sensor_id FROM kept JOIN tracked USING (traj_id) UNION ALL SELECT seed, traj_id, CAST(floor(t / 1000 + 0.5::DOUBLE) AS BIGINT), 'ghost', sensor_id FROM ghosts JOIN tracked USING (traj_id))
SELECT 'A_perimeter_only' AS condition, NULL::BIGINT AS seed, * FROM a UNION ALL SELECT 'B_oracle_interior', NULL, * FROM a UNION ALL SELECT 'B_oracle_interior', NULL, * FROM b
UNION ALL SELECT 'C_sidechannel', k.seed, a.* FROM a, (SELECT CAST(unnest(range({SEEDS})) AS BIGINT) AS seed) k UNION ALL SELECT 'C_sidechannel', * FROM c""", f"{PERIMETER} kept ghosts")
def _(s, d):
    """Streams of the three conditions. C in full and for every seed: passages lost and their times moved, ghosts added."""
    a = perimeter(s, d).select(F.lit(None).cast("bigint").alias("seed"), "traj_id", F.expr("t_us div 1000").alias("t_ms"), "kind", "sensor_id")
    tracked = a.select("traj_id").distinct()
    ms = F.floor(F.col("t_us") / 1000 + 0.5).cast("bigint")

    def stream(df, kind: str, time=ms):
        seed = F.col("seed") if "seed" in df.columns else F.lit(None).cast("bigint")
        return df.join(tracked, "traj_id", "left_semi").select(seed.alias("seed"), "traj_id", time.alias("t_ms"), F.lit(kind).alias("kind"), "sensor_id")

    o = oracle(s, d)
    lost = X.jitter_events(X.drop_events(o, observation(), overrides(s, d)), observation())
    ghosts = X.ghost_events(o, sensors(s, d).filter("role = 'interior'"), observation())
    each = a.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)).cast("array<bigint>"))).select(*a.columns)
    return X.condition_streams(a, stream(visits(s, d), "passage", F.expr("t_us div 1000")), each.unionByName(stream(lost, "passage")).unionByName(stream(ghosts, "ghost")))


@query("bin_events", "WITH m AS (SELECT seq_id, max(t_s) AS last FROM packets GROUP BY 1) SELECT seq_id, bin, count(*) AS n FROM (SELECT p.seq_id, CAST(greatest(0, least(floor(m.last / 3600 * 0.9::DOUBLE), round_even(p.t_s / 3600.0::DOUBLE, 0))) AS BIGINT) AS bin FROM packets p JOIN m USING (seq_id)) GROUP BY 1, 2", "packets")
def _(s, d):
    """Half-even steps of an hour, clamped to the grid (nine tenths of the span here, so that late events do meet its end)."""
    p = packets(s, d).withColumn("last", F.floor(F.max("t_s").over(Window.partitionBy("seq_id")) / 3600 * 0.9))
    bin_ = F.greatest(F.lit(0.0), F.least(F.col("last").cast("double"), F.rint(F.col("t_s") / 3600.0))).cast("bigint")
    return p.groupBy("seq_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


# --- trackers ------------------------------------------------------------------------------------------------------------

VIEWS["observed"] = """entry_edge AS (SELECT traj_id, arg_min(heading, {'d': d2, 'e': edge_id}) AS heading FROM (SELECT traj_id, edge_id, atan2(ty - ay, tx - ax) AS heading, (ax + t * (tx - ax) - px) * (ax + t * (tx - ax) - px) + (ay + t * (ty - ay) - py) * (ay + t * (ty - ay) - py) AS d2 FROM (
  SELECT p.traj_id, p.px, p.py, e.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.px - ax) * (tx - ax) + (p.py - ay) * (ty - ay)) / (1.0::DOUBLE * (tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)))) AS t FROM perimeter p, edges e WHERE p.kind = 'entry')) GROUP BY 1),
obs AS (SELECT traj_id, step, CASE WHEN kind = 'entry' THEN 1 ELSE 2 END AS k, 0 AS sensor_id, kind, px AS zx, py AS zy FROM perimeter UNION ALL SELECT v.traj_id, v.step, 3, v.sensor_id, 'passage', v.sx, v.sy FROM visits v JOIN (SELECT DISTINCT traj_id FROM perimeter) USING (traj_id)),
ops AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step, k, sensor_id) AS i, row_number() OVER (PARTITION BY traj_id, step ORDER BY k DESC, sensor_id DESC) = 1 AS final FROM (
  SELECT traj_id, step, k, sensor_id, kind, zx, zy FROM obs UNION ALL SELECT p.traj_id, p.step, 0, 0, 'advance', NULL, NULL FROM points p JOIN (SELECT DISTINCT traj_id FROM perimeter) USING (traj_id)))"""
VIEWS["ops"] = "ops2 AS (SELECT o.*, 8 * cos(h.heading) AS vx, 8 * sin(h.heading) AS vy FROM ops o JOIN entry_edge h USING (traj_id))"
OBSERVED = f"{PERIMETER} nodes edges observed ops"


def observed(s, d):
    """Events of single-vehicle scenarios, without noise: entries start with 8 m a step along the nearest edge."""
    p = perimeter(s, d).select("traj_id", "kind", "step", F.col("px").alias("x"), F.col("py").alias("y"))
    heading = edges(s, d).select("edge_id", F.atan2((F.col("ty") - F.col("ay")).cast("double"), (F.col("tx") - F.col("ax")).cast("double")).alias("h"))
    entry = G.project(p.filter("kind = 'entry'").select("traj_id", "x", "y"), edges(s, d)).join(heading, "edge_id").select("traj_id", (8 * F.cos("h")).alias("vx"), (8 * F.sin("h")).alias("vy"))
    rank = F.when(F.col("kind") == "entry", 0).otherwise(1)
    fixed = p.select("traj_id", "step", rank.cast("bigint").alias("rank"), "kind", F.col("x").cast("double").alias("zx"), F.col("y").cast("double").alias("zy"))
    v = visits(s, d).join(p.select("traj_id").distinct(), "traj_id", "left_semi")
    passing = v.select("traj_id", "step", (F.col("sensor_id") + 2).alias("rank"), F.lit("passage").alias("kind"), F.col("sx").cast("double").alias("zx"), F.col("sy").cast("double").alias("zy"))
    return fixed.unionByName(passing).join(entry, "traj_id").select(F.col("traj_id").alias("scenario"), F.col("traj_id").alias("vehicle_id"), "step", "rank", "kind", "zx", "zy", "vx", "vy")


def steps(s, d):
    return points(s, d).groupBy(F.col("traj_id").alias("scenario")).agg(F.count("*").alias("steps"))


RECKON = """w AS (SELECT traj_id, i, step, final, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, false AS live, false AS known, 0::BIGINT AS t, 0.0::DOUBLE AS lx, 0.0::DOUBLE AS ly FROM ops2 WHERE i = 1
UNION ALL SELECT traj_id, i, step, final, CASE WHEN kind = 'advance' THEN CASE WHEN live THEN x + u ELSE x END WHEN kind = 'entry' OR hit THEN zx ELSE x END, CASE WHEN kind = 'advance' THEN CASE WHEN live THEN y + v ELSE y END WHEN kind = 'entry' OR hit THEN zy ELSE y END,
  CASE WHEN kind = 'entry' THEN vx WHEN hit AND step > t THEN 0.5 * mx * least(1.0, 25 / greatest(sqrt(mx * mx + my * my), 1e-12)) + 0.5 * u ELSE u END, CASE WHEN kind = 'entry' THEN vy WHEN hit AND step > t THEN 0.5 * my * least(1.0, 25 / greatest(sqrt(mx * mx + my * my), 1e-12)) + 0.5 * v ELSE v END,
  CASE WHEN kind = 'entry' THEN true WHEN kind = 'exit' THEN false ELSE live END, known OR kind = 'entry', CASE WHEN kind = 'entry' OR hit THEN step ELSE t END, CASE WHEN kind = 'entry' OR hit THEN zx ELSE lx END, CASE WHEN kind = 'entry' OR hit THEN zy ELSE ly END
FROM (SELECT o.*, w.x, w.y, w.u, w.v, w.live, w.known, w.t, w.lx, w.ly, (o.kind = 'exit' OR (o.kind = 'passage' AND w.live)) AS hit, (o.zx - w.lx) / greatest(o.step - w.t, 1) AS mx, (o.zy - w.ly) / greatest(o.step - w.t, 1) AS my FROM w JOIN ops2 o ON o.traj_id = w.traj_id AND o.i = w.i + 1))"""


@query("dead_reckoning", f"WITH RECURSIVE {RECKON} SELECT traj_id, step, {q('x', 'x')}, {q('y', 'y')} FROM w WHERE final AND known", OBSERVED)
def _(s, d):
    return T.track(observed(s, d), steps(s, d), "dead_reckoning").select(F.col("vehicle_id").alias("traj_id"), "step", r("x", "x"), r("y", "y"))


FILTER = """w AS (SELECT traj_id, i, step, final, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS pp, 0.0::DOUBLE AS pv, 0.0::DOUBLE AS vv, false AS live, false AS known FROM ops2 WHERE i = 1
UNION ALL SELECT traj_id, i, step, final, CASE WHEN kind = 'advance' THEN x + u WHEN kind = 'entry' THEN zx ELSE x + g * (zx - x) END, CASE WHEN kind = 'advance' THEN y + v WHEN kind = 'entry' THEN zy ELSE y + g * (zy - y) END,
  CASE WHEN kind = 'advance' THEN u WHEN kind = 'entry' THEN vx ELSE u + h * (zx - x) END, CASE WHEN kind = 'advance' THEN v WHEN kind = 'entry' THEN vy ELSE v + h * (zy - y) END,
  CASE WHEN NOT known AND kind = 'advance' THEN pp WHEN kind = 'advance' THEN pp + 2 * pv + vv + 0.5 WHEN kind = 'entry' THEN 10 ELSE (1 - g) * pp END, CASE WHEN kind = 'advance' THEN pv + vv WHEN kind = 'entry' THEN 0 ELSE (1 - g) * pv END, CASE WHEN NOT known AND kind = 'advance' THEN vv WHEN kind = 'advance' THEN vv + 0.5 WHEN kind = 'entry' THEN 10 ELSE vv - h * pv END,
  CASE WHEN kind = 'entry' THEN true WHEN kind = 'exit' AND twice THEN false ELSE live END, known OR kind = 'entry'
FROM (SELECT *, CASE WHEN kind = 'passage' AND NOT live THEN 0 ELSE pp / (pp + rr) END AS g, CASE WHEN kind = 'passage' AND NOT live THEN 0 ELSE pv / (pp + rr) END AS h FROM (
  SELECT o.*, w.x, w.y, w.u, w.v, w.pp, w.pv, w.vv, w.live, w.known, CASE WHEN o.kind = 'exit' THEN 0.1::DOUBLE ELSE 312.5::DOUBLE END AS rr FROM w JOIN ops3 o ON o.traj_id = w.traj_id AND o.i = w.i + 1)))"""
#: The exit counts twice, so it stands twice in the list of operations.
TWICE = "ops3 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY traj_id ORDER BY i, twice) AS i, final AND (twice OR kind <> 'exit') AS final) FROM (SELECT *, false AS twice FROM ops2 UNION ALL SELECT *, true FROM ops2 WHERE kind = 'exit'))"


@query("kalman_track", f"WITH RECURSIVE {TWICE}, {FILTER} SELECT traj_id, step, {q('x', 'x')}, {q('y', 'y')} FROM w WHERE final AND known", OBSERVED)
def _(s, d):
    return T.track(observed(s, d), steps(s, d), "kalman").select(F.col("vehicle_id").alias("traj_id"), "step", r("x", "x"), r("y", "y"))


@query("softmax_assign", f"""WITH c AS (SELECT e.traj_id, e.step, o.traj_id AS track, least(100, sqrt((e.x - o.x) * (e.x - o.x) + (e.y - o.y) * (e.y - o.y)) / (20 + o.event_id % 7 + 1e-6)) AS cost FROM points e JOIN points o ON o.traj_id % 10 = e.traj_id % 10 AND o.step = e.step WHERE e.event_id % 3 = 0),
p AS (SELECT *, exp(-cost) / sum(exp(-cost)) OVER (PARTITION BY traj_id, step) AS p FROM c) SELECT traj_id, step, CASE WHEN max(round(p, 9)) >= 0.2 THEN arg_min(track, {{'p': -round(p, 9), 't': track}}) END AS assigned, {q('max(p)', 'p')} FROM p GROUP BY 1, 2""", "packets points")
def _(s, d):
    """An event goes to the track of highest softmax weight of distance over uncertainty, if that is 0.2 at least."""
    p = points(s, d).withColumn("scenario", F.col("traj_id") % 10)
    e = p.filter("event_id % 3 = 0").select("scenario", "traj_id", "step", "x", "y")
    o = p.select("scenario", "step", F.col("traj_id").alias("track"), F.col("x").alias("ox"), F.col("y").alias("oy"), (20 + F.col("event_id") % 7).alias("u"))
    best = T.softmax_assigned(e, o, ["scenario", "step"], 0.2)
    return best.select("traj_id", "step", "assigned", r("p", "p"))


@query("branch_softmax", f"""WITH h AS (SELECT edge_id, a, b, atan2(ty - ay, tx - ax) AS h FROM edges), d AS (SELECT e.edge_id, o.edge_id AS next_id, abs(((o.h - e.h + 3 * pi()) % (2 * pi())) - pi()) AS off FROM h e JOIN h o ON o.a = e.b)
SELECT edge_id, next_id, {q('exp(-off / 0.5) / sum(exp(-off / 0.5)) OVER (PARTITION BY edge_id)', 'p')} FROM d""", "nodes edges")
def _(s, d):
    """Probability of each way on, by the change of heading."""
    h = edges(s, d).select("edge_id", "a", "b", F.atan2((F.col("ty") - F.col("ay")).cast("double"), (F.col("tx") - F.col("ax")).cast("double")).alias("h"))
    o = h.select(F.col("edge_id").alias("next_id"), F.col("a").alias("b"), F.col("h").alias("oh"))
    w = F.exp(-F.abs(S.angle_diff(F.col("oh"), F.col("h"))) / 0.5)
    both = h.join(o, "b").withColumn("w", w)
    return both.select("edge_id", "next_id", r(F.col("w") / F.sum("w").over(Window.partitionBy("edge_id")), "p"))


@query("road_pf")
def _(s, d):
    """The particle filter (2000 particles a track) over every trajectory; its single laws have SQL twins below."""
    track = lambda e, roads: T.track(e, steps(s, d), "road_pf", roads)
    return T.on_roads(observed(s, d), ["scenario"], edges(s, d), track).select(F.col("vehicle_id").alias("traj_id"), "step", "x", "y")


#: Particles: embeddings as clouds on edges of 100 m, with the turns of each edge.
VIEWS["swarm"] = """swarm AS (SELECT vec_id % 5 AS cloud, vec_id, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, CAST(label AS BIGINT) AS edge, CAST(vec_id % 120 AS DOUBLE) AS r, 4 + CAST(vec_id % 9 AS DOUBLE) AS v, ln((vec_id % 17 + 1)::DOUBLE) AS lw FROM embeddings)"""


def swarm(s, d):
    e = table(s, d, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double") * 40
    i = F.col("vec_id")
    return e.select((i % 5).alias("cloud"), i, at(0).alias("x"), at(1).alias("y"), F.col("label").cast("bigint").alias("edge"), (i % 120).cast("double").alias("r"), (4 + i % 9).cast("double").alias("v"), F.log((i % 17 + 1).cast("double")).alias("lw"))


WEIGHED = """z AS (SELECT *, lw - ((x - cloud) * (x - cloud) + (y + cloud) * (y + cloud)) / (2 * 2.5 * 2.5) AS l FROM swarm),
weighed AS (SELECT * EXCLUDE (lw, l), l - max(l) OVER c - ln(sum(exp(l - m)) OVER c) AS lw FROM (SELECT *, max(l) OVER (PARTITION BY cloud) AS m FROM z) WINDOW c AS (PARTITION BY cloud))"""


@query("particle_weigh", f"WITH {WEIGHED} SELECT cloud, vec_id, {q('lw', 'lw')} FROM weighed", "swarm")
def _(s, d):
    """Log weights of every particle after a measurement of its cloud."""
    return PF.weighed(swarm(s, d), ["cloud"], F.col("cloud"), -F.col("cloud"), 2.5).select("cloud", "vec_id", r("lw", "lw"))


@query("particle_resample", f"""WITH {WEIGHED}, c AS (SELECT *, count(*) OVER (PARTITION BY cloud) AS n, {uni("'7'", 'cloud')} AS u, CASE WHEN lead(vec_id) OVER w IS NULL THEN 1.0 ELSE least(sum(exp(lw)) OVER w, 1.0) END AS h FROM weighed WINDOW w AS (PARTITION BY cloud ORDER BY vec_id)),
p AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY cloud ORDER BY vec_id), 0) AS lo FROM c)
SELECT cloud, vec_id, k AS copies FROM (SELECT *, CAST(greatest(0, ceil(round(h * n - u, 9))) - greatest(0, ceil(round(lo * n - u, 9))) AS BIGINT) AS k FROM p) WHERE k > 0""", "swarm")
def _(s, d):
    """How often each particle is drawn by n evenly spaced points over the summed weights of its cloud."""
    w = PF.weighed(swarm(s, d), ["cloud"], F.col("cloud"), -F.col("cloud"), 2.5).withColumn("w", F.exp("lw"))
    return PF.systematic(w, ["cloud"], "vec_id", S.uniform(F.lit(7), F.col("cloud"))).select("cloud", "vec_id", "copies")


PASSED = f"""ways AS (SELECT DISTINCT CAST(label AS BIGINT) AS edge FROM embeddings), raw AS (SELECT a.edge, b.edge AS next, 1.0 / (1 + abs(b.edge - a.edge)) AS w FROM ways a JOIN ways b ON abs(b.edge - a.edge) BETWEEN 1 AND 2 WHERE a.edge % 4 <> 0),
turns AS (SELECT edge, next, round(coalesce(sum(w) OVER (PARTITION BY edge ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY edge), 9) AS lo, round(sum(w) OVER (PARTITION BY edge ORDER BY next) / sum(w) OVER (PARTITION BY edge), 9) AS hi FROM raw),
m AS (SELECT cloud, vec_id, edge, r + v + {normal_sql("'r'", 'vec_id')} * sqrt(0.5 / 3) AS r, greatest(v + {normal_sql("'v'", 'vec_id')} * sqrt(0.5), 0.001) AS v, {uni("'t'", 'vec_id')} AS u FROM swarm),
n AS (SELECT m.*, t.next FROM m LEFT JOIN turns t ON m.r > 100 AND t.edge = m.edge AND m.u > t.lo AND m.u <= t.hi)"""


@query("particle_predict", f"WITH {PASSED} SELECT cloud, vec_id, coalesce(next, edge) AS edge, {q('greatest(CASE WHEN r <= 100 THEN r WHEN next IS NULL THEN 99.999 ELSE r - 100 END, 0)', 'r')}, {q('v', 'v')} FROM n", "swarm")
def _(s, d):
    """A step along the road by counter draws: motion, then the passing of edge ends by turn probabilities."""
    ways = table(s, d, "embeddings").select(F.col("label").cast("bigint").alias("edge")).distinct()
    step = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)]))
    near = ways.filter("edge % 4 <> 0").select("edge", step.alias("k")).select("edge", (F.col("edge") + F.col("k")).alias("next"), (1.0 / (1 + F.abs("k"))).alias("w"))
    known = near.join(ways.select(F.col("edge").alias("next")), "next")
    upto = Window.partitionBy("edge").orderBy("next")
    total = F.sum("w").over(Window.partitionBy("edge"))
    before = F.coalesce(F.sum("w").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    turns = known.select("edge", "next", F.round(before / total, 9).alias("lo"), F.round(F.sum("w").over(upto) / total, 9).alias("hi"))
    i = F.col("vec_id")
    gone = PF.moved(swarm(s, d), S.normal(F.lit("r"), i), S.normal(F.lit("v"), i))
    out = PF.passed(gone, ways.withColumn("length", F.lit(100.0)), turns, S.uniform(F.lit("t"), i))
    return out.select("cloud", "vec_id", "edge", r("r", "r"), r("v", "v"))


@query("run_jobs")
def _(s, d):
    """Error of every (estimator, condition, trajectory) job."""
    e = observed(s, d).join(steps(s, d), "scenario")
    grid = F.inline(F.array(*[F.struct(F.lit(n).alias("estimator"), F.lit(c).alias("condition")) for n in T.ESTIMATORS for c in ("A", "B")]))
    jobs = e.select("*", grid).filter("condition = 'B' or kind <> 'passage'").withColumn("job", F.concat_ws("|", "scenario", "condition"))
    truth = points(s, d).join(active(s, d), "traj_id").filter("step between lo and hi").select(F.col("traj_id").alias("vehicle_id"), "step", "x", "y")
    return T.run_jobs(jobs, truth, edges(s, d))


TRACK = f"""tr AS (SELECT p.traj_id, p.step, p.x, p.y, CASE WHEN p.event_id % 13 <> 0 THEN lag(p.x, 2) OVER w END AS ex, CASE WHEN p.event_id % 13 <> 0 THEN lag(p.y, 2) OVER w END AS ey FROM points p WINDOW w AS (PARTITION BY traj_id ORDER BY step)),
fl AS (SELECT traj_id, step, x, y, ex AS raw, coalesce(last_value(ex IGNORE NULLS) OVER a, first_value(ex IGNORE NULLS) OVER b) AS ex, coalesce(last_value(ey IGNORE NULLS) OVER a, first_value(ey IGNORE NULLS) OVER b) AS ey FROM tr WINDOW a AS (PARTITION BY traj_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY traj_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
er AS (SELECT f.traj_id, f.step, f.raw, sqrt((f.x - f.ex) * (f.x - f.ex) + (f.y - f.ey) * (f.y - f.ey)) AS e FROM fl f JOIN active a ON a.traj_id = f.traj_id AND f.step BETWEEN a.lo AND a.hi)"""


@query("track_metrics", f"WITH {TRACK} SELECT traj_id, count(*) AS n_steps, {q('sqrt(avg(e * e))', 'rmse')}, {q('avg(e)', 'mae')}, {q('quantile_cont(e, 0.5)', 'median')}, {q('quantile_cont(e, 0.95)', 'p95')}, {q('max(e)', 'most')}, {q('arg_max(e, step)', 'final_error')}, {q('count(raw) / count(*)', 'coverage')} FROM er GROUP BY 1", "packets points active")
def _(s, d):
    """Errors on the active slice after gaps are filled; coverage before; all null where no estimate exists."""
    lagged = lambda c: F.when(F.col("event_id") % 13 != 0, F.lag(c, 2).over(own()))
    t = points(s, d).withColumns({"ex": lagged("x"), "ey": lagged("y")})
    back, on = own().rowsBetween(Window.unboundedPreceding, 0), own().rowsBetween(0, Window.unboundedFollowing)
    full = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(on))
    f = t.withColumns({"fx": full("ex"), "fy": full("ey")}).join(active(s, d), "traj_id").filter("step between lo and hi")
    dx, dy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    f = f.withColumn("e", F.sqrt((dx * dx + dy * dy).cast("double")))
    return f.groupBy("traj_id").agg(
        F.count("*").alias("n_steps"), r(F.sqrt(F.avg(F.col("e") * F.col("e"))), "rmse"), r(F.avg("e"), "mae"), r(F.percentile("e", 0.5), "median"), r(F.percentile("e", 0.95), "p95"), r(F.max("e"), "most"),
        r(F.max_by("e", "step"), "final_error"), r(F.count("ex") / F.count("*"), "coverage"),
    )


# --- simulation ------------------------------------------------------------------------------------------------------------

VIEWS["walk_routes"] = "walk_routes AS (SELECT CAST(a // 14 AS BIGINT) AS route_id, row_number() OVER (PARTITION BY a // 14 ORDER BY a) AS seq, edge_id, ax, ay, tx, ty, sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)) AS len FROM edges WHERE b = a + 1)"
STEP_SQL = f"greatest(0.5, base + {normal_sql('route_id', 'vehicle', 'step')} * 0.15 * base) * 0.5"
WALK = f"""cum AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY seq) AS hi, sum(len) OVER (PARTITION BY route_id ORDER BY seq) - len AS lo, sum(len) OVER (PARTITION BY route_id) AS total FROM walk_routes),
vs AS (SELECT route_id, v AS vehicle, 6 + (v * 5 + route_id) % 7 AS base, min(total) AS total FROM cum, range(4) t(v) GROUP BY 1, 2, 3), st AS (SELECT vs.*, k.step, {STEP_SQL} AS move FROM vs, range(200) k(step)),
ps AS (SELECT *, coalesce(sum(move) OVER (PARTITION BY route_id, vehicle ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dist FROM st)
SELECT p.route_id, p.vehicle, p.step, c.edge_id, {q('c.ax + (p.dist - c.lo) / c.len * (c.tx - c.ax)', 'x')}, {q('c.ay + (p.dist - c.lo) / c.len * (c.ty - c.ay)', 'y')} FROM ps p JOIN cum c ON c.route_id = p.route_id AND p.dist <= c.hi AND (p.dist > c.lo OR c.seq = 1) WHERE p.dist <= p.total"""


def walk_routes(s, d):
    e = edges(s, d).filter("b = a + 1")
    return e.select(F.floor(F.col("a") / 14).cast("bigint").alias("route_id"), F.row_number().over(Window.partitionBy(F.floor(F.col("a") / 14)).orderBy("a")).cast("bigint").alias("seq"), "edge_id", "ax", "ay", "tx", "ty")


@query("simulate_walk", f"WITH {WALK}", "nodes edges walk_routes")
def _(s, d):
    """Four vehicles along each route: noisy speeds from counter hashes, positions by cumulative distance, no loop."""
    vehicles = walk_routes(s, d).select("route_id").distinct().withColumn("vehicle", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    vehicles = vehicles.withColumn("base", 6 + (F.col("vehicle") * 5 + F.col("route_id")) % 7)
    return X.walk(walk_routes(s, d), vehicles, dt=0.5, noise=0.15, most=200).select("route_id", "vehicle", "step", "edge_id", r("x", "x"), r("y", "y"))


def seeds(s, n):
    return s.range(n).select(F.col("id").alias("seed"))


def crossed(s, d):
    from .graph import crossings

    return crossings(s, d).filter("region = 0")


@query("transit_routes")
def _(s, d):
    """Random ways through the region, 60 m inside it at least; rows only, their properties are tested."""
    return X.transit_routes(seeds(s, 40), crossed(s, d), edges(s, d), (-60.0, 60.0, -60.0, 60.0), 60.0)


@query("dataset_manifest")
def _(s, d):
    """The first 20 seeds whose route exists and lasts, with its topology."""
    routes = X.transit_routes(seeds(s, 40), crossed(s, d), edges(s, d), (-60.0, 60.0, -60.0, 60.0), 60.0)
    return X.manifest(routes, edges(s, d), 20)


@query("mv_scenarios")
def _(s, d):
    """Groups of three vehicles whose windows overlap by 0.6 pairwise, staggered starts included."""
    routes = X.transit_routes(seeds(s, 40), crossed(s, d), edges(s, d), (-60.0, 60.0, -60.0, 60.0), 60.0)
    return X.scenarios(X.manifest(routes, edges(s, d), 40), 3, 0.6, 12.0)
