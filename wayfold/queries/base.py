"""Registry of queries and the views they run on, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Views whose SQL refers to itself.
RECURSIVE: set[str] = set()


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register a query; ``views`` names the SQL views its oracle stands on, in order."""

    def put(fn):
        SPARK[name] = fn
        if oracle:
            parts = [VIEWS[v] for v in views.split()]
            body = oracle.strip()
            word = "WITH RECURSIVE " if any(v in RECURSIVE for v in views.split()) or body.startswith("WITH RECURSIVE ") else "WITH "
            body = body.replace("WITH RECURSIVE ", "WITH ", 1)
            if body.startswith("WITH "):
                parts, body = [*parts, ""], body[5:]
            ORACLE[name] = (word + ",\n".join(parts).removesuffix("\n") + "\n" if parts else "") + body
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as a packet sequence for each user."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("seq_id").orderBy("t_us", "event_id")
    p = e.select(
        F.col("user_id").alias("seq_id"), micros(F.col("ts")).alias("t_us"), F.floor(F.col("value") * 100).cast("bigint").alias("frame_len"),
        (F.col("event_type") == "purchase").alias("marker"), F.col("event_type").isin("purchase", "signup").alias("gt"),
        F.round(F.col("value") / (F.col("value") + 50), 6).alias("prob"), "event_id",
    )
    return p.withColumns({"row_idx": F.row_number().over(own).cast("bigint"), "t_s": (F.col("t_us") - F.min("t_us").over(Window.partitionBy("seq_id"))) / 1e6})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer random walk for each sequence."""
    own = Window.partitionBy("seq_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda e: F.sum(e % 21 - 10).over(own)
    return packets(spark, sf_dir).select(
        F.col("seq_id").alias("traj_id"), (F.col("row_idx") - 1).alias("step"), "t_us",
        ((F.col("seq_id") * 17) % 261 - 130 + step(F.col("event_id") * 31)).alias("x"),
        ((F.col("seq_id") * 29) % 261 - 130 + step(F.col("event_id") * 17 + F.col("seq_id"))).alias("y"), "event_id",
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("sensor_id"), F.when(k % 4 == 0, "perimeter").otherwise("interior").alias("role"), ((k * 37) % 261 - 130).alias("x"), ((k * 53) % 261 - 130).alias("y")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("node_id"), ((k % 14) * 20 - 130).alias("x"), (F.floor(k / 14) * 20 - 130).alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    k = F.col("node_id")
    way = lambda number, to: F.struct(F.lit(number).alias("n"), to.alias("b"))
    out = F.array_compact(F.array(F.when(k % 14 < 13, way(0, k + 1)), way(1, k + 14), F.when((k % 3 == 0) & (k % 14 > 0), way(2, k - 1))))
    pairs = n.select(k.alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(out).alias("w")).select("*", "w.n", "w.b")
    return pairs.join(n.select(k.alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty")), "b").select((F.col("a") * 4 + F.col("n")).alias("edge_id"), "a", "b", "ax", "ay", "tx", "ty")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as experiment rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trajectory_id"), F.when(F.col("l_returnflag") == "A", "dead_reckoning").when(F.col("l_returnflag") == "N", "kalman").otherwise("road_pf").alias("estimator"),
        F.when(F.col("l_linestatus") == "F", "A_perimeter_only").otherwise("C_sidechannel").alias("condition"), F.col("l_linenumber").cast("bigint").alias("seed"),
        (F.col("l_extendedprice") / 1000).alias("rmse"), F.col("l_quantity").alias("gap"), F.col("l_discount").alias("level"), "l_orderkey", "l_partkey",
    )


VIEWS = {
    "packets": """packets AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_idx, epoch_us(ts) AS t_us,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t_s, CAST(floor(value * 100) AS BIGINT) AS frame_len, event_type = 'purchase' AS marker,
  event_type IN ('purchase', 'signup') AS gt, round(value / (value + 50), 6) AS prob, event_id FROM events)""",
    "points": """points AS (SELECT seq_id AS traj_id, row_idx - 1 AS step, t_us,
  CAST((seq_id * 17) % 261 - 130 + sum((event_id * 31) % 21 - 10) OVER (PARTITION BY seq_id ORDER BY row_idx) AS BIGINT) AS x,
  CAST((seq_id * 29) % 261 - 130 + sum((event_id * 17 + seq_id) % 21 - 10) OVER (PARTITION BY seq_id ORDER BY row_idx) AS BIGINT) AS y, event_id FROM packets)""",
    "sensors": """sensors AS (SELECT s_suppkey AS sensor_id, CASE WHEN s_suppkey % 4 = 0 THEN 'perimeter' ELSE 'interior' END AS role,
  (s_suppkey * 37) % 261 - 130 AS x, (s_suppkey * 53) % 261 - 130 AS y FROM supplier)""",
    "nodes": """nodes AS (SELECT c_custkey AS node_id, (c_custkey % 14) * 20 - 130 AS x, CAST(c_custkey // 14 AS BIGINT) * 20 - 130 AS y FROM customer)""",
    "edges": """edges AS (SELECT p.a * 4 + p.n AS edge_id, p.a, p.b, n.x AS ax, n.y AS ay, m.x AS tx, m.y AS ty FROM (
  SELECT node_id AS a, node_id + 1 AS b, 0 AS n FROM nodes WHERE node_id % 14 < 13 UNION ALL SELECT node_id, node_id + 14, 1 FROM nodes
  UNION ALL SELECT node_id, node_id - 1, 2 FROM nodes WHERE node_id % 3 = 0 AND node_id % 14 > 0) p JOIN nodes n ON n.node_id = p.a JOIN nodes m ON m.node_id = p.b)""",
    "runs": """runs AS (SELECT l_suppkey AS trajectory_id, CASE l_returnflag WHEN 'A' THEN 'dead_reckoning' WHEN 'N' THEN 'kalman' ELSE 'road_pf' END AS estimator,
  CASE l_linestatus WHEN 'F' THEN 'A_perimeter_only' ELSE 'C_sidechannel' END AS condition, CAST(l_linenumber AS BIGINT) AS seed, l_extendedprice / 1000 AS rmse,
  l_quantity AS gap, l_discount AS level, l_orderkey, l_partkey FROM lineitem)""",
    "islands": """changes AS (SELECT *, CASE WHEN prob >= 0.6 THEN 1 WHEN prob <= 0.3 THEN 0 END AS vote FROM packets),
states AS (SELECT *, coalesce(last_value(vote IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_idx), 0) AS active FROM changes),
marked AS (SELECT *, row_idx - row_number() OVER (PARTITION BY seq_id, active ORDER BY row_idx) AS grp FROM states),
islands AS (SELECT seq_id, min(row_idx) AS start_idx, max(row_idx) AS end_idx, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n, max(prob) AS peak,
  arg_min(row_idx, {'p': -prob, 'i': row_idx}) AS peak_idx, arg_min(t_us, {'p': -prob, 'i': row_idx}) AS peak_us FROM marked WHERE active = 1 GROUP BY seq_id, grp)""",
    "merged": """gaps AS (SELECT *, max(end_us) OVER (PARTITION BY seq_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM islands),
sessions AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - prev_end >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start_us) AS s FROM gaps),
merged AS (SELECT seq_id, min(start_us) AS start_us, max(end_us) AS end_us, max(peak) AS peak, arg_min(peak_us, {'p': -peak, 'i': start_us}) AS peak_us, CAST(sum(n) AS BIGINT) AS n,
  count(*) AS n_parts, row_number() OVER (PARTITION BY seq_id ORDER BY min(start_us)) AS event_idx FROM sessions GROUP BY seq_id, s)""",
    "gt_islands": """gt_marked AS (SELECT *, row_idx - row_number() OVER (PARTITION BY seq_id, gt ORDER BY row_idx) AS grp FROM packets),
gt_islands AS (SELECT seq_id, min(row_idx) AS start_idx, max(row_idx) AS end_idx, min(t_us) AS start_us, max(t_us) AS end_us FROM gt_marked WHERE gt GROUP BY seq_id, grp)""",
    "nearest": """near AS (SELECT p.traj_id, p.step, p.t_us, p.x, p.y, arg_min(s.sensor_id, {'d': (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), 'i': s.sensor_id}) AS sensor_id,
  min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d2 FROM points p, sensors s WHERE s.role = 'interior' GROUP BY ALL)""",
}
