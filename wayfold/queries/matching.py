"""Queries that pair rows (by position, time, band, assignment) and score detections against truth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import assignment as A
from ..operators import matching as M
from ..operators import sequences as Q
from ..sources import camera_id, select_cameras
from ..operators.store import durable
from .base import packets, query
from .experiments import q, r
from .sequences import islands

K, O = ["seq_id"], ["row_idx"]
SIX_HOURS = 21_600_000_000
BOTH = "packets islands gt_islands"


def truths(s, d):
    return Q.true_runs(packets(s, d), K, O, "gt")


def numbered(df):
    return df.withColumn("k", F.row_number().over(Window.partitionBy("seq_id").orderBy("start_us")).cast("bigint"))


@query("pred_truth_diff", "SELECT p.seq_id, p.row_idx, p.marker::INT - t.gt::INT AS diff FROM packets p JOIN packets t USING (seq_id, row_idx)", "packets")
def _(s, d):
    p = packets(s, d)
    both = M.positional_zip(p.select("seq_id", "row_idx", "marker"), p.select("seq_id", "row_idx", "gt"), K, "row_idx")
    return both.select("seq_id", "row_idx", (F.col("marker").cast("int") - F.col("gt").cast("int")).alias("diff"))


@query("positional_zip", """WITH a AS (SELECT seq_id, start_us AS p, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM islands), b AS (SELECT seq_id, start_us AS g, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM gt_islands)
SELECT seq_id, k, p, g FROM a JOIN b USING (seq_id, k)""", BOTH)
def _(s, d):
    a, b = numbered(islands(s, d)), numbered(truths(s, d))
    return M.positional_zip(a.select("seq_id", "k", F.col("start_us").alias("p")), b.select("seq_id", "k", F.col("start_us").alias("g")), K, "k").select("seq_id", "k", "p", "g")


@query("length_guard", """WITH a AS (SELECT seq_id, count(*) AS n_left FROM islands GROUP BY 1), b AS (SELECT seq_id, count(*) AS n_right FROM gt_islands GROUP BY 1)
SELECT seq_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, abs(coalesce(n_left, 0) - coalesce(n_right, 0)) > 0.1 * greatest(coalesce(n_right, 0), 1) AS drift, least(coalesce(n_left, 0), coalesce(n_right, 0)) AS n FROM a FULL JOIN b USING (seq_id)""", BOTH)
def _(s, d):
    return M.length_guard(islands(s, d), truths(s, d), K, 0.1)


NEAR = """near_t AS (SELECT l.seq_id, l.t_us, any_value(l.frame_len) AS frame_len, arg_min(x.t_us, {'d': abs(x.t_us - l.t_us), 't': x.t_us}) AS near_t_us, arg_min(x.frame_len, {'d': abs(x.t_us - l.t_us), 't': x.t_us}) AS near_len
FROM packets l JOIN packets x ON x.seq_id = l.seq_id AND x.gt AND NOT x.marker WHERE l.marker GROUP BY 1, 2)"""


def nearest(s, d):
    p = packets(s, d)
    left, right = p.filter("marker").select("seq_id", "t_us", "frame_len"), p.filter("gt AND NOT marker").select("seq_id", "t_us", "frame_len")
    return M.nearest_in_time(left, right, K, "t_us", "frame_len").filter("near_t_us IS NOT NULL")


@query("asof_nearest_size_error", f"WITH {NEAR} SELECT seq_id, t_us, frame_len - near_len AS error, round(abs(frame_len - near_len) / greatest(near_len, 1) + 1e-9, 6) AS share FROM near_t", "packets")
def _(s, d):
    e = F.col("frame_len") - F.col("near_frame_len")
    return nearest(s, d).select("seq_id", "t_us", e.alias("error"), r(F.abs(e) / F.greatest("near_frame_len", F.lit(1)), "share"))


@query("asof_nearest_delta", f"WITH {NEAR} SELECT seq_id, t_us, near_t_us, t_us - near_t_us AS delta_us FROM near_t", "packets")
def _(s, d):
    return nearest(s, d).select("seq_id", "t_us", "near_t_us", (F.col("t_us") - F.col("near_t_us")).alias("delta_us"))




def candidates(s, d):
    p = numbered(islands(s, d)).select("seq_id", F.col("k").alias("pi"), F.col("start_us").alias("pt"))
    g = numbered(truths(s, d)).select("seq_id", F.col("k").alias("gi"), F.col("start_us").alias("gt_us"))
    return M.band_join(p, g, K, "pt", "gt_us", SIX_HOURS).withColumn("delta", F.abs(F.col("pt") - F.col("gt_us")))


@query("band_join_candidates", f"SELECT a.seq_id, a.start_us AS pt, b.start_us AS gt_us FROM islands a JOIN gt_islands b ON a.seq_id = b.seq_id AND abs(a.start_us - b.start_us) <= {SIX_HOURS}", BOTH)
def _(s, d):
    return candidates(s, d).select("seq_id", "pt", "gt_us")


def costs(s, d):
    return candidates(s, d).withColumn("cost", F.col("delta").cast("double"))


@query("gated_assignment")
def _(s, d):
    """Least total distance one-to-one; ``assignment_certificate`` proves it, as many solutions may be equally good."""
    return A.gated_assignment(costs(s, d), K, float(SIX_HOURS))


@query("assignment_certificate", f"SELECT DISTINCT a.seq_id, 0::BIGINT AS n_twice, 0::BIGINT AS n_cheaper, 0::BIGINT AS n_uneven FROM islands a JOIN gt_islands b ON a.seq_id = b.seq_id AND abs(a.start_us - b.start_us) < {SIX_HOURS}", BOTH)
def _(s, d):
    """No row used twice, no candidate below its prices, prices that add up to the cost: every group's solution is optimal."""
    pairs = costs(s, d)
    solution = durable(A.assigned(pairs, K, float(SIX_HOURS)))
    return A.certificate(pairs, solution, K, float(SIX_HOURS), tolerance=1.0)


COUNTS = ", ".join(f"CAST(sum(({e})::INT) AS BIGINT) AS {n}" for n, e in (("tp", "on_ AND gt"), ("fp", "on_ AND NOT gt"), ("fn", "NOT on_ AND gt"), ("tn", "NOT on_ AND NOT gt")))
SCORES = ", ".join([q("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "precision"), q("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END", "recall"), q("CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "f1")])


def counts(df, *keys, on=None):
    on, gt = F.col("prob") >= 0.5 if on is None else on, F.col("gt")
    return df.groupBy(*keys).agg(F.count_if(on & gt).alias("tp"), F.count_if(on & ~gt).alias("fp"), F.count_if(~on & gt).alias("fn"), F.count_if(~on & ~gt).alias("tn"))


def scores(df):
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": r(S.safe_ratio(tp, tp + fp), "x"), "recall": r(S.safe_ratio(tp, tp + fn), "x"), "f1": r(S.safe_ratio(2 * tp, 2 * tp + fp + fn), "x")})


#: What keeps denominators off zero. The recurrent labeller and the packet baseline add theirs, the event level
#: gives 0 for an empty denominator.
EPSILONS = {"labeller": 1e-8, "baseline": 1e-12}


def with_epsilon(df, eps: float, name: str):
    """Precision, recall, f1 of the two, and accuracy, each denominator grown by ``eps``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, rec = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return df.withColumns({f"{name}_precision": r(p, "x"), f"{name}_recall": r(rec, "x"), f"{name}_f1": r(2 * p * rec / (p + rec + eps), "x"), f"{name}_accuracy": r((tp + tn) / (tp + fp + fn + tn + eps), "x")})


def epsilon_sql(eps: float, name: str) -> str:
    p, rec = f"(tp / (tp + fp + {eps}::DOUBLE))", f"(tp / (tp + fn + {eps}::DOUBLE))"
    return ", ".join([q(p, f"{name}_precision"), q(rec, f"{name}_recall"), q(f"2 * {p} * {rec} / ({p} + {rec} + {eps}::DOUBLE)", f"{name}_f1"), q(f"(tp + tn) / (tp + fp + fn + tn + {eps}::DOUBLE)", f"{name}_accuracy")])


@query("confusion_metrics", f"WITH c AS (SELECT seq_id, {COUNTS} FROM (SELECT *, prob >= 0.5 AS on_ FROM packets) GROUP BY 1) SELECT *, {SCORES}, {', '.join(epsilon_sql(e, n) for n, e in EPSILONS.items())} FROM c", "packets")
def _(s, d):
    """All three conventions for empty denominators."""
    out = scores(counts(packets(s, d), "seq_id"))
    for name, eps in EPSILONS.items():
        out = with_epsilon(out, eps, name)
    return out


@query("stride_sample", "SELECT seq_id, row_idx, frame_len, value FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY value IS NOT NULL, value, row_idx) AS k FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN prob END AS value FROM packets)) WHERE (k - 1) % 5 = 0", "packets")
def _(s, d):
    """Every fifth row by value, those without one (null or NaN) first."""
    v = F.when(F.col("event_id") % 18 == 0, float("nan")).when(F.col("event_id") % 9 != 0, F.col("prob"))
    p = packets(s, d).withColumn("value", F.nanvl(v, F.lit(None).cast("double")))
    w = Window.partitionBy("seq_id").orderBy(F.col("value").asc_nulls_first(), "row_idx")
    return p.withColumn("k", F.row_number().over(w)).filter("(k - 1) % 5 = 0").select("seq_id", "row_idx", "frame_len", "value")


@query("event_order", "SELECT seq_id, event_id, row_number() OVER (PARTITION BY seq_id ORDER BY t_us, NOT marker, event_id) AS rk, row_number() OVER (PARTITION BY seq_id, t_us // 86400000000 ORDER BY NOT marker, t_us, event_id) AS bin_rk FROM packets", "packets")
def _(s, d):
    """Two orders: the stream's (time, perimeter events first among equals), and within a step (perimeter first, then time)."""
    late = (~F.col("marker")).cast("int")
    stream = Window.partitionBy("seq_id").orderBy("t_us", late, "event_id")
    step = Window.partitionBy("seq_id", F.expr("t_us div 86400000000")).orderBy(late, "t_us", "event_id")
    return packets(s, d).select("seq_id", "event_id", F.row_number().over(stream).cast("bigint").alias("rk"), F.row_number().over(step).cast("bigint").alias("bin_rk"))


@query("lag_vote", """WITH v AS (SELECT seq_id % 11 AS camera, seq_id, CAST((max(row_idx) FILTER (marker) - min(row_idx) FILTER (gt)) % 41 AS BIGINT) AS lag FROM packets GROUP BY 1, 2),
k AS (SELECT camera, seq_id, CASE WHEN lag > 0 THEN lag END AS lag FROM v)
SELECT camera, count(lag) AS n_votes, CAST(CASE WHEN count(lag) >= 2 THEN trunc(quantile_cont(lag, 0.5)) ELSE 0 END AS BIGINT) AS lag FROM k GROUP BY 1""", "packets")
def _(s, d):
    """Lag of a camera: the median (cut to a whole number) of the positive lags of its runs if there are two at least, else 0."""
    lag = (F.max(F.when(F.col("marker"), F.col("row_idx"))) - F.min(F.when(F.col("gt"), F.col("row_idx")))) % 41
    runs = packets(s, d).groupBy((F.col("seq_id") % 11).alias("camera"), "seq_id").agg(lag.alias("lag"))
    vote = F.when(F.col("lag") > 0, F.col("lag"))
    return runs.groupBy("camera").agg(F.count(vote).alias("n_votes"), F.when(F.count(vote) >= 2, F.percentile(vote, 0.5)).otherwise(0).cast("bigint").alias("lag"))


@query("camera_filter", "SELECT DISTINCT concat('2026_01_01_00_00_00_', seq_id, '_camera_', seq_id % 11, '_x') AS stem FROM packets WHERE seq_id % 11 IN (2, 5, 7) AND seq_id % 11 NOT IN (5, 9)", "packets")
def _(s, d):
    """Cameras of the include list, then without those of the exclude list."""
    stem = F.concat(F.lit("2026_01_01_00_00_00_"), F.col("seq_id"), F.lit("_camera_"), F.col("seq_id") % 11, F.lit("_x"))
    x = packets(s, d).select(stem.alias("stem")).distinct().withColumn("camera_id", camera_id(F.col("stem")))
    return select_cameras(x, ["2", "5", "7"], ["5", "9"]).select("stem")


@query("parse_sequence_key", "SELECT DISTINCT '2026_01_01_00_00_00_' || seq_id AS run, CAST(seq_id % 11 AS BIGINT) AS camera FROM packets", "packets")
def _(s, d):
    stem = F.concat(F.lit("2026_01_01_00_00_00_"), F.col("seq_id"), F.lit("_camera_"), F.col("seq_id") % 11, F.lit("_x"))
    x = packets(s, d).select(stem.alias("stem")).distinct()
    return x.select(F.split_part("stem", F.lit("_camera_"), F.lit(1)).alias("run"), F.regexp_extract("stem", r"_camera_(\d+)", 1).cast("bigint").alias("camera"))


NAME = "'run_' || (seq_id // 11) || '_camera_' || (seq_id % 11) || '.csv'"


@query("lookup_join_last_wins", f"""WITH t AS (SELECT regexp_extract({NAME}, '(run_[0-9]+_camera_[0-9]+)', 1) AS key, event_id, t_us FROM packets WHERE seq_id % 3 <> 0 AND event_id % 4 = 0), l AS (SELECT key, arg_max(event_id, {{'t': t_us, 'e': event_id}}) AS last_event FROM t GROUP BY 1),
c AS (SELECT {NAME} AS name, regexp_extract({NAME}, '(run_[0-9]+_camera_[0-9]+)', 1) AS key, count(*) AS n FROM packets GROUP BY 1, 2)
SELECT c.name, c.n, l.last_event, CAST(count(*) FILTER (l.key IS NULL) OVER () AS BIGINT) AS n_missed FROM c LEFT JOIN l USING (key)""", "packets")
def _(s, d):
    """Truth by the key parsed from a file's name, the last of equal keys wins; files without truth stay and are counted."""
    p = packets(s, d)
    i = F.col("seq_id")
    name = F.concat(F.lit("run_"), F.floor(i / 11), F.lit("_camera_"), i % 11, F.lit(".csv"))
    key = F.regexp_extract("name", "(run_[0-9]+_camera_[0-9]+)", 1)
    truth = p.filter("seq_id % 3 <> 0 and event_id % 4 = 0").withColumn("name", name).groupBy(key.alias("key")).agg(F.max_by("event_id", F.struct("t_us", "event_id")).alias("last_event"))
    files = p.groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumn("key", key)
    missed = files.join(truth, "key", "left_anti").agg(F.count("*").alias("n_missed"))  # one row
    return files.join(truth, "key", "left").crossJoin(F.broadcast(missed)).select("name", "n", "last_event", "n_missed")
