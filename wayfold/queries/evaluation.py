"""Queries on event evaluation: detections matched with truth, metrics by sequence and camera, sweeps, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import sequences as Q
from .base import RECURSIVE, VIEWS, packets, query
from .experiments import q, r
from .sequences import DAY, HOUR, K, MERGE_VIEWS, O, passages

SIX = 6 * HOUR
VIEWS["ev"] = f"""ev_pred AS (SELECT seq_id, start_us, end_us, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM merged WHERE end_us - start_us >= {3 * HOUR}),
gt_gaps AS (SELECT *, max(end_us) OVER (PARTITION BY seq_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM gt_islands),
gt_sessions AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - prev_end >= {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start_us) AS s FROM gt_gaps),
ev_true AS (SELECT seq_id, min(start_us) AS start_us, max(end_us) AS end_us, row_number() OVER (PARTITION BY seq_id ORDER BY min(start_us)) AS k FROM gt_sessions GROUP BY seq_id, s)"""


def greedy_sql(candidates: str, name: str, key: str = "seq_id") -> str:
    """Rounds of pairs that come first in both their row and their column, until none is left."""
    return f"""{name}_c AS ({candidates}), {name}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY delta, pi, gi) AS rk FROM {name}_c),
{name}_r AS (SELECT {key}, pi, gi, delta, rk, false AS hit FROM {name}_k UNION ALL SELECT {key}, pi, gi, delta, rk, h FROM (
  SELECT *, bool_or(h) OVER (PARTITION BY {key}, pi) AS hp, bool_or(h) OVER (PARTITION BY {key}, gi) AS hg FROM (
    SELECT {key}, pi, gi, delta, rk, rk = min(rk) OVER (PARTITION BY {key}, pi) AND rk = min(rk) OVER (PARTITION BY {key}, gi) AS h FROM {name}_r WHERE NOT hit)) WHERE h OR NOT (hp OR hg)),
{name} AS (SELECT {key}, pi, gi, delta FROM {name}_r WHERE hit)"""


VIEWS["pairs"] = greedy_sql(f"SELECT p.seq_id, p.k AS pi, g.k AS gi, abs(p.start_us + p.end_us - g.start_us - g.end_us) AS delta FROM ev_pred p JOIN ev_true g ON p.seq_id = g.seq_id AND abs(p.start_us + p.end_us - g.start_us - g.end_us) <= {2 * SIX}", "paired")
VIEWS["metrics"] = f"""errs AS (SELECT m.seq_id, (p.start_us + p.end_us - g.start_us - g.end_us) / 2e6 AS e FROM paired m JOIN ev_pred p ON p.seq_id = m.seq_id AND p.k = m.pi JOIN ev_true g ON g.seq_id = m.seq_id AND g.k = m.gi),
base AS (SELECT seq_id, (max(t_us) - min(t_us)) / 1e6 AS observed_s FROM packets GROUP BY 1),
np AS (SELECT seq_id, count(*) AS n_pred FROM ev_pred GROUP BY 1), ng AS (SELECT seq_id, count(*) AS n_true FROM ev_true GROUP BY 1),
ne AS (SELECT seq_id, count(*) AS tp, avg(e) AS mean_error, avg(abs(e)) AS mean_abs_error, quantile_cont(abs(e), 0.5) AS median_abs_error, stddev_pop(e) AS jitter, sqrt(avg(e * e)) AS rms_error FROM errs GROUP BY 1),
counted AS (SELECT base.*, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_true, 0) - coalesce(tp, 0) AS fn, mean_error, mean_abs_error, median_abs_error, jitter, rms_error
  FROM base LEFT JOIN np USING (seq_id) LEFT JOIN ng USING (seq_id) LEFT JOIN ne USING (seq_id)),
metrics AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN n_true > 0 THEN fp / n_true END AS ghost_rate, CASE WHEN observed_s > 0 THEN fp / (observed_s / 60) END AS fp_per_minute FROM counted)"""
RECURSIVE.update({"pairs"})
EV = "packets islands merged gt_islands ev pairs"
METRICS = f"{EV} metrics"
NUMBERS = ["observed_s", "precision", "recall", "f1", "ghost_rate", "fp_per_minute", "mean_error", "mean_abs_error", "median_abs_error", "jitter", "rms_error"]


def predicted(s, d):
    return E.numbered(passages(s, d).select("seq_id", "start_us", "end_us"), K)


def truth(s, d):
    """Runs of truth merged like predictions; the least duration holds for predictions only."""
    return E.numbered(E.merged_events(Q.true_runs(packets(s, d), K, O, "gt").select("seq_id", "start_us", "end_us"), K, F.lit(DAY)), K)


def pairs(s, d):
    return E.matched_events(predicted(s, d), truth(s, d), K, SIX)


def metrics(s, d):
    return E.sequence_metrics(packets(s, d), predicted(s, d), truth(s, d), pairs(s, d), K)


@query("event_metrics", f"SELECT seq_id, n_pred, n_true, tp, fp, fn, {', '.join(q(c, c) for c in NUMBERS)} FROM metrics", METRICS)
def _(s, d):
    return metrics(s, d).select("seq_id", "n_pred", "n_true", "tp", "fp", "fn", *[r(c, c) for c in NUMBERS])


@query("fp_rate", f"SELECT seq_id, fp, {q('observed_s', 'observed_s')}, {q('fp_per_minute', 'fp_per_minute')} FROM metrics", METRICS)
def _(s, d):
    """False alarms per camera-minute of observed time; null where no time was observed."""
    return metrics(s, d).select("seq_id", "fp", r("observed_s", "observed_s"), r("fp_per_minute", "fp_per_minute"))


MEANS = ["precision", "recall", "f1", "ghost_rate", "fp_per_minute", "mean_error", "mean_abs_error", "rms_error"]
COLUMNS = "n, tp, fp, fn, precision, recall, f1, ghost_rate, fp_per_minute, mean_error, mean_abs_error, rms_error"


@query("macro_micro", f"""WITH s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n, CAST(sum(n_true) AS BIGINT) AS t, sum(observed_s) AS o FROM metrics), e AS (SELECT avg(e) AS me, avg(abs(e)) AS ma, sqrt(avg(e * e)) AS rm FROM errs)
SELECT 'MEAN' AS label, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {', '.join(q(f'avg({c})', c) for c in MEANS)} FROM metrics
UNION ALL SELECT 'MEAN_GT_ONLY', count(*), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), {', '.join(q(f'avg({c})', c) for c in MEANS)} FROM metrics WHERE n_true > 0
UNION ALL SELECT 'POOLED', n, tp, fp, fn, round(tp / (tp + fp) + 1e-9, 6), round(tp / (tp + fn) + 1e-9, 6), round(2 * tp / (2 * tp + fp + fn) + 1e-9, 6), round(fp / t + 1e-9, 6), round(fp / (o / 60) + 1e-9, 6), round(me + 1e-9, 6), round(ma + 1e-9, 6), round(rm + 1e-9, 6) FROM s, e""", METRICS)
def _(s, d):
    """Mean over sequences, over those with truth, and all events pooled: three labelled rows from one pass."""
    m = metrics(s, d)
    twice = m.withColumn("label", F.explode(F.when(F.col("n_true") > 0, F.array(F.lit("MEAN"), F.lit("MEAN_GT_ONLY"))).otherwise(F.array(F.lit("MEAN")))))
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]]
    means = twice.groupBy("label").agg(*sums, *[r(F.avg(c), c) for c in MEANS])
    all_ = m.agg(*sums, F.sum("n_true").alias("t"), F.sum("observed_s").alias("o"))
    e = pairs(s, d).select((F.col("error_us2") / 2e6).alias("e")).agg(*[c.alias(k) for k, c in E.timing(F.col("e")).items() if k in MEANS])
    rate = E.scores(F.col("tp"), F.col("fp"), F.col("fn")) | {"ghost_rate": F.col("fp") / F.col("t"), "fp_per_minute": F.col("fp") / (F.col("o") / 60)}
    pooled = all_.crossJoin(e)  # one row each
    return means.unionByName(pooled.select(F.lit("POOLED").alias("label"), "n", "tp", "fp", "fn", *[r(rate.get(c, F.col(c)), c) for c in MEANS]))


@query("per_camera_stats", f"""WITH c AS (SELECT seq_id % 11 AS camera, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM metrics GROUP BY 1),
f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT camera, n, tp, fp, fn, {q('precision', 'precision')}, {q('recall', 'recall')}, {q('f1', 'f1')}, row_number() OVER (ORDER BY f1 DESC, camera) AS rk FROM f""", METRICS)
def _(s, d):
    """Ranks are over cameras, a handful of aggregated rows."""
    c = metrics(s, d).groupBy((F.col("seq_id") % 11).alias("camera")).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    c = c.withColumns(E.scores(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("f1"), "camera")).cast("bigint"))
    return c.select("camera", "n", "tp", "fp", "fn", r("precision", "precision"), r("recall", "recall"), r("f1", "f1"), "rk")


@query("best_median_worst", """WITH k AS (SELECT seq_id % 11 AS camera, seq_id, row_number() OVER (PARTITION BY seq_id % 11 ORDER BY f1 DESC, fp, seq_id) - 1 AS i, count(*) OVER (PARTITION BY seq_id % 11) AS n FROM metrics)
SELECT camera, max(CASE WHEN i = 0 THEN seq_id END) AS best, max(CASE WHEN i = n // 2 THEN seq_id END) AS mid, max(CASE WHEN i = n - 1 THEN seq_id END) AS worst FROM k GROUP BY 1""", METRICS)
def _(s, d):
    w = Window.partitionBy("camera")
    e = metrics(s, d).withColumn("camera", F.col("seq_id") % 11)
    e = e.withColumns({"i": F.row_number().over(w.orderBy(F.desc("f1"), "fp", "seq_id")) - 1, "n": F.count("*").over(w)})
    at = lambda cond, name: F.max(F.when(F.expr(cond), F.col("seq_id"))).alias(name)
    return e.groupBy("camera").agg(at("i = 0", "best"), at("i = n div 2", "mid"), at("i = n - 1", "worst"))


@query("event_row_index", """SELECT e.seq_id, e.k, arg_min(p.row_idx, {'d': abs(p.t_us - e.start_us), 'i': p.row_idx}) AS start_idx, arg_min(p.row_idx, {'d': abs(p.t_us - e.end_us), 'i': p.row_idx}) AS end_idx, arg_min(p.row_idx, {'d': abs(2 * p.t_us - e.start_us - e.end_us), 'i': p.row_idx}) AS rep_idx
FROM ev_pred e JOIN packets p USING (seq_id) GROUP BY 1, 2""", "packets islands merged gt_islands ev")
def _(s, d):
    """Rows nearest to the start, end and midpoint of each event (first in ties): three as-of lookups, no product."""
    p = packets(s, d).select("seq_id", F.col("t_us").alias("tt"), (F.col("t_us") * 2).alias("t2"), "row_idx")
    e = predicted(s, d).select("seq_id", "k", F.posexplode(F.array(F.col("start_us") * 2, F.col("end_us") * 2, F.col("mid2_us"))).alias("what", "t2"))
    near = M.nearest_in_time(e, p.select("seq_id", "t2", "row_idx"), K, "t2", "row_idx")
    at = lambda k, name: F.max(F.when(F.col("what") == k, F.col("near_row_idx"))).alias(name)
    return near.groupBy("seq_id", "k").agg(at(0, "start_idx"), at(1, "end_idx"), at(2, "rep_idx"))


CANDS = f"""SELECT a.seq_id, a.k AS pi, b.k AS gi, abs(a.start_us - b.start_us) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM islands) a
JOIN (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM gt_islands) b ON a.seq_id = b.seq_id AND abs(a.start_us - b.start_us) <= {SIX}"""
GREEDY = "WITH RECURSIVE " + greedy_sql(CANDS, "m")
BOTH = "packets islands gt_islands"


def greedy(s, d):
    from .matching import candidates

    return M.greedy_match(candidates(s, d), K, "pt", 2 * SIX)


@query("greedy_match", f"{GREEDY} SELECT seq_id, delta, pi, gi FROM m", BOTH)
def _(s, d):
    return greedy(s, d)


FRAMES = "f_pred AS (SELECT seq_id, peak_idx AS fr, row_number() OVER (PARTITION BY seq_id ORDER BY start_idx) AS k FROM islands), f_true AS (SELECT seq_id, (start_idx + end_idx) // 2 AS fr, row_number() OVER (PARTITION BY seq_id ORDER BY start_idx) AS k FROM gt_islands)"
IN_FRAMES = "SELECT p.seq_id, p.k AS pi, g.k AS gi, abs(p.fr - g.fr) AS delta FROM f_pred p JOIN f_true g ON p.seq_id = g.seq_id AND abs(p.fr - g.fr) <= 20"


@query("classify_detections", f"""WITH RECURSIVE {FRAMES}, {greedy_sql(IN_FRAMES, 'm')}
SELECT p.seq_id, p.fr AS frame, CASE WHEN m.pi IS NULL THEN 'ghost' ELSE 'tp' END AS label FROM f_pred p LEFT JOIN m ON m.seq_id = p.seq_id AND m.pi = p.k
UNION ALL SELECT g.seq_id, g.fr, 'miss' FROM f_true g LEFT JOIN m ON m.seq_id = g.seq_id AND m.gi = g.k WHERE m.gi IS NULL""", BOTH)
def _(s, d):
    """In frames (20 at most between a detection and the middle of a true run): hits, ghosts, and misses."""
    from .sequences import islands

    w = Window.partitionBy("seq_id").orderBy("start_idx")
    k = F.row_number().over(w).cast("bigint").alias("k")
    p = islands(s, d).select("seq_id", F.col("peak_idx").alias("fr"), k)
    g = Q.true_runs(packets(s, d), K, O, "gt").select("seq_id", F.expr("(start_idx + end_idx) div 2").alias("fr"), k)
    a, b = p.select("seq_id", F.col("k").alias("pi"), F.col("fr").alias("pf")), g.select("seq_id", F.col("k").alias("gi"), F.col("fr").alias("gf"))
    c = M.band_join(a, b, K, "pf", "gf", 20).withColumn("delta", F.abs(F.col("pf") - F.col("gf")))
    m = M.greedy_match(c, K, "pf", 40)
    hit = p.join(m.select("seq_id", F.col("pi").alias("k"), F.lit("tp").alias("l")), ["seq_id", "k"], "left").select("seq_id", F.col("fr").alias("frame"), F.coalesce("l", F.lit("ghost")).alias("label"))
    return hit.unionByName(g.join(m.select("seq_id", F.col("gi").alias("k")), ["seq_id", "k"], "left_anti").select("seq_id", F.col("fr").alias("frame"), F.lit("miss").alias("label")))


@query("unmatched_events", f"{GREEDY}, g AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start_us) AS k FROM gt_islands) SELECT g.seq_id, g.k, g.start_us FROM g LEFT JOIN m ON m.seq_id = g.seq_id AND m.gi = g.k WHERE m.gi IS NULL", BOTH)
def _(s, d):
    from .matching import numbered, truths

    return numbered(truths(s, d)).join(greedy(s, d).select("seq_id", F.col("gi").alias("k")), ["seq_id", "k"], "left_anti").select("seq_id", "k", "start_us")


# --- frame level -------------------------------------------------------------------------------------------------------

COUNTS = ", ".join(f"CAST(sum(({e})::INT) AS BIGINT) AS {n}" for n, e in (("tp", "on_ AND gt"), ("fp", "on_ AND NOT gt"), ("fn", "NOT on_ AND gt"), ("tn", "NOT on_ AND NOT gt")))
SCORES = ", ".join([q("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "precision"), q("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END", "recall"), q("CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "f1")])
MARKS = (5, 7, 9)  # fixed values: tenths of the thresholds


@query("threshold_sweep", f"WITH c AS (SELECT k, {COUNTS} FROM (SELECT p.gt, t.k, p.prob > t.k / 10.0::DOUBLE AS on_ FROM packets p, (VALUES (5), (7), (9)) t(k)) GROUP BY 1) SELECT CAST(k AS BIGINT) AS k, tp, fp, fn, tn, {SCORES} FROM c", "packets")
def _(s, d):
    """Strictly above each threshold; thresholds are columns of one pass, not copies of the rows."""
    p, gt = packets(s, d), F.col("gt")
    marks = [F.struct(F.lit(k).cast("bigint").alias("k"), *[F.count_if(e).alias(n) for n, e in (("tp", on & gt), ("fp", on & ~gt), ("fn", ~on & gt), ("tn", ~on & ~gt))]) for k in MARKS for on in [F.col("prob") > k / 10]]
    c = p.agg(F.array(*marks).alias("a")).select(F.inline("a"))
    return c.select("*", *[r(v, n) for n, v in E.scores(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("pr_auc", f"""WITH k AS (SELECT seq_id, row_idx, prob, row_number() OVER w AS i, sum(gt::INT) OVER w AS tp FROM packets WINDOW w AS (PARTITION BY seq_id ORDER BY prob DESC, row_idx ROWS UNBOUNDED PRECEDING)),
z AS (SELECT seq_id, i, tp / i AS p, tp / nullif(max(tp) OVER (PARTITION BY seq_id), 0) AS r FROM k), t AS (SELECT seq_id, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS a FROM z WINDOW w AS (PARTITION BY seq_id ORDER BY i))
SELECT seq_id, round(coalesce(sum(a), 0) + 1e-9, 6) AS pr_auc FROM t GROUP BY 1""", "packets")
def _(s, d):
    """Trapezoids under precision over recall, from (0, 1) on; 0 without positives."""
    w = Window.partitionBy("seq_id").orderBy(F.desc("prob"), "row_idx")
    i, tp = F.row_number().over(w), F.sum(F.col("gt").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    k = packets(s, d).select("seq_id", "prob", "row_idx", i.alias("i"), tp.alias("tp"), F.count_if("gt").over(Window.partitionBy("seq_id")).alias("all"))
    k = k.withColumns({"p": F.col("tp") / F.col("i"), "r": F.col("tp") / F.nullif(F.col("all"), F.lit(0))})
    o = Window.partitionBy("seq_id").orderBy("i")
    area = (F.col("r") - F.coalesce(F.lag("r").over(o), F.lit(0.0))) * (F.col("p") + F.coalesce(F.lag("p").over(o), F.lit(1.0))) / 2
    return k.withColumn("a", area).groupBy("seq_id").agg(r(F.coalesce(F.sum("a"), F.lit(0.0)), "pr_auc"))


NEAR_MARK = "nm AS (SELECT t.seq_id, t.row_idx, min(abs(t.row_idx - p.row_idx)) AS d FROM packets t JOIN packets p ON p.seq_id = t.seq_id AND p.prob > 0.5 WHERE t.marker GROUP BY 1, 2)"


@query("boundary_delta_stats", f"WITH {NEAR_MARK} SELECT count(*) AS n, {q('avg(d)', 'mean')}, {q('quantile_cont(d, 0.5)', 'median')}, {q('quantile_cont(d, 0.9)', 'p90')}, {q('quantile_cont(d, 0.95)', 'p95')}, max(d) AS most, {q('avg((d = 0)::INT)', 'exact')}, {q('avg((d <= 1)::INT)', 'within_one')} FROM nm", "packets")
def _(s, d):
    """Packets between each true boundary and the nearest predicted one; counted by value before quantiles are read."""
    p = packets(s, d)
    true, pred = p.filter("marker").select("seq_id", "row_idx"), p.filter("prob > 0.5").select("seq_id", "row_idx", F.col("row_idx").alias("i"))
    near = M.nearest_in_time(true, pred, K, "row_idx", "i").filter("near_i is not null")
    n = near.groupBy(F.abs(F.col("row_idx") - F.col("near_i")).alias("v")).agg(F.count("*").alias("n"))
    each = lambda v: F.sum(F.col("n") * v) / F.sum("n")
    p_at = lambda x: F.percentile("v", x, F.col("n"))
    v = F.col("v")
    return n.agg(F.sum("n").alias("n"), r(each(v), "mean"), r(p_at(0.5), "median"), r(p_at(0.9), "p90"), r(p_at(0.95), "p95"), F.max("v").alias("most"), r(each((v == 0).cast("int")), "exact"), r(each((v <= 1).cast("int")), "within_one"))


TIMES = ["mean_error", "mean_abs_error", "median_abs_error", "jitter", "rms_error"]


@query("timing_summary", f"SELECT seq_id, count(*) AS n, {q('avg(e)', 'mean_error')}, {q('avg(abs(e))', 'mean_abs_error')}, {q('quantile_cont(abs(e), 0.5)', 'median_abs_error')}, {q('stddev_pop(e)', 'jitter')}, {q('sqrt(avg(e * e))', 'rms_error')} FROM (SELECT seq_id, (p.start_us + p.end_us - g.start_us - g.end_us) / 2e6 AS e FROM paired m JOIN ev_pred p USING (seq_id) JOIN ev_true g USING (seq_id) WHERE p.k = m.pi AND g.k = m.gi) GROUP BY 1", EV)
def _(s, d):
    e = pairs(s, d).withColumn("e", F.col("error_us2") / 2e6)
    return e.groupBy("seq_id").agg(F.count("*").alias("n"), *[r(c, k) for k, c in E.timing(F.col("e")).items()])


NEAR = """near_t AS (SELECT l.seq_id, l.t_us, any_value(l.frame_len) AS frame_len, arg_min(x.frame_len, {'d': abs(x.t_us - l.t_us), 't': x.t_us}) AS near_len
FROM packets l JOIN packets x ON x.seq_id = l.seq_id AND x.gt AND NOT x.marker WHERE l.marker GROUP BY 1, 2)"""


@query("size_error_summary", f"WITH {NEAR}, e AS (SELECT seq_id, frame_len AS t, near_len - frame_len AS e FROM near_t) SELECT seq_id, count(*) AS n, {q('avg(abs(e))', 'mae')}, {q('sqrt(avg(e * e))', 'rmse')}, {q('avg(abs(e)) / greatest(avg(t), 1)', 'nmae')}, {q('sqrt(avg(e * e)) / greatest(avg(t), 1)', 'nrmse')}, {q('avg(abs(e) / greatest(t, 1))', 'mape')}, {q('avg(t)', 'mean_true')} FROM e GROUP BY 1", "packets")
def _(s, d):
    from .matching import nearest

    e, t = F.col("near_frame_len") - F.col("frame_len"), F.col("frame_len")
    mae, rmse, mean = F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), F.greatest(F.avg(t), F.lit(1.0))
    return nearest(s, d).groupBy("seq_id").agg(F.count("*").alias("n"), r(mae, "mae"), r(rmse, "rmse"), r(mae / mean, "nmae"), r(rmse / mean, "nrmse"), r(F.avg(F.abs(e) / F.greatest(t, F.lit(1))), "mape"), r(F.avg(t), "mean_true"))


@query("marker_accuracy", f"SELECT seq_id, count(*) AS n, {q('100 * avg((marker = (prob > 0.5))::INT)', 'percent')}, CAST(sum(marker::INT) AS BIGINT) AS true_on, CAST(sum((NOT marker)::INT) AS BIGINT) AS true_off, CAST(sum((prob > 0.5)::INT) AS BIGINT) AS pred_on, CAST(sum((prob <= 0.5)::INT) AS BIGINT) AS pred_off FROM packets GROUP BY 1", "packets")
def _(s, d):
    on = F.col("prob") > 0.5
    return packets(s, d).groupBy("seq_id").agg(F.count("*").alias("n"), r(100 * F.avg((F.col("marker") == on).cast("double")), "percent"), F.count_if("marker").alias("true_on"), F.count_if(~F.col("marker")).alias("true_off"), F.count_if(on).alias("pred_on"), F.count_if(~on).alias("pred_off"))


@query("speed_error", f"WITH e AS (SELECT seq_id, frame_len - lag(frame_len) OVER (PARTITION BY seq_id ORDER BY row_idx) AS e FROM packets) SELECT seq_id, count(e) AS n, {q('coalesce(avg(abs(e)), 0)', 'mae')}, {q('coalesce(sqrt(avg(e * e)), 0)', 'rmse')} FROM e GROUP BY 1", "packets")
def _(s, d):
    """The value before as prediction: mean absolute and root mean square error as partial sums; 0 without rows."""
    e = F.col("e")
    p = packets(s, d).select("seq_id", (F.col("frame_len") - F.lag("frame_len").over(Q.over(K, O))).alias("e"))
    return p.groupBy("seq_id").agg(F.count("e").alias("n"), r(F.coalesce(F.avg(F.abs(e)), F.lit(0.0)), "mae"), r(F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)), "rmse"))


# --- settings ----------------------------------------------------------------------------------------------------------

#: The default grid, seconds and scores.
THRESHOLDS, PAIRS = (0.5, 0.6, 0.7, 0.8), ((0.9, 0.6), (0.95, 0.6), (0.95, 0.7))
GAPS, TOLERANCES, DURATIONS = (1.0, 2.0, 3.0), (0.5, 1.0, 2.0), (0.0, 0.25, 0.5, 0.75, 1.0)


@query("hyperparam_grid", """WITH w AS (SELECT * FROM (VALUES (-1, NULL, NULL), (0, 0.5, 0.5), (1, 0.6, 0.6), (2, 0.7, 0.7), (3, 0.8, 0.8), (4, 0.9, 0.6), (5, 0.95, 0.6), (6, 0.95, 0.7)) t(bin, a, b))
SELECT row_number() OVER (ORDER BY bin, g, t, m) - 1 AS grid_idx, CAST(bin AS BIGINT) AS bin, CAST(a AS DOUBLE) AS on_at, CAST(b AS DOUBLE) AS off_at, CAST(g AS DOUBLE) AS gap, CAST(t AS DOUBLE) AS tol, CAST(m AS DOUBLE) AS least
FROM w, (VALUES (1.0), (2.0), (3.0)) g(g), (VALUES (0.5), (1.0), (2.0)) t(t), (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) m(m)""")
def _(s, d):
    """360 settings: 45 for a given flag, 315 for scores; sizes are those of the lists, never of the data."""
    rows = E.grid(THRESHOLDS, PAIRS, GAPS, TOLERANCES, DURATIONS, with_flag=True)
    return s.createDataFrame(rows, "grid_idx bigint, bin bigint, on_at double, off_at double, gap double, tol double, least double")


#: The grid at the time scale of the event table: hours.
SETTINGS = E.grid((0.4, 0.5, 0.6), ((0.6, 0.3), (0.5, 0.3)), (12 * HOUR, DAY), (3 * HOUR, SIX), (0, 3 * HOUR, 12 * HOUR))
_VALUES = ", ".join(f"({i}, {b}, {on}::DOUBLE, {off}::DOUBLE, {g}, {t}, {m})" for i, b, on, off, g, t, m in SETTINGS)
SWEPT = f"""st AS (SELECT * FROM (VALUES {_VALUES}) t(grid_idx, bin, on_at, off_at, gap, tol, least)), ways AS (SELECT DISTINCT bin, on_at, off_at FROM st), gs AS (SELECT DISTINCT gap FROM st),
v AS (SELECT p.*, bin, CASE WHEN on_at = off_at THEN (prob >= on_at)::INT WHEN prob >= on_at THEN 1 WHEN prob <= off_at THEN 0 END AS vote FROM packets p, ways),
a AS (SELECT *, coalesce(last_value(vote IGNORE NULLS) OVER (PARTITION BY seq_id, bin ORDER BY row_idx), 0) AS active FROM v),
mk AS (SELECT *, row_idx - row_number() OVER (PARTITION BY seq_id, bin, active ORDER BY row_idx) AS grp FROM a),
isl AS (SELECT seq_id, bin, min(t_us) AS start_us, max(t_us) AS end_us FROM mk WHERE active = 1 GROUP BY seq_id, bin, grp),
pg AS (SELECT *, max(end_us) OVER (PARTITION BY seq_id, bin, gap ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM isl, gs),
ps AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - prev_end >= gap THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, bin, gap ORDER BY start_us) AS s FROM pg),
pe AS (SELECT seq_id, bin, gap, min(start_us) AS start_us, max(end_us) AS end_us FROM ps GROUP BY seq_id, bin, gap, s),
tg AS (SELECT *, max(end_us) OVER (PARTITION BY seq_id, gap ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM gt_islands, gs),
ts AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - prev_end >= gap THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, gap ORDER BY start_us) AS s FROM tg),
te AS (SELECT seq_id, gap, min(start_us) + max(end_us) AS m2, row_number() OVER (PARTITION BY seq_id, gap ORDER BY min(start_us)) AS k FROM ts GROUP BY seq_id, gap, s),
pk AS (SELECT pe.seq_id * 100000 + st.grid_idx AS cell, pe.seq_id, st.grid_idx, st.tol, st.gap, pe.start_us + pe.end_us AS m2, row_number() OVER (PARTITION BY pe.seq_id, st.grid_idx ORDER BY pe.start_us) AS k FROM pe JOIN st ON st.bin = pe.bin AND st.gap = pe.gap WHERE pe.end_us - pe.start_us >= st.least),
{greedy_sql('SELECT pk.cell, pk.k AS pi, te.k AS gi, abs(pk.m2 - te.m2) AS delta FROM pk JOIN te ON te.seq_id = pk.seq_id AND te.gap = pk.gap AND abs(pk.m2 - te.m2) <= 2 * pk.tol', 'm', 'cell')},
np AS (SELECT cell, count(*) AS n FROM pk GROUP BY 1), nt AS (SELECT seq_id, gap, count(*) AS n FROM te GROUP BY 1, 2), nh AS (SELECT cell, count(*) AS n FROM m GROUP BY 1),
c AS (SELECT s.seq_id, st.grid_idx, coalesce(np.n, 0) AS n_pred, coalesce(nt.n, 0) AS n_true, coalesce(nh.n, 0) AS tp FROM (SELECT DISTINCT seq_id FROM packets) s CROSS JOIN st LEFT JOIN np ON np.cell = s.seq_id * 100000 + st.grid_idx LEFT JOIN nh ON nh.cell = s.seq_id * 100000 + st.grid_idx LEFT JOIN nt ON nt.seq_id = s.seq_id AND nt.gap = st.gap),
swept AS (SELECT seq_id, CAST(grid_idx AS BIGINT) AS grid_idx, n_pred, n_true, tp, n_pred - tp AS fp, n_true - tp AS fn, CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2 * tp / (n_pred + n_true) END AS f1 FROM c)"""


def swept(s, d):
    return E.sweep(packets(s, d), K, O, "prob", "gt", SETTINGS)


@query("sweep_eval", f"WITH RECURSIVE {SWEPT} SELECT seq_id, grid_idx, n_pred, n_true, tp, fp, fn, {q('f1', 'f1')} FROM swept", BOTH)
def _(s, d):
    return swept(s, d).select("seq_id", "grid_idx", "n_pred", "n_true", "tp", "fp", "fn", r("f1", "f1"))


@query("best_hyperparams", f"WITH RECURSIVE {SWEPT}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY f1 DESC, tp DESC, fp, grid_idx) AS k FROM swept) SELECT seq_id, grid_idx, tp, fp, fn, {q('f1', 'f1')} FROM b WHERE k = 1", BOTH)
def _(s, d):
    return E.best_settings(swept(s, d), K).select("seq_id", "grid_idx", "tp", "fp", "fn", r("f1", "f1"))


# --- exports and splits ------------------------------------------------------------------------------------------------


def stem():
    return F.concat(F.lit("2026_01_"), F.lpad((F.col("seq_id") % 9 + 1).cast("string"), 2, "0"), F.lit("_00_00_00_camera_"), F.col("seq_id"), F.lit("_x"))


STEM = "'2026_01_' || lpad((seq_id % 9 + 1)::VARCHAR, 2, '0') || '_00_00_00_camera_' || seq_id || '_x'"
INDEX = f"""ix AS (SELECT {STEM} AS sequence, CAST(p.seq_id AS VARCHAR) AS camera_id, 'x/' || {STEM} || '.csv' AS x_csv, 'y_truth/' || {STEM} || '_truth.csv' AS y_truth_csv, coalesce(m.n, 0) AS num_detections, p.n AS num_truth_frames, 'row_idx' AS frame_col, p.f AS first_frame,
  24.0::DOUBLE AS merge_gap_h, 3.0::DOUBLE AS min_duration_h, 'peak' AS representative, true AS binarize_from_scores, '' AS threshold FROM (SELECT seq_id, count(*) AS n, min(row_idx) AS f FROM packets GROUP BY 1) p LEFT JOIN (SELECT seq_id, count(*) AS n FROM merged WHERE end_us - start_us >= {3 * HOUR} GROUP BY 1) m ON m.seq_id = p.seq_id)""".replace("(seq_id % 9", "(p.seq_id % 9").replace("|| seq_id ||", "|| p.seq_id ||")


def index(s, d):
    frames = packets(s, d).groupBy("seq_id").agg(F.count("*").alias("num_truth_frames"), F.min("row_idx").alias("first_frame"))
    found = passages(s, d).groupBy("seq_id").agg(F.count("*").alias("num_detections"))
    from ..sinks import export_index

    return export_index(frames.join(found, "seq_id", "left").fillna(0, ["num_detections"]), stem(), F.col("seq_id").cast("string"), frame_col="row_idx", merge_gap_h=24.0, min_duration_h=3.0, representative="peak", binarize_from_scores=True, threshold="")


@query("export_index", f"WITH {INDEX} SELECT * FROM ix", MERGE_VIEWS)
def _(s, d):
    return index(s, d)


@query("export_index_by_run", f"WITH {INDEX}, rn AS (SELECT *, split_part(sequence, '_camera_', 1) AS run FROM ix) SELECT run, sequence, camera_id, run || '/x/' || split_part(x_csv, '/', 2) AS x_csv, run || '/y/' || split_part(y_truth_csv, '/', 2) AS y_csv, num_detections, num_truth_frames, frame_col, first_frame, merge_gap_h, min_duration_h, representative, binarize_from_scores, threshold FROM rn", MERGE_VIEWS)
def _(s, d):
    from ..sinks import by_run

    return by_run(index(s, d))


@query("run_split", f"""WITH st AS (SELECT split_part({STEM}, '_camera_', 1) AS run, {STEM} AS sequence, count(*) AS n FROM packets GROUP BY seq_id), kept AS (SELECT * FROM st WHERE n >= 60), runs AS (SELECT run, row_number() OVER (ORDER BY md5(run || '|42')) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT run FROM kept))
SELECT kept.run, kept.sequence, CASE WHEN i < greatest(1, round_even(0.8 * c, 0)) - CASE WHEN c - greatest(1, round_even(0.8 * c, 0)) - greatest(1, round_even(0.1 * c, 0)) < 1 THEN 1 - (c - greatest(1, round_even(0.8 * c, 0)) - greatest(1, round_even(0.1 * c, 0))) ELSE 0 END THEN 'train'
  WHEN i < greatest(1, round_even(0.8 * c, 0)) - CASE WHEN c - greatest(1, round_even(0.8 * c, 0)) - greatest(1, round_even(0.1 * c, 0)) < 1 THEN 1 - (c - greatest(1, round_even(0.8 * c, 0)) - greatest(1, round_even(0.1 * c, 0))) ELSE 0 END + greatest(1, round_even(0.1 * c, 0)) THEN 'val' ELSE 'test' END AS part FROM kept JOIN runs USING (run)""", "packets")
def _(s, d):
    """Runs, not sequences, fall to train, validation or test in the order of a hash; short sequences stay out. The ranks
    are over runs (recording sessions), a row each."""
    st = packets(s, d).groupBy("seq_id").agg(F.count("*").alias("n")).filter("n >= 60").select(stem().alias("sequence"))
    st = st.withColumn("run", F.split_part("sequence", F.lit("_camera_"), F.lit(1)))
    runs = st.select("run").distinct()
    w = Window.orderBy(F.md5(F.concat("run", F.lit("|42"))))
    c = F.count("*").over(Window.partitionBy())
    train, val = F.greatest(F.lit(1.0), F.rint(0.8 * c)), F.greatest(F.lit(1.0), F.rint(0.1 * c))
    test = c - train - val
    train = train - F.when(test < 1, 1 - test).otherwise(0)
    i = F.row_number().over(w) - 1
    part = F.when(i < train, "train").when(i < train + val, "val").otherwise("test")
    return st.join(runs.select("run", part.alias("part")), "run").select("run", "sequence", "part")
