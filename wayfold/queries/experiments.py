"""Queries over experiment rows: summaries, pairs, strata, sweeps, resampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import ranks as R
from ..operators import resampling as B
from ..operators.store import durable
from .base import query, runs

EPS = 1e-9


def r(c, name: str):
    """Rounded to six digits, off the edge of decimal ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + EPS, 6).alias(name)


def q(sql: str, name: str) -> str:
    return f"round({sql} + 1e-9, 6) AS {name}"


def finite(value: str):
    v = F.col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def nan_mean(c):
    """Mean of the values that are numbers."""
    return F.avg(F.when(~F.isnan(c), c))


def summary(df, keys: list[str], value: str = "rmse", row_id: str | None = None, resamples: int = B.RESAMPLES, extra: dict | None = None):
    """Of the finite values: count, mean, sample deviation (0 for one value) and its error, median, 95th percentile; share of
    lost rows; with ``row_id`` the mean's bootstrap interval; ``extra`` aggregates. Quantiles come by rank where a group is
    large, and resamples by partial sums, so no group meets in one task. Null keys are groups."""
    df = durable(df)
    v = finite(value)
    std = F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0)
    known = df.groupBy(*keys).agg(F.count(v).alias("n"), r(F.avg(v), "mean"), r(std, "std"), r(std / F.sqrt(F.count(v)), "sem"), r(F.avg((F.col(value) > 100).cast("double")), "lost"), *[c.alias(k) for k, c in (extra or {}).items()])
    fine = df.withColumn("_f", v)
    out = B.beside(known, R.quantiles(fine, keys, "_f", {"median": 0.5, "p95": 0.95}).drop("n"), keys)
    out = out.withColumns({"median": F.round(F.col("median") + EPS, 6), "p95": F.round(F.col("p95") + EPS, 6)})
    if row_id is None:
        return out
    got = B.mean_interval(df, keys, row_id, value, resamples).drop("n", "mean")
    return B.beside(out, got, keys).withColumns({"lo": F.round(F.col("lo") + EPS, 6), "hi": F.round(F.col("hi") + EPS, 6)})


STD = "CASE WHEN count(rmse) > 1 THEN stddev_samp(rmse) ELSE 0 END"
STATS = ", ".join(["count(rmse) AS n", q("avg(rmse)", "mean"), q(STD, "std"), q(f"{STD} / sqrt(count(rmse))", "sem"), q("quantile_cont(rmse, 0.5)", "median"), q("quantile_cont(rmse, 0.95)", "p95"), q("avg((rmse > 100)::INT)", "lost")])


def interval_sql(source: str, keys: str, row_id: str, value: str, n: int, name: str = "ci") -> str:
    """Views with the bootstrap interval of a mean: ``name`` has keys, lo and hi."""
    return f"""{name}_s AS (SELECT {keys}, b, sum(w * {value}) / sum(w) AS v FROM (SELECT {keys}, {value}, b, {B.weight_sql(row_id, 'b')} AS w FROM {source}, range({n}) t(b)) GROUP BY {keys}, b HAVING sum(w) > 0),
{name} AS (SELECT {keys}, {q('quantile_cont(v, 0.025)', 'lo')}, {q('quantile_cont(v, 0.975)', 'hi')} FROM {name}_s GROUP BY {keys})"""


#: Several rows share a trajectory, estimator, condition and seed; they count as their mean.
CELL = ["trajectory_id", "estimator", "condition"]
CELLS = "cells AS (SELECT trajectory_id, estimator, condition, avg(rmse) AS rmse, avg(gap) AS gap FROM runs GROUP BY 1, 2, 3)"


def cells(s, d):
    return runs(s, d).groupBy(*CELL).agg(F.avg("rmse").alias("rmse"), F.avg("gap").alias("gap"))


def stratum(c: str = "gap"):
    return S.bins(F.col(c), [(10.0, "easy"), (30.0, "medium")], "hard")


STRATUM = "CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < 10 THEN 'easy' WHEN gap < 30 THEN 'medium' ELSE 'hard' END"


#: A row's own number, and resamples of whole rows (cells take the default of 10,000).
ROW_ID, ROW_RESAMPLES = "l_orderkey * 8 + seed", 1000
ROWS = f"rows_ AS (SELECT *, {ROW_ID} AS row_id FROM runs)"


def rows(s, d):
    return runs(s, d).withColumn("row_id", F.expr(ROW_ID))


@query("summarise", f"WITH {ROWS}, {interval_sql('rows_', 'estimator, condition', 'row_id', 'rmse', ROW_RESAMPLES)}, g AS (SELECT estimator, condition, {STATS} FROM runs GROUP BY 1, 2) SELECT g.*, lo, hi FROM g JOIN ci USING (estimator, condition)", "runs")
def _(s, d):
    return summary(rows(s, d), ["estimator", "condition"], row_id="row_id", resamples=ROW_RESAMPLES)


@query("grouped_summary", f"SELECT estimator, nullif(level, 0.05) AS level, {STATS}, {q('avg(rmse) FILTER (seed <> 3)', 'mae_mean')}, {q('max(rmse)', 'most')}, {q('avg(CASE WHEN seed = 3 THEN NULL ELSE gap / 50 END)', 'coverage_mean')} FROM runs GROUP BY 1, 2", "runs")
def _(s, d):
    """Null levels (0.05 here) are a group; the means of further columns leave NaN out (rows of seed 3 have it here)."""
    x = runs(s, d).withColumns({"level": F.nullif("level", F.lit(0.05)), "mae": F.when(F.col("seed") == 3, float("nan")).otherwise(F.col("rmse")), "coverage": F.when(F.col("seed") == 3, float("nan")).otherwise(F.col("gap") / 50)})
    return summary(x, ["estimator", "level"], extra={"mae_mean": F.round(nan_mean(F.col("mae")) + EPS, 6), "most": F.round(F.max("rmse") + EPS, 6), "coverage_mean": F.round(nan_mean(F.col("coverage")) + EPS, 6)})


@query("two_level_agg", f"WITH {CELLS}, {interval_sql('cells', 'estimator, condition', 'trajectory_id', 'rmse', B.RESAMPLES)}, g AS (SELECT estimator, condition, {STATS} FROM cells GROUP BY 1, 2) SELECT g.*, lo, hi FROM g JOIN ci USING (estimator, condition)", "runs")
def _(s, d):
    return summary(cells(s, d), ["estimator", "condition"], row_id="trajectory_id")


@query("paper_table", f"SELECT estimator, {q('avg(rmse) FILTER (condition = $$A_perimeter_only$$)', 'a')}, {q('avg(rmse) FILTER (condition = $$C_sidechannel$$)', 'c')}, {q('1 - avg(rmse) FILTER (condition = $$C_sidechannel$$) / avg(rmse) FILTER (condition = $$A_perimeter_only$$)', 'reduction')} FROM runs GROUP BY 1", "runs")
def _(s, d):
    a, c = (F.avg(F.when(F.col("condition") == k, F.col("rmse"))) for k in ("A_perimeter_only", "C_sidechannel"))
    return runs(s, d).groupBy("estimator").agg(r(a, "a"), r(c, "c"), r(1 - c / a, "reduction"))


@query("pivot_compare", f"WITH {CELLS} SELECT trajectory_id, {', '.join(q(f'avg(rmse) FILTER (estimator = $${e}$$)', e) for e in ('dead_reckoning', 'kalman', 'road_pf'))} FROM cells WHERE condition = 'C_sidechannel' GROUP BY 1", "runs")
def _(s, d):
    names = ["dead_reckoning", "kalman", "road_pf"]
    p = cells(s, d).filter("condition = 'C_sidechannel'").groupBy("trajectory_id").pivot("estimator", names).agg(F.avg("rmse"))
    return p.select("trajectory_id", *[r(n, n) for n in names])


PAIRS = f"{CELLS}, pairs AS (SELECT a.trajectory_id, a.estimator, a.rmse AS a, c.rmse AS c, a.rmse - c.rmse AS delta, a.gap AS gap FROM cells a JOIN cells c USING (trajectory_id, estimator) WHERE a.condition = 'A_perimeter_only' AND c.condition = 'C_sidechannel')"


def pairs(s, d):
    """Both conditions of a trajectory side by side: one shuffle by the pair's key, no self-join."""
    side = lambda k, c: F.max(F.when(F.col("condition") == k, F.col(c)))
    p = cells(s, d).groupBy("trajectory_id", "estimator").agg(side("A_perimeter_only", "rmse").alias("a"), side("C_sidechannel", "rmse").alias("c"), side("A_perimeter_only", "gap").alias("gap"))
    return p.filter("a IS NOT NULL AND c IS NOT NULL").withColumn("delta", F.col("a") - F.col("c"))


@query("paired_delta", f"""WITH k AS (SELECT trajectory_id, estimator, condition, seed, avg(rmse) AS rmse FROM runs GROUP BY 1, 2, 3, 4), d AS (SELECT a.trajectory_id, a.estimator, c.rmse - a.rmse AS delta FROM k a JOIN k c USING (trajectory_id, estimator, seed) WHERE a.condition = 'A_perimeter_only' AND c.condition = 'C_sidechannel'),
t AS (SELECT trajectory_id, estimator, avg(delta) AS delta, count(*) AS k FROM d GROUP BY 1, 2), {interval_sql('t', 'estimator', 'trajectory_id', 'delta', B.RESAMPLES)}, g AS (SELECT estimator, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_pairs, {q('avg(delta)', 'delta')}, {q('min(delta)', 'least')}, {q('max(delta)', 'most')} FROM t GROUP BY 1) SELECT g.*, lo, hi FROM g JOIN ci USING (estimator)""", "runs")
def _(s, d):
    """Both conditions paired on trajectory and seed, the mean difference of each trajectory, and the interval of its mean over
    trajectories: two aggregates and a bootstrap, no join of rows."""
    side = lambda k: F.avg(F.when(F.col("condition") == k, F.col("rmse")))
    p = runs(s, d).groupBy("trajectory_id", "estimator", "seed").agg(side("A_perimeter_only").alias("a"), side("C_sidechannel").alias("c")).filter("a IS NOT NULL AND c IS NOT NULL")
    t = durable(p.groupBy("trajectory_id", "estimator").agg(F.avg(F.col("c") - F.col("a")).alias("delta"), F.count("*").alias("k")))
    g = t.groupBy("estimator").agg(F.count("*").alias("n"), F.sum("k").alias("n_pairs"), r(F.avg("delta"), "delta"), r(F.min("delta"), "least"), r(F.max("delta"), "most"))
    return B.beside(g, B.mean_interval(t, ["estimator"], "trajectory_id", "delta").select("estimator", r("lo", "lo"), r("hi", "hi")), ["estimator"])


@query("sweep_summary", f"WITH g AS (SELECT estimator, nullif(level, 0.05) AS level, count(*) AS n, avg(rmse) AS m FROM runs GROUP BY 1, 2), e AS (SELECT estimator, nullif(level, 0.05) AS level, avg(gap) AS gap FROM runs WHERE condition = 'C_sidechannel' AND level < 0.08 GROUP BY 1, 2) SELECT g.estimator, g.level, g.n, {q('g.m', 'mean')}, {q('e.gap', 'gap')} FROM g LEFT JOIN e ON e.estimator = g.estimator AND e.level IS NOT DISTINCT FROM g.level", "runs")
def _(s, d):
    """Extra means merged onto the aggregate; the level may be null on both sides (here 0.05 is), which joins with itself."""
    x = runs(s, d).withColumn("level", F.nullif("level", F.lit(0.05)))
    g = x.groupBy("estimator", "level").agg(F.count("*").alias("n"), F.avg("rmse").alias("m"))
    e = x.filter("condition = 'C_sidechannel' AND coalesce(level, 0.05) < 0.08").groupBy(F.col("estimator").alias("e"), F.col("level").alias("l")).agg(F.avg("gap").alias("gap"))
    return g.join(e, (F.col("estimator") == F.col("e")) & F.col("level").eqNullSafe(F.col("l")), "left").select("estimator", "level", "n", r("m", "mean"), r("gap", "gap"))


@query("stratify", f"SELECT l_orderkey, seed, gap, {STRATUM} AS stratum FROM runs", "runs")
def _(s, d):
    return runs(s, d).select("l_orderkey", "seed", "gap", stratum().alias("stratum"))


@query("by_stratum", f"WITH st AS (SELECT *, {STRATUM} AS stratum FROM runs) SELECT coalesce(stratum, 'all') AS stratum, estimator, {STATS} FROM st GROUP BY GROUPING SETS ((stratum, estimator), (estimator))", "runs")
def _(s, d):
    twice = runs(s, d).withColumn("stratum", F.explode(F.array(stratum(), F.lit("all"))))
    return summary(twice, ["stratum", "estimator"])


FIRST = "first_ AS (SELECT trajectory_id, arg_min({'gap': gap, 'level': level}, {'o': l_orderkey, 's': seed, 'g': gap, 'l': level}) AS f FROM runs GROUP BY 1), per AS (SELECT trajectory_id, f.gap AS gap, f.level AS level FROM first_)"
LEVEL = "CASE WHEN level < 0.03 THEN 'low' WHEN level < 0.07 THEN 'mid' ELSE 'high' END"


def per_trajectory(s, d):
    """The first row of each trajectory, with its stratum on both axes."""
    f = runs(s, d).groupBy("trajectory_id").agg(F.min_by(F.struct("gap", "level"), F.struct("l_orderkey", "seed", "gap", "level")).alias("f")).select("trajectory_id", "f.gap", "f.level")
    return f.withColumns({"stratum": stratum(), "level_stratum": S.bins(F.col("level"), [(0.03, "low"), (0.07, "mid")], "high")})


@query("stratum_profile", f"WITH {FIRST} SELECT {STRATUM} AS stratum, count(*) AS n, {q('avg(gap)', 'gap')}, {q('avg(level)', 'level')}, {q('min(gap)', 'lo')}, {q('max(gap)', 'hi')} FROM per GROUP BY 1", "runs")
def _(s, d):
    return per_trajectory(s, d).groupBy("stratum").agg(F.count("*").alias("n"), r(F.avg("gap"), "gap"), r(F.avg("level"), "level"), r(F.min("gap"), "lo"), r(F.max("gap"), "hi"))


@query("stratum_crosstab", f"WITH {FIRST} SELECT {STRATUM} AS stratum, {LEVEL} AS level_stratum, count(*) AS n FROM per GROUP BY 1, 2", "runs")
def _(s, d):
    return per_trajectory(s, d).groupBy("stratum", "level_stratum").agg(F.count("*").alias("n"))


@query("axis_correlation", f"WITH {FIRST} SELECT count(*) AS n, {q('corr(gap, level)', 'pearson')} FROM per", "runs")
def _(s, d):
    return per_trajectory(s, d).agg(F.count("*").alias("n"), r(F.corr("gap", "level"), "pearson"))


#: Rows with the gain of one estimator over another on a trajectory, and its stratum.
GAINS = f"""{CELLS}, gains AS (SELECT trajectory_id, avg(rmse) FILTER (estimator = 'kalman') AS base, avg(rmse) FILTER (estimator = 'road_pf') AS best, avg(gap) FILTER (estimator = 'kalman') AS gap, avg(gap) FILTER (estimator = 'road_pf') AS own_gap
  FROM cells WHERE condition = 'C_sidechannel' GROUP BY 1),
gain AS (SELECT *, base - best AS gain, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < 24 THEN 'easy' WHEN gap < 27 THEN 'medium' ELSE 'hard' END AS stratum FROM gains WHERE base IS NOT NULL AND best IS NOT NULL)"""


def gains(s, d):
    of = lambda k, c: F.avg(F.when(F.col("estimator") == k, F.col(c)))
    c = cells(s, d).filter("condition = 'C_sidechannel'").groupBy("trajectory_id")
    g = c.agg(of("kalman", "rmse").alias("base"), of("road_pf", "rmse").alias("best"), of("kalman", "gap").alias("gap"), of("road_pf", "gap").alias("own_gap")).filter("base is not null and best is not null")
    return g.withColumns({"gain": F.col("base") - F.col("best"), "stratum": S.bins(F.col("gap"), [(24.0, "easy"), (27.0, "medium")], "hard")})


@query("gain_by_stratum", f"""WITH {GAINS}, {interval_sql('gain', 'stratum', 'trajectory_id', 'gain', B.RESAMPLES)}, g AS (SELECT stratum, count(*) AS n, avg(base) AS b, avg(best) AS c, avg(gain) AS m FROM gain GROUP BY 1)
SELECT stratum, n, {q('b', 'base')}, {q('c', 'best')}, {q('m', 'gain')}, {q('100 * m / b', 'gain_pct')}, CASE WHEN n = 1 THEN {q('m', '').removesuffix(' AS ')} ELSE lo END AS lo, CASE WHEN n = 1 THEN {q('m', '').removesuffix(' AS ')} ELSE hi END AS hi, (CASE WHEN n = 1 THEN m ELSE lo END) > 0 AS significant FROM g JOIN ci USING (stratum)""", "runs")
def _(s, d):
    g = durable(gains(s, d))
    ci = B.mean_interval(g, ["stratum"], "trajectory_id", "gain").drop("n", "mean")
    sums = g.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("base").alias("b"), F.avg("best").alias("c"), F.avg("gain").alias("m"))
    x = B.beside(sums, ci, ["stratum"])
    return x.select("stratum", "n", r("b", "base"), r("c", "best"), r("m", "gain"), r(100 * F.col("m") / F.col("b"), "gain_pct"), r("lo", "lo"), r("hi", "hi"), (F.round(F.col("lo") + EPS, 6) > 0).alias("significant"))


@query("interaction_test", f"""WITH {GAINS}, {interval_sql('gain', 'stratum', 'trajectory_id', 'gain', B.RESAMPLES)}, d AS (SELECT h.v - e.v AS v FROM ci_s h JOIN ci_s e USING (b) WHERE h.stratum = 'hard' AND e.stratum = 'easy')
SELECT {q("(SELECT avg(gain) FROM gain WHERE stratum = 'hard') - (SELECT avg(gain) FROM gain WHERE stratum = 'easy')", 'delta')}, {q('quantile_cont(v, 0.025)', 'lo')}, {q('quantile_cont(v, 0.975)', 'hi')}, {q('avg((v <= 0)::INT)', 'p')} FROM d""", "runs")
def _(s, d):
    """Gain in the hard stratum less gain in the easy one, with its interval and one-sided p."""
    g = durable(gains(s, d))
    got = B.difference(B.resampled(g, ["stratum"], "trajectory_id", ["gain"]), "stratum", "easy", "hard")
    of = lambda k: F.avg(F.when(F.col("stratum") == k, F.col("gain")))
    return got.crossJoin(F.broadcast(g.agg((of("hard") - of("easy")).alias("delta")))).select(r("delta", "delta"), r("lo", "lo"), r("hi", "hi"), r("p", "p"))  # one row by one row


RESID = f"""{GAINS}, f AS (SELECT regr_slope(gain, own_gap) AS gs, regr_intercept(gain, own_gap) AS gi, regr_slope(gap, own_gap) AS xs, regr_intercept(gap, own_gap) AS xi FROM gain),
res AS (SELECT trajectory_id, gap - xi - xs * own_gap AS x, gain - gi - gs * own_gap AS y FROM gain, f)"""


@query("partial_corr", f"""WITH {RESID}, w AS (SELECT x, y, b, {B.weight_sql('trajectory_id', 'b')} AS w FROM res, range({B.RESAMPLES}) t(b)), m AS (SELECT b, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy FROM w GROUP BY 1),
s AS (SELECT CASE WHEN n * xx - x * x > 1e-9 * n * xx AND n * yy - y * y > 1e-9 * n * yy THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS v FROM m)
SELECT {q('(SELECT corr(x, y) FROM res)', 'partial')}, {q('quantile_cont(v, 0.025)', 'lo')}, {q('quantile_cont(v, 0.975)', 'hi')} FROM s""", "runs")
def _(s, d):
    """Correlation of gain and gap with a third variable's line taken out of both, and its interval."""
    g = durable(gains(s, d))
    c = "own_gap"
    f = g.agg(F.regr_slope("gain", c).alias("gs"), F.regr_intercept("gain", c).alias("gi"), F.regr_slope("gap", c).alias("xs"), F.regr_intercept("gap", c).alias("xi"))  # one row
    res = g.crossJoin(F.broadcast(f)).select("trajectory_id", (F.col("gap") - F.col("xi") - F.col("xs") * F.col(c)).alias("x"), (F.col("gain") - F.col("gi") - F.col("gs") * F.col(c)).alias("y"))
    res = durable(res.select("*", (F.col("x") * F.col("x")).alias("xx"), (F.col("y") * F.col("y")).alias("yy"), (F.col("x") * F.col("y")).alias("xy")))
    ci = B.interval(B.resampled(res, [], "trajectory_id", ["x", "y", "xx", "yy", "xy"]), [], B.pearson(1, 2, 3, 4, 5))
    return ci.crossJoin(F.broadcast(res.agg(F.corr("x", "y").alias("c")))).select(r("c", "partial"), r("lo", "lo"), r("hi", "hi"))  # one row by one row


LEVELS = "lv AS (SELECT estimator, level, avg(rmse) AS m FROM runs GROUP BY 1, 2), base AS (SELECT estimator, m AS m0 FROM lv WHERE level = 0)"


def levels(s, d):
    lv = runs(s, d).groupBy("estimator", "level").agg(F.avg("rmse").alias("m"))
    return lv.withColumn("m0", F.max(F.when(F.col("level") == 0, F.col("m"))).over(Window.partitionBy("estimator")))


@query("degradation", f"WITH {LEVELS}, g AS (SELECT estimator, regr_slope(m, level) AS slope, arg_min(m, level) AS a, arg_max(m, level) AS b FROM lv GROUP BY 1), rf AS (SELECT estimator, avg(rmse) AS ref FROM runs WHERE condition = 'A_perimeter_only' GROUP BY 1) SELECT estimator, {q('slope', 'slope')}, {q('b / a - 1', 'increase')}, {q('(ref - b) / (ref - a)', 'gap_kept')} FROM g JOIN rf USING (estimator)", "runs")
def _(s, d):
    """Slope over levels, relative increase from the least to the greatest, and how much of the gain over the reference stays."""
    ref = runs(s, d).filter("condition = 'A_perimeter_only'").groupBy("estimator").agg(F.avg("rmse").alias("ref"))
    g = levels(s, d).groupBy("estimator").agg(F.regr_slope("m", "level").alias("slope"), F.min_by("m", "level").alias("a"), F.max_by("m", "level").alias("b")).join(ref, "estimator")
    return g.select("estimator", r("slope", "slope"), r(F.col("b") / F.col("a") - 1, "increase"), r((F.col("ref") - F.col("b")) / (F.col("ref") - F.col("a")), "gap_kept"))


@query("crossover", f"""WITH m AS (SELECT estimator, level, avg(rmse) AS m FROM runs WHERE condition = 'C_sidechannel' GROUP BY 1, 2), ref AS (SELECT estimator, avg(rmse) AS ref FROM runs WHERE condition = 'A_perimeter_only' GROUP BY 1),
y AS (SELECT estimator, level, m - ref AS y, lag(m - ref) OVER w AS py, lag(level) OVER w AS pl FROM m JOIN ref USING (estimator) WINDOW w AS (PARTITION BY estimator ORDER BY level)), o AS (SELECT estimator, arg_min(y, level) AS y0, min(level) AS l0, min(CASE WHEN py < 0 AND y >= 0 THEN pl + (level - pl) * (0 - py) / (y - py) END) AS hit, arg_max(y, level) AS last FROM y GROUP BY 1)
SELECT estimator, round(CASE WHEN y0 >= 0 THEN l0 ELSE hit END + 1e-9, 6) AS at, {q('y0', 'first')}, {q('last', 'last')}, round(CASE WHEN y0 >= 0 THEN l0 ELSE hit END - 0.03 + 1e-9, 6) AS margin FROM o""", "runs")
def _(s, d):
    """The level at which a condition stops being better than the reference: the first from below zero to zero or more, on the
    line between neighbours; the least level if it never was better; null if it stays so. Margin over a measured 0.03."""
    m = runs(s, d).groupBy("estimator", "level").agg(F.avg(F.when(F.col("condition") == "C_sidechannel", F.col("rmse"))).alias("m")).filter("m IS NOT NULL")
    ref = runs(s, d).filter("condition = 'A_perimeter_only'").groupBy("estimator").agg(F.avg("rmse").alias("ref"))
    w = Window.partitionBy("estimator").orderBy("level")
    y = m.join(ref, "estimator").select("estimator", "level", (F.col("m") - F.col("ref")).alias("y"))
    y = y.withColumns({"py": F.lag("y").over(w), "pl": F.lag("level").over(w)})
    cross = F.when((F.col("py") < 0) & (F.col("y") >= 0), F.col("pl") + (F.col("level") - F.col("pl")) * (0 - F.col("py")) / (F.col("y") - F.col("py")))
    o = y.groupBy("estimator").agg(F.min_by("y", "level").alias("y0"), F.min("level").alias("l0"), F.min(cross).alias("x"), F.max_by("y", "level").alias("z"))
    at = F.when(F.col("y0") >= 0, F.col("l0")).otherwise(F.col("x"))
    return o.select("estimator", r(at, "at"), r("y0", "first"), r("z", "last"), r(at - 0.03, "margin"))


@query("seed_stability", f"WITH s AS (SELECT trajectory_id, estimator, seed, avg(rmse) AS m FROM runs GROUP BY 1, 2, 3), a AS (SELECT estimator, seed, avg(m) AS m FROM s GROUP BY 1, 2), w AS (SELECT trajectory_id, estimator, stddev_samp(m) AS sd FROM s GROUP BY 1, 2), x AS (SELECT estimator, avg(sd) AS within FROM w GROUP BY 1) SELECT a.estimator, count(*) AS n_seeds, {q('max(m) - min(m)', 'spread')}, {q('min(x.within)', 'within')} FROM a JOIN x USING (estimator) GROUP BY 1", "runs")
def _(s, d):
    """Spread of the seeds' means, and the mean deviation within a trajectory over seeds."""
    m = runs(s, d).groupBy("trajectory_id", "estimator", "seed").agg(F.avg("rmse").alias("m"))
    seeds = m.groupBy("estimator", "seed").agg(F.avg("m").alias("m")).groupBy("estimator").agg(F.count("*").alias("n_seeds"), r(F.max("m") - F.min("m"), "spread"))
    within = m.groupBy("trajectory_id", "estimator").agg(F.stddev_samp("m").alias("sd")).groupBy("estimator").agg(r(F.avg("sd"), "within"))
    return seeds.join(within, "estimator")


@query("stable_seed", "SELECT DISTINCT trajectory_id, seed, ('0x' || substr(sha1(trajectory_id::VARCHAR || '|' || seed::VARCHAR), 1, 8))::BIGINT % 2147483648 AS stable FROM runs", "runs")
def _(s, d):
    return runs(s, d).select("trajectory_id", "seed").distinct().withColumn("stable", S.stable_seed(F.col("trajectory_id").cast("string"), F.col("seed").cast("string")))


@query("job_grid", "SELECT e.estimator, t.trajectory_id, c.condition, coalesce(s.seed, 0) AS seed FROM (SELECT DISTINCT estimator FROM runs) e, (SELECT DISTINCT trajectory_id FROM runs) t, (SELECT DISTINCT condition FROM runs) c LEFT JOIN (SELECT DISTINCT seed FROM runs) s ON c.condition = 'C_sidechannel'", "runs")
def _(s, d):
    """Each trajectory with every estimator and condition there is, the noisy condition with every seed, others once: one row
    of short lists joins the trajectories."""
    t = runs(s, d).select("trajectory_id").distinct()
    lists = runs(s, d).agg(F.collect_set("estimator").alias("e"), F.collect_set("condition").alias("c"), F.collect_set("seed").alias("s"))
    g = t.join(F.broadcast(lists)).select("trajectory_id", "c", "s", F.explode("e").alias("estimator")).select("trajectory_id", "s", "estimator", F.explode("c").alias("condition"))
    seed = F.explode(F.when(F.col("condition") == "C_sidechannel", F.col("s")).otherwise(F.array(F.lit(0).cast("bigint"))))
    return g.select("estimator", "trajectory_id", "condition", seed.alias("seed"))


@query("consistency_check", """WITH c AS (SELECT condition, trajectory_id, seed, count(DISTINCT estimator) AS n_est, count(DISTINCT l_partkey % 3) AS a, count(DISTINCT level) AS b FROM runs GROUP BY 1, 2, 3),
t AS (SELECT trajectory_id, count(DISTINCT CASE WHEN gap < 10 THEN 0 WHEN gap < 30 THEN 1 ELSE 2 END) AS k FROM runs GROUP BY 1), n AS (SELECT count(DISTINCT estimator) AS n FROM runs)
SELECT count(*) AS n_cells, count(*) FILTER (n_est <> n.n) AS n_missing, count(*) FILTER (a > 1) AS n_part_differs, count(*) FILTER (b > 1) AS n_level_differs, (SELECT count(*) FROM t WHERE k > 1) AS n_unstable FROM c, n""", "runs")
def _(s, d):
    """Cells (condition, trajectory, seed) in all, without one of the estimators, and with disagreeing columns; trajectories in
    more than one stratum."""
    x = runs(s, d)
    n = x.agg(F.count_distinct("estimator").alias("all"))  # one row
    c = x.groupBy("condition", "trajectory_id", "seed").agg(F.count_distinct("estimator").alias("n_est"), F.count_distinct(F.col("l_partkey") % 3).alias("a"), F.count_distinct("level").alias("b"))
    cells_ = c.crossJoin(F.broadcast(n)).agg(F.count("*").alias("n_cells"), F.count_if(F.col("n_est") != F.col("all")).alias("n_missing"), F.count_if(F.col("a") > 1).alias("n_part_differs"), F.count_if(F.col("b") > 1).alias("n_level_differs"))
    t = x.groupBy("trajectory_id").agg(F.count_distinct(stratum()).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_unstable"))
    return cells_.crossJoin(F.broadcast(t))  # one row by one row


@query("missing_cells", "WITH e AS (SELECT DISTINCT estimator FROM runs), c AS (SELECT DISTINCT condition, trajectory_id, seed FROM runs) SELECT c.*, e.estimator FROM c, e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.condition = c.condition AND r.trajectory_id = c.trajectory_id AND r.seed = c.seed AND r.estimator = e.estimator)", "runs")
def _(s, d):
    """Cells that lack an estimator, with its name: what each cell has against the list of all, no join of rows."""
    x = runs(s, d)
    names = x.agg(F.collect_set("estimator").alias("all"))  # the experiments' estimators, a short list
    c = x.groupBy("condition", "trajectory_id", "seed").agg(F.collect_set("estimator").alias("has"))
    return c.crossJoin(F.broadcast(names)).select("condition", "trajectory_id", "seed", F.explode(F.array_except("all", "has")).alias("estimator"))


@query("rank_exemplars", f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY estimator, condition ORDER BY gap, trajectory_id) - 1 AS i, count(*) OVER (PARTITION BY estimator, condition) AS n FROM cells) SELECT estimator, condition, i AS rk, trajectory_id FROM k WHERE i IN (n // 6, n // 2, n - 1 - n // 6)", "runs")
def _(s, d):
    """Trajectories a sixth from either end and in the middle, by blind gap."""
    g = Window.partitionBy("estimator", "condition")
    k = cells(s, d).withColumns({"rk": F.row_number().over(g.orderBy("gap", "trajectory_id")).cast("bigint") - 1, "n": F.count("*").over(g)})
    return k.filter("rk IN (n div 6, n div 2, n - 1 - n div 6)").select("estimator", "condition", "rk", "trajectory_id")


@query("union_conditions", "SELECT trajectory_id, seed, condition AS kind, rmse, NULL::DOUBLE AS gap FROM runs WHERE condition = 'A_perimeter_only' UNION ALL SELECT trajectory_id, seed, condition, NULL, gap FROM runs WHERE condition <> 'A_perimeter_only'", "runs")
def _(s, d):
    """One table under another, the columns that either lacks as nulls."""
    x = runs(s, d).withColumn("kind", F.col("condition"))
    a = x.filter("condition = 'A_perimeter_only'").select("trajectory_id", "seed", "kind", "rmse")
    return a.unionByName(x.filter("condition <> 'A_perimeter_only'").select("trajectory_id", "seed", "kind", "gap"), allowMissingColumns=True).select("trajectory_id", "seed", "kind", "rmse", "gap")


@query("distinct_points", "SELECT DISTINCT level, gap FROM runs", "runs")
def _(s, d):
    return runs(s, d).select("level", "gap").distinct()


@query("upsert_empirical", "WITH o AS (SELECT trajectory_id, count(*) AS v FROM runs GROUP BY 1), n AS (SELECT trajectory_id, CAST(sum(seed) AS BIGINT) AS v FROM runs WHERE seed > 5 GROUP BY 1) SELECT trajectory_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (trajectory_id)", "runs")
def _(s, d):
    new = F.sum(F.when(F.col("seed") > 5, F.col("seed")))
    return runs(s, d).groupBy("trajectory_id").agg(F.coalesce(new, F.count("*")).alias("v"))


@query("select_sweep", "SELECT l_orderkey, seed, level FROM runs WHERE abs(level - 0.0) <= 1e-12 OR abs(level - 0.05) <= 1e-12 OR abs(level - 0.1) <= 1e-12 UNION ALL SELECT l_orderkey, seed, NULL FROM runs WHERE condition = 'A_perimeter_only'", "runs")
def _(s, d):
    """Levels of the sweep within a tolerance, and the reference rows, whose level is null."""
    x = runs(s, d)
    near = F.lit(False)
    for v in (0.0, 0.05, 0.1):
        near = near | (F.abs(F.col("level") - v) <= 1e-12)
    ref = x.filter("condition = 'A_perimeter_only'").select("l_orderkey", "seed", F.lit(None).cast("double").alias("level"))
    return x.filter(near).select("l_orderkey", "seed", "level").unionByName(ref)


@query("mv_summary", f"SELECT seed, estimator, condition, count(*) AS n, {q('avg(rmse)', 'mean')}, {q('sqrt(avg(rmse * rmse))', 'rms')}, {q('avg(v)', 'nan_mean')}, {q('quantile_cont(v, 0.5)', 'nan_median')} FROM (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN gap END AS v FROM runs) GROUP BY 1, 2, 3", "runs")
def _(s, d):
    """Per number of vehicles (here the seed), estimator and condition; mean and median leave NaN out (every fifth order here)."""
    keys = ["seed", "estimator", "condition"]
    x = durable(runs(s, d).withColumn("v", F.when(F.col("l_orderkey") % 5 == 0, float("nan")).otherwise(F.col("gap"))))
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), r(F.avg("rmse"), "mean"), r(F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))), "rms"), r(nan_mean(F.col("v")), "nan_mean"))
    return B.beside(g, R.quantiles(x, keys, "v", {"m": 0.5}).select(*keys, r("m", "nan_median")), keys)


@query("bootstrap_ci", f"""WITH {CELLS}, {interval_sql('cells', 'estimator, condition', 'trajectory_id', 'rmse', B.RESAMPLES)} SELECT estimator, condition, lo, hi FROM ci""", "runs")
def _(s, d):
    """Percentile interval of the mean over 10,000 resamples, by weights of a counter hash."""
    got = B.mean_interval(cells(s, d), ["estimator", "condition"], "trajectory_id", "rmse")
    return got.select("estimator", "condition", r("lo", "lo"), r("hi", "hi"))
