"""Queries over the packet sequences: scans, frames, runs, sessions, rolling statistics, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import sequences as Q
from .base import packets, query, table

K, O = ["seq_id"], ["row_idx"]
DAY, HOUR = 86_400_000_000, 3_600_000_000
r6 = lambda c, n=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(n or c)
MERGE_VIEWS = "packets islands merged"


@query("scan_packets", "SELECT seq_id, row_idx, t_us, frame_len, marker FROM packets", "packets")
def _(s, d):
    return packets(s, d).select("seq_id", "row_idx", "t_us", "frame_len", "marker")


@query("packet_clean", "SELECT seq_id, row_idx, t_us, frame_len FROM packets WHERE frame_len >= 100", "packets")
def _(s, d):
    clean = packets(s, d).withColumn("size", F.when(F.col("frame_len") >= 100, F.col("frame_len")))
    return clean.na.drop(subset=["t_us", "size"]).select("seq_id", "row_idx", "t_us", "frame_len")


#: A capture made of packets: the source number, and the media time (90 kHz ticks of the packet's day).
RTP = "rtp AS (SELECT seq_id % 7 AS ssrc, (t_us // 86400000000) * 3000 % 4294967296 AS media_time, marker, t_us FROM packets)"


def rtp(s, d):
    return packets(s, d).select((F.col("seq_id") % 7).alias("ssrc"), F.expr("(t_us div 86400000000) * 3000 % 4294967296").alias("media_time"), "marker", "t_us")


@query("stream_diagnostics", f"WITH {RTP} SELECT ssrc, count(*) AS n, CAST(sum(marker::INT) AS BIGINT) AS n_markers, count(DISTINCT media_time) AS n_times FROM rtp GROUP BY 1", "packets")
def _(s, d):
    """Packets, markers and distinct media times of each source."""
    return rtp(s, d).groupBy("ssrc").agg(F.count("*").alias("n"), F.count_if("marker").alias("n_markers"), F.count_distinct("media_time").alias("n_times"))


@query("topk_markers", f"WITH {RTP} SELECT media_time, count(*) AS n FROM rtp WHERE marker GROUP BY 1 ORDER BY n DESC, media_time LIMIT 10", "packets")
def _(s, d):
    """Media times with the most markers, the earlier of equals first: a top-k report."""
    return rtp(s, d).filter("marker").groupBy("media_time").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "media_time").limit(10)


@query("drop_leading_surplus", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n, sum(gt::INT) OVER (PARTITION BY seq_id) AS m FROM packets) SELECT seq_id, row_idx, frame_len FROM c WHERE row_idx > n - m", "packets")
def _(s, d):
    w = Window.partitionBy("seq_id")
    surplus = F.count("*").over(w) - F.sum(F.col("gt").cast("int")).over(w)
    return packets(s, d).withColumn("k", surplus).filter("row_idx > k").select("seq_id", "row_idx", "frame_len")


@query("recompute_flag_stats", "SELECT seq_id, CAST(sum((marker <> (prob >= 0.5))::INT) AS BIGINT) AS flips, count(*) AS n FROM packets GROUP BY 1 HAVING sum((marker <> (prob >= 0.5))::INT) > 0", "packets")
def _(s, d):
    return packets(s, d).groupBy("seq_id").agg(F.count_if(F.col("marker") != (F.col("prob") >= 0.5)).alias("flips"), F.count("*").alias("n")).filter("flips > 0")


@query("normalize_header", "SELECT seq_id, row_idx, marker AS marker_original, marker::INT AS pred_marker, 0.0::DOUBLE AS prob0 FROM packets", "packets")
def _(s, d):
    p = packets(s, d).select("seq_id", "row_idx", F.col("marker").alias(" marker "))
    p = p.toDF(*[c.strip() for c in p.columns])
    original = F.col("marker_original") if "marker_original" in p.columns else F.col("marker")
    return p.select("seq_id", "row_idx", original.alias("marker_original"), F.col("marker").cast("int").alias("pred_marker"), F.lit(0.0).alias("prob0"))


@query("bool_normalize", """SELECT event_id, lower(trim(t)) IN ('1', 'true', 't', 'yes') OR coalesce(TRY_CAST(t AS DOUBLE) = 1, false) AS loose,
  CASE WHEN lower(trim(t)) IN ('true', '1') THEN true WHEN lower(trim(t)) IN ('false', '0') THEN false END AS strict, lower(trim(t)) IN ('true', '1', 'yes') AS yes
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '1.0' WHEN 4 THEN 'Yes ' WHEN 5 THEN 'false' WHEN 6 THEN '0' ELSE 'T' END AS t FROM packets)""", "packets")
def _(s, d):
    words = [" TRUE", "no", "1", "1.0", "Yes ", "false", "0", "T"]
    t = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 8 + 1).cast("int"))
    return packets(s, d).select("event_id", S.text_bool(t).alias("loose"), S.strict_bool(t).alias("strict"), S.yes_bool(t).alias("yes"))


@query("angle_diff", "SELECT event_id, round((((event_id % 13 - 6) - (event_id % 7) * 0.5 + pi()) - floor(((event_id % 13 - 6) - (event_id % 7) * 0.5 + pi()) / (2 * pi())) * 2 * pi()) - pi(), 6) AS diff FROM packets", "packets")
def _(s, d):
    return packets(s, d).select("event_id", r6(S.angle_diff((F.col("event_id") % 13 - 6).cast("double"), (F.col("event_id") % 7) * 0.5), "diff"))


@query("zero_when_hidden", "SELECT event_id, CASE WHEN gt THEN frame_len ELSE 0 END AS speed FROM packets", "packets")
def _(s, d):
    return packets(s, d).select("event_id", F.when(F.col("gt"), F.col("frame_len")).otherwise(0).alias("speed"))


@query("warmup_trim", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM packets) SELECT seq_id, row_idx - 20 AS row_idx, frame_len FROM n WHERE row_idx > 20 AND n > 20", "packets")
def _(s, d):
    return packets(s, d).filter("row_idx > 20").select("seq_id", (F.col("row_idx") - 20).alias("row_idx"), "frame_len")


@query("min_frames_semi", "SELECT seq_id, count(*) AS n FROM packets GROUP BY 1 HAVING count(*) >= 65", "packets")
def _(s, d):
    p = packets(s, d)
    keep = p.groupBy("seq_id").count().filter("count >= 65").select("seq_id")
    return p.join(keep, "seq_id", "left_semi").groupBy("seq_id").agg(F.count("*").alias("n"))


@query("zscore_features", "WITH m AS (SELECT avg(frame_len) AS mu, stddev_pop(frame_len) AS sd FROM packets) SELECT event_id, round((frame_len - mu) / sqrt(greatest(sd * sd, 1e-12)), 6) AS z FROM packets, m", "packets")
def _(s, d):
    p = packets(s, d)
    m = p.agg(F.avg("frame_len").alias("mu"), F.var_pop("frame_len").alias("v"))  # one row
    return p.crossJoin(F.broadcast(m)).select("event_id", r6((F.col("frame_len") - F.col("mu")) / F.sqrt(F.greatest("v", F.lit(1e-12))), "z"))


@query("drop_agg_rows", "SELECT label, n FROM (SELECT CASE WHEN seq_id % 10 = 0 THEN 'MEAN' WHEN seq_id % 10 = 1 THEN 'POOLED' ELSE 'cam' || seq_id END AS label, count(*) AS n FROM packets GROUP BY 1) WHERE label NOT IN ('MEAN', 'MEAN_GT_ONLY', 'POOLED', 'ALL')", "packets")
def _(s, d):
    label = F.when(F.col("seq_id") % 10 == 0, "MEAN").when(F.col("seq_id") % 10 == 1, "POOLED").otherwise(F.concat(F.lit("cam"), F.col("seq_id").cast("string")))
    return packets(s, d).groupBy(label.alias("label")).agg(F.count("*").alias("n")).filter(~F.col("label").isin("MEAN", "MEAN_GT_ONLY", "POOLED", "ALL"))


FRAMES = """seg AS (SELECT *, coalesce(sum(marker::INT) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM packets),
frames AS (SELECT seq_id, CAST(seg AS BIGINT) AS seg, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS bytes, min(t_us) AS first_us, max(t_us) AS last_us, min(row_idx) AS first_idx, max(row_idx) AS last_idx, bool_or(marker) AS closed FROM seg GROUP BY 1, 2)"""


@query("packets_to_frames", f"WITH {FRAMES} SELECT * FROM frames", "packets")
def _(s, d):
    return Q.packets_to_frames(packets(s, d))


@query("closed_frames", f"WITH {FRAMES} SELECT seq_id, seg, last_us, bytes FROM frames WHERE closed", "packets")
def _(s, d):
    return Q.packets_to_frames(packets(s, d)).filter("closed").select("seq_id", "seg", "last_us", "bytes")


@query("marker_count", "SELECT seq_id, CAST(sum(marker::INT) AS BIGINT) AS n FROM packets GROUP BY 1", "packets")
def _(s, d):
    return packets(s, d).groupBy("seq_id").agg(F.count_if("marker").alias("n"))


#: 1e-9 keeps the decimal ties of short inputs off the rounding edge, on both sides.
EWM = """SELECT a.seq_id, a.row_idx, round(sum(CASE WHEN b.row_idx = 1 THEN 1 ELSE {a} END * power(1 - {a}, a.row_idx - b.row_idx) * b.{v}) + 1e-9, 6) AS {o}
FROM packets a JOIN packets b ON a.seq_id = b.seq_id AND b.row_idx <= a.row_idx GROUP BY 1, 2"""


@query("ewm_baseline", EWM.format(a="(2.0 / 33)", v="frame_len", o="ewm"), "packets")
def _(s, d):
    return Q.ewm(packets(s, d).select("seq_id", "row_idx", "frame_len"), K, O, "frame_len", 2 / 33).select("seq_id", "row_idx", r6(F.col("ewm") + 1e-9, "ewm"))


@query("exp_smooth", EWM.format(a="0.3", v="prob", o="smooth"), "packets")
def _(s, d):
    return Q.ewm(packets(s, d).select("seq_id", "row_idx", "prob"), K, O, "prob", 0.3, "smooth").select("seq_id", "row_idx", r6(F.col("smooth") + 1e-9, "smooth"))


@query("frame_features", f"""WITH e AS ({EWM.format(a='(2.0 / 33)', v='frame_len', o='ewm').replace('round(sum', '(sum').replace(' + 1e-9, 6) AS', ') AS')})
SELECT p.seq_id, p.row_idx, round(ln(1 + p.frame_len), 6) AS log_size, round(p.frame_len - e.ewm, 6) AS residual, round(p.frame_len / (e.ewm + 1e-9), 6) AS ratio FROM packets p JOIN e USING (seq_id, row_idx)""", "packets")
def _(s, d):
    e = Q.ewm(packets(s, d).select("seq_id", "row_idx", "frame_len"), K, O, "frame_len", 2 / 33)
    return e.select("seq_id", "row_idx", r6(F.log1p(F.col("frame_len").cast("double")), "log_size"), r6(F.col("frame_len") - F.col("ewm"), "residual"), r6(F.col("frame_len") / (F.col("ewm") + 1e-9), "ratio"))


@query("hysteresis", "SELECT seq_id, row_idx, active FROM states", "packets islands")
def _(s, d):
    return Q.hysteresis(packets(s, d), K, O, "prob", 0.6, 0.3).select("seq_id", "row_idx", "active")


@query("binarize", "SELECT seq_id, row_idx, (prob >= 0.5)::INT AS active FROM packets", "packets")
def _(s, d):
    return Q.binarize(packets(s, d), K, O, "prob", 0.5).select("seq_id", "row_idx", "active")


def islands(s, d):
    return Q.true_runs(Q.hysteresis(packets(s, d), K, O, "prob", 0.6, 0.3), K, O, "active", "t_us", "prob")


@query("true_runs", "SELECT seq_id, start_idx, end_idx, n FROM islands", "packets islands")
def _(s, d):
    return islands(s, d).select("seq_id", "start_idx", "end_idx", "n")


@query("passage_events", "SELECT seq_id, start_us, end_us, peak, peak_idx, peak_us FROM islands", "packets islands")
def _(s, d):
    return islands(s, d).select("seq_id", "start_us", "end_us", "peak", "peak_idx", "peak_us")


@query("merge_gap", "SELECT seq_id, event_idx, start_us, end_us, peak, peak_us, n, n_parts FROM merged", MERGE_VIEWS)
def _(s, d):
    return Q.merge_gaps(islands(s, d), K, DAY).select("seq_id", "event_idx", "start_us", "end_us", "peak", "peak_us", "n", "n_parts")


@query("min_duration", "SELECT seq_id, start_us, end_us FROM merged WHERE end_us - start_us >= 10800000000", MERGE_VIEWS)
def _(s, d):
    return Q.min_duration(Q.merge_gaps(islands(s, d), K, DAY), 3 * HOUR).select("seq_id", "start_us", "end_us")


def passages(s, d):
    return Q.min_duration(Q.merge_gaps(islands(s, d), K, DAY), 3 * HOUR)


@query("passage_pipeline", "SELECT m.seq_id, m.event_idx, m.start_us, m.end_us, m.peak_us AS rep_us, (m.start_us + m.end_us) / 2 AS mid_us, p.row_idx AS rep_idx, m.peak FROM merged m JOIN packets p ON p.seq_id = m.seq_id AND p.t_us = m.peak_us WHERE m.end_us - m.start_us >= 10800000000", MERGE_VIEWS)
def _(s, d):
    at = packets(s, d).select("seq_id", F.col("t_us").alias("peak_us"), F.col("row_idx").alias("rep_idx"))
    return passages(s, d).join(at, ["seq_id", "peak_us"]).select("seq_id", "event_idx", "start_us", "end_us", F.col("peak_us").alias("rep_us"), ((F.col("start_us") + F.col("end_us")) / 2).alias("mid_us"), "rep_idx", "peak")



@query("rolling_quantile", "SELECT seq_id, row_idx, round(quantile_cont(frame_len, 0.2) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 150 PRECEDING AND 150 FOLLOWING), 6) AS q FROM packets", "packets")
def _(s, d):
    return Q.rolling_quantile(packets(s, d), K, O, "frame_len", 301, 0.2, "q", dense=True).select("seq_id", "row_idx", r6("q"))


@query("rolling_mean", "SELECT seq_id, row_idx, round(avg(frame_len) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS m FROM packets", "packets")
def _(s, d):
    return Q.rolling_mean(packets(s, d), K, O, "frame_len", 21, "m").select("seq_id", "row_idx", r6("m"))


SIGNAL = """lv AS (SELECT *, ln(1 + frame_len) AS lv FROM packets),
res AS (SELECT *, lv - quantile_cont(lv, 0.2) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 150 PRECEDING AND 150 FOLLOWING) AS res FROM lv),
sm AS (SELECT *, quantile_cont(res, 0.5) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sm FROM res),
med AS (SELECT *, quantile_cont(sm, 0.5) OVER (PARTITION BY seq_id) AS med FROM sm), mad AS (SELECT *, quantile_cont(abs(sm - med), 0.5) OVER (PARTITION BY seq_id) AS mad FROM med),
signal AS (SELECT seq_id, row_idx, frame_len, (sm - med) / (1.4826 * mad + 1e-9) AS z FROM mad)"""


@query("residual_signal", f"WITH {SIGNAL} SELECT seq_id, row_idx, round(z, 6) AS z FROM signal", "packets")
def _(s, d):
    return Q.residual_signal(packets(s, d), K, O, "frame_len", dense=True).select("seq_id", "row_idx", r6("z"))


def runs_sql(source: str, flag: str, tag: str) -> str:
    return f"""{tag}_c AS (SELECT *, CASE WHEN lag({flag}) OVER (PARTITION BY seq_id ORDER BY row_idx) IS NOT DISTINCT FROM {flag} THEN 0 ELSE 1 END AS c FROM {source}),
{tag} AS (SELECT *, sum(c) OVER (PARTITION BY seq_id ORDER BY row_idx) AS run FROM {tag}_c)"""


FILL = """{t}_n AS (SELECT seq_id, run, count(*) AS n, max({f}) AS f FROM {t} GROUP BY 1, 2),
{t}_e AS (SELECT *, f = 0 AND n <= {k} AND lag(run) OVER w IS NOT NULL AND lead(run) OVER w IS NOT NULL AS fill FROM {t}_n WINDOW w AS (PARTITION BY seq_id ORDER BY run)),
{t}_f AS (SELECT r.* EXCLUDE (run, c), CASE WHEN e.fill THEN 1 ELSE r.{f} END AS filled FROM {t} r JOIN {t}_e e USING (seq_id, run))"""


@query("fill_gaps", f"WITH g AS (SELECT seq_id, row_idx, gt::INT AS on_ FROM packets), {runs_sql('g', 'on_', 'a')}, {FILL.format(t='a', f='on_', k=2)} SELECT seq_id, row_idx, filled FROM a_f", "packets")
def _(s, d):
    return Q.fill_short_gaps(packets(s, d), K, O, "gt", 2).select("seq_id", "row_idx", "filled")


@query("drop_short_runs", f"WITH g AS (SELECT seq_id, row_idx, gt::INT AS on_ FROM packets), {runs_sql('g', 'on_', 'a')} SELECT seq_id, row_idx, (on_ = 1 AND count(*) OVER (PARTITION BY seq_id, run) >= 2)::INT AS kept FROM a", "packets")
def _(s, d):
    return Q.keep_runs(packets(s, d), K, O, "gt", least=2).select("seq_id", "row_idx", "kept")


@query("narrow_runs", f"WITH g AS (SELECT seq_id, row_idx, gt::INT AS on_ FROM packets), {runs_sql('g', 'on_', 'a')} SELECT seq_id, row_idx, (on_ = 1 AND count(*) OVER (PARTITION BY seq_id, run) <= 3)::INT AS kept FROM a", "packets")
def _(s, d):
    return Q.keep_runs(packets(s, d), K, O, "gt", most=3).select("seq_id", "row_idx", "kept")


@query("threshold_detector", f"""WITH {SIGNAL}, hit AS (SELECT *, (z >= 0.5)::INT::DOUBLE AS hit FROM signal),
share AS (SELECT seq_id, row_idx, z, avg(hit) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS frac FROM hit),
frac AS (SELECT seq_id, row_idx, greatest(z - 0.5, 0) * frac AS e, (frac >= 0.45)::INT AS on_ FROM share),
{runs_sql('frac', 'on_', 'a')}, {FILL.format(t='a', f='on_', k=2)}, {runs_sql('a_f', 'filled', 'b')}
SELECT seq_id, row_idx, (filled = 1 AND count(*) OVER (PARTITION BY seq_id, run) >= 4)::INT AS visible,
  round(1 / (1 + exp(-(e - avg(e) OVER (PARTITION BY seq_id)) / (stddev_pop(e) OVER (PARTITION BY seq_id) + 1e-9))) + 1e-9, 6) AS score FROM b""", "packets")
def _(s, d):
    return Q.threshold_detector(packets(s, d), K, O, "frame_len", 0.5, active=7, gap=2, least=4, dense=True).select("seq_id", "row_idx", "visible", r6(F.col("score") + 1e-9, "score"))


IFRAME = """ifm AS (SELECT *, ln(1 + frame_len) AS lv FROM packets), ifmed AS (SELECT *, quantile_cont(lv, 0.5) OVER (PARTITION BY seq_id) AS med, quantile_cont(frame_len, 0.995) OVER (PARTITION BY seq_id) AS top FROM ifm),
ifmad AS (SELECT *, quantile_cont(abs(lv - med), 0.5) OVER (PARTITION BY seq_id) AS mad FROM ifmed), ifhit AS (SELECT *, (lv > med + 2 * (mad + 1e-9) OR frame_len > top)::INT AS hit FROM ifmad)"""


@query("iframe_mask", f"WITH {IFRAME} SELECT seq_id, row_idx, hit, max(hit) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mask FROM ifhit", "packets")
def _(s, d):
    return Q.iframe_mask(packets(s, d), K, O, "frame_len", k=2.0).select("seq_id", "row_idx", "hit", "mask")


@query("iframe_head_drop", f"WITH {IFRAME}, o AS (SELECT *, coalesce(max(hit) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS omit FROM ifhit) SELECT seq_id, row_idx, frame_len FROM o WHERE omit = 0", "packets")
def _(s, d):
    return Q.head_omit(Q.iframe_mask(packets(s, d), K, O, "frame_len", k=2.0), K, O, "hit", 2).filter("omit = 0").select("seq_id", "row_idx", "frame_len")


@query("interp_linear", f"""WITH {IFRAME}, g AS (SELECT seq_id, row_idx, frame_len, hit, CASE WHEN hit = 0 THEN row_idx END AS gi, CASE WHEN hit = 0 THEN frame_len END AS gv FROM ifhit),
b AS (SELECT *, last_value(gi IGNORE NULLS) OVER w AS ai, last_value(gv IGNORE NULLS) OVER w AS av, first_value(gi IGNORE NULLS) OVER x AS bi, first_value(gv IGNORE NULLS) OVER x AS bv FROM g
  WINDOW w AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seq_id, row_idx, CAST(round_even(greatest(CASE WHEN hit = 0 THEN frame_len ELSE coalesce(av::DOUBLE + (bv::DOUBLE - av) * (row_idx - ai) / greatest(bi - ai, 1), av, bv) END, 0), 0) AS BIGINT) AS interp FROM b""", "packets")
def _(s, d):
    return Q.interpolate(Q.iframe_mask(packets(s, d), K, O, "frame_len", k=2.0), K, O, "frame_len", "hit").select("seq_id", "row_idx", "interp")


@query("spike_mask", f"""WITH a1 AS (SELECT *, quantile_cont(frame_len, 0.5) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS rm FROM packets),
a2 AS (SELECT *, quantile_cont(abs(frame_len - rm), 0.5) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS rmad FROM a1),
g AS (SELECT seq_id, row_idx, (frame_len > rm + 3 * 1.4826 * rmad)::INT AS hit FROM a2), {runs_sql('g', 'hit', 'a')}
SELECT seq_id, row_idx, (hit = 1 AND count(*) OVER (PARTITION BY seq_id, run) <= 3)::INT AS spike FROM a""", "packets")
def _(s, d):
    return Q.spike_mask(packets(s, d), K, O, "frame_len", k=3.0).select("seq_id", "row_idx", "spike")


@query("resample_rows", """WITH n AS (SELECT seq_id, max(row_idx) AS n FROM packets GROUP BY 1), g AS (SELECT seq_id, k, k * (n - 1) / 39.0::DOUBLE AS pos FROM n, range(40) t(k))
SELECT g.seq_id, CAST(g.k AS BIGINT) AS k, round(a.frame_len + (b.frame_len - a.frame_len) * (g.pos - floor(g.pos)), 6) AS frame_len, c.gt FROM g
JOIN packets a ON a.seq_id = g.seq_id AND a.row_idx - 1 = floor(g.pos) JOIN packets b ON b.seq_id = g.seq_id AND b.row_idx - 1 = ceil(g.pos) JOIN packets c ON c.seq_id = g.seq_id AND c.row_idx - 1 = round_even(g.pos, 0)""", "packets")
def _(s, d):
    p = packets(s, d).select("seq_id", (F.col("row_idx") - 1).alias("i"), "frame_len", "gt")
    return Q.resample(p, K, "i", "frame_len", "gt", 40).select("seq_id", "k", r6("frame_len"), "gt")


@query("fixed_period_markers", """WITH b AS (SELECT *, (t_us - first_value(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx)) // 86400000000 AS bin FROM packets)
SELECT seq_id, row_idx, (lead(bin) OVER (PARTITION BY seq_id ORDER BY row_idx) IS DISTINCT FROM bin)::INT AS boundary FROM b""", "packets")
def _(s, d):
    return Q.fixed_period(packets(s, d), K, O, "t_us", DAY).select("seq_id", "row_idx", "boundary")


@query("interarrival", """WITH w AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx) AS dt_us, marker OR lead(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx) IS NULL AS closing FROM packets)
SELECT seq_id, row_idx, dt_us, frame_len, closing, round(ln(1 + dt_us / 1e6), 6) AS log_dt FROM w WHERE dt_us IS NOT NULL""", "packets")
def _(s, d):
    return Q.interarrival(packets(s, d), K, O, "t_us", "marker").select("seq_id", "row_idx", "dt_us", "frame_len", "closing", r6(F.log1p(F.col("dt_us") / 1e6), "log_dt"))


STARTS = """n AS (SELECT seq_id, max(row_idx) AS n FROM packets GROUP BY 1),
starts AS (SELECT DISTINCT seq_id, n, start FROM (SELECT seq_id, n, unnest(range(0, n, 25)) AS start FROM n UNION ALL SELECT seq_id, n, greatest(0, n - 32) FROM n))"""


@query("sliding_windows", f"WITH {STARTS} SELECT seq_id, n, start, least(start + 32, n) AS stop FROM starts", "packets")
def _(s, d):
    return Q.window_starts(packets(s, d).withColumn("i", F.col("row_idx") - 1), K, "i", 32, 25).select("seq_id", "n", "start", "stop")


@query("overlap_average", f"""WITH {STARTS}, r AS (SELECT p.seq_id, p.row_idx, p.prob * (1 + (s.start % 3)) AS v FROM packets p JOIN starts s ON s.seq_id = p.seq_id AND p.row_idx - 1 >= s.start AND p.row_idx - 1 < s.start + 32)
SELECT seq_id, row_idx, round(sum(v) / count(*) + 1e-9, 6) AS avg_prob, count(*) AS n_windows FROM r GROUP BY 1, 2""", "packets")
def _(s, d):
    p = Q.in_windows(packets(s, d).withColumn("i", F.col("row_idx") - 1), K, "i", 32, 25)
    v = F.col("prob") * (1 + F.col("start") % 3)
    return p.groupBy("seq_id", "row_idx").agg(F.round(F.sum(v) / F.count("*") + 1e-9, 6).alias("avg_prob"), F.count("*").alias("n_windows"))


@query("balance_windows", f"""WITH {STARTS}, l AS (SELECT s.seq_id, s.start, bool_or(p.marker AND p.prob > 0.75) AS label FROM packets p JOIN starts s ON s.seq_id = p.seq_id AND p.row_idx - 1 >= s.start AND p.row_idx - 1 < s.start + 32 GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (ORDER BY seq_id, start) - 1 AS rk, count(*) OVER () AS nz FROM l WHERE NOT label), m AS (SELECT count(*) AS np FROM l WHERE label),
d AS (SELECT CAST(floor(k * (nz - 1)::DOUBLE / greatest(nz - least(nz, np) - 1, 1)) AS BIGINT) AS rk FROM (SELECT max(nz) AS nz FROM z), m, range(100000) t(k) WHERE k < nz - least(nz, np))
SELECT seq_id, start, label FROM l WHERE label UNION ALL SELECT seq_id, start, label FROM z WHERE rk NOT IN (SELECT rk FROM d)""", "packets")
def _(s, d):
    """All-zero windows beyond the number of others go at evenly spaced ranks. The rank is global, over windows only."""
    p = Q.in_windows(packets(s, d).withColumn("i", F.col("row_idx") - 1), K, "i", 32, 25)
    w = p.groupBy("seq_id", "start").agg(F.max(F.col("marker") & (F.col("prob") > 0.75)).alias("label"))
    return Q.drop_surplus(w, "label", ["seq_id", "start"])


@query("ffill_bfill", """WITH g AS (SELECT seq_id, row_idx, CASE WHEN event_id % 13 = 0 OR row_idx <= 2 THEN NULL ELSE prob END AS v FROM packets)
SELECT seq_id, row_idx, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_idx), first_value(v IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM g""", "packets")
def _(s, d):
    g = packets(s, d).withColumn("v", F.when(~((F.col("event_id") % 13 == 0) | (F.col("row_idx") <= 2)), F.col("prob")))
    return Q.fill_both(g, K, O, "v").select("seq_id", "row_idx", "filled")


@query("step_hold_spans", """WITH st AS (SELECT seq_id, quantile_cont(d, 0.5) AS med FROM (SELECT seq_id, t_us - lag(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx) AS d FROM packets) WHERE d IS NOT NULL GROUP BY 1),
nx AS (SELECT *, lead(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx) AS nxt FROM packets)
SELECT i.seq_id, i.start_us, round((coalesce(n.nxt, n.t_us + st.med) - i.start_us) / 1e6, 3) AS held_s FROM islands i JOIN nx n ON n.seq_id = i.seq_id AND n.row_idx = i.end_idx JOIN st ON st.seq_id = i.seq_id""", "packets islands")
def _(s, d):
    w = Q.over(K, O)
    p = packets(s, d).withColumns({"nxt": F.lead("t_us").over(w), "dt": F.col("t_us") - F.lag("t_us").over(w)})
    p = p.withColumn("med", F.percentile("dt", 0.5).over(Window.partitionBy(*K)))
    ends = p.select("seq_id", F.col("row_idx").alias("end_idx"), F.coalesce(F.col("nxt").cast("double"), F.col("t_us") + F.col("med")).alias("stop"))
    return islands(s, d).join(ends, ["seq_id", "end_idx"]).select("seq_id", "start_us", F.round((F.col("stop") - F.col("start_us")) / 1e6, 3).alias("held_s"))


@query("trim_aligned", """WITH c AS (SELECT *, sum(marker::INT) OVER (PARTITION BY seq_id ORDER BY row_idx) AS m, sum(marker::INT) OVER (PARTITION BY seq_id) AS nm, sum(gt::INT) OVER (PARTITION BY seq_id) // 3 AS nt FROM packets)
SELECT seq_id, row_idx FROM c WHERE m - marker::INT < least(nm, nt)""", "packets")
def _(s, d):
    whole, upto = Window.partitionBy(*K), Q.over(K, O).rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("marker").cast("int")
    c = packets(s, d).withColumns({"m": F.sum(m).over(upto) - m, "keep": F.least(F.sum(m).over(whole), F.floor(F.sum(F.col("gt").cast("int")).over(whole) / 3))})
    return c.filter("m < keep").select("seq_id", "row_idx")


@query("zero_pad", "SELECT p.seq_id, p.row_idx, CASE WHEN p.row_idx > 20 THEN p.frame_len ELSE 0 END AS frame_len FROM packets p", "packets")
def _(s, d):
    p = packets(s, d)
    trimmed = p.filter("row_idx > 20").select("seq_id", "row_idx", "frame_len")
    return p.select("seq_id", "row_idx").join(trimmed, ["seq_id", "row_idx"], "left").select("seq_id", "row_idx", F.coalesce("frame_len", F.lit(0)).alias("frame_len"))


@query("robust_zscore", "WITH m AS (SELECT *, quantile_cont(frame_len, 0.5) OVER (PARTITION BY seq_id) AS med FROM packets), a AS (SELECT *, quantile_cont(abs(frame_len - med), 0.5) OVER (PARTITION BY seq_id) AS mad FROM m) SELECT seq_id, row_idx, round((frame_len - med) / (1.4826 * mad + 1e-9), 6) AS z FROM a", "packets")
def _(s, d):
    return Q.robust_zscore(packets(s, d), K, "frame_len").select("seq_id", "row_idx", r6("z"))


@query("mad_outliers", "WITH m AS (SELECT *, quantile_cont(frame_len, 0.5) OVER (PARTITION BY seq_id) AS med FROM packets), a AS (SELECT *, quantile_cont(abs(frame_len - med), 0.5) OVER (PARTITION BY seq_id) AS mad FROM m) SELECT seq_id, row_idx, frame_len FROM a WHERE frame_len > med + 3 * mad", "packets")
def _(s, d):
    return Q.robust_center(packets(s, d), K, "frame_len").filter("frame_len > med + 3 * mad").select("seq_id", "row_idx", "frame_len")


@query("pos_weight", f"WITH {STARTS} SELECT round(greatest(1.0, sum((NOT p.gt)::INT) / sum(p.gt::INT)), 6) AS weight, CAST(sum(p.gt::INT) AS BIGINT) AS n_pos FROM packets p JOIN starts s ON s.seq_id = p.seq_id AND p.row_idx - 1 >= s.start AND p.row_idx - 1 < s.start + 32", "packets")
def _(s, d):
    p = Q.in_windows(packets(s, d).withColumn("i", F.col("row_idx") - 1), K, "i", 32, 25)
    return p.agg(F.round(F.greatest(F.lit(1.0), F.count_if(~F.col("gt")) / F.count_if("gt")), 6).alias("weight"), F.count_if("gt").alias("n_pos"))


@query("bce_loss", "SELECT seq_id, round(avg(CASE WHEN gt THEN 18 * ln(1 + exp(-(prob - 0.5) * 4)) ELSE ln(1 + exp((prob - 0.5) * 4)) END), 6) AS loss FROM packets GROUP BY 1", "packets")
def _(s, d):
    z = (F.col("prob") - 0.5) * 4
    return packets(s, d).groupBy("seq_id").agg(F.round(F.avg(S.bce_with_logits(z, F.col("gt").cast("double"), 18.0)), 6).alias("loss"))


@query("smooth_l1", "SELECT seq_id, round(avg(CASE WHEN abs(prob * 3 - 1) < 1 THEN 0.5 * (prob * 3 - 1) * (prob * 3 - 1) ELSE abs(prob * 3 - 1) - 0.5 END), 6) AS loss FROM packets GROUP BY 1", "packets")
def _(s, d):
    return packets(s, d).groupBy("seq_id").agg(F.round(F.avg(S.smooth_l1(F.col("prob") * 3, F.lit(1.0))), 6).alias("loss"))


@query("json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
