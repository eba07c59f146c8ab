"""Learned labellers over the packets of all users: fitted on sequences that are not held out, applied to every row.

The truth is what the stream itself fixes: the hysteresis state of the score for visibility (which needs memory), and the
first packet after a pause for boundaries. No SQL says a fitted model's rows; tests hold the
operators against finite differences, unbroken runs and held-out scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labellers as L
from ..operators import sequences as Q
from .base import packets, query

K, O = ["seq_id"], ["row_idx"]
FEATURES = ["log_size", "residual", "ratio", "span"]
#: Pause after which a new group of packets begins.
PAUSE_US = 86_400_000_000


def features(s, d) -> DataFrame:
    """Frame features, hysteresis state and speed (0 where nothing is seen), rows counted from 0."""
    p = Q.hysteresis(packets(s, d), K, O, "prob", 0.6, 0.3)
    p = p.withColumn("span", F.coalesce((F.col("t_us") - F.lag("t_us").over(Q.over(K, O))) / 1e6, F.lit(0.0)))
    e = Q.ewm(p.select("seq_id", "row_idx", "frame_len", "span", "active", "prob"), K, O, "frame_len", 2 / 33)
    size = F.col("frame_len").cast("double")
    return e.select(
        "seq_id", (F.col("row_idx") - 1).alias("i"), F.log1p(size).alias("log_size"), (size - F.col("ewm")).alias("residual"), (size / (F.col("ewm") + 1e-9)).alias("ratio"), "span",
        (F.col("active") == 1).alias("seen"), F.when(F.col("active") == 1, F.col("prob") * 10).otherwise(0.0).alias("speed"), L.held_out(F.col("seq_id")).alias("held_out"),
    )


@query("recurrent_labels")
def _(s, d):
    rows = features(s, d)
    model = L.fit_recurrent(rows.filter(~F.col("held_out")), K, "i", FEATURES, "seen", "speed", epochs=8)
    out = L.label_recurrent(rows, model, K, ["i"], FEATURES)
    return out.select("seq_id", (F.col("i") + 1).alias("row_idx"), "held_out", "seen", "speed", "visible_prob", "speed_pred")


def boundaries(s, d) -> DataFrame:
    p = packets(s, d)
    pause = F.col("t_us") - F.lag("t_us").over(Q.over(K, O)) > PAUSE_US
    return p.select("seq_id", (F.col("row_idx") - 1).alias("i"), "t_s", F.col("frame_len").cast("double").alias("size"), F.coalesce(pause, F.lit(True)).alias("opening"), L.held_out(F.col("seq_id")).alias("held_out"))


@query("attention_labels")
def _(s, d):
    rows = boundaries(s, d)
    model = L.fit_attention(rows.filter(~F.col("held_out")), K, "i", "t_s", "size", "opening", epochs=8)
    got = L.label_attention(rows, model, K, "i", "t_s", "size")
    return got.join(rows.select("seq_id", "i", "opening", "held_out"), ["seq_id", "i"]).select("seq_id", (F.col("i") + 1).alias("row_idx"), "held_out", "opening", "boundary_prob", "n_windows")
