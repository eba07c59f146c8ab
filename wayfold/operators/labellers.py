"""Learned sequence labellers: a recurrent one (visibility and speed of a stream) and one with attention (boundaries).

Both are fitted on a bounded sample of windows (``sample``, drawn by hash over all windows of the training sequences) on
the driver; class balance and normalisation come from sums over all training rows. Both label every row on the cluster:
the recurrent one streams sorted rows of a partition and carries its state from batch to batch, so memory does not grow
with a sequence; the attention one takes windows as groups and averages where they overlap.

Cases: null features count as 0 after normalisation; sequences with a null key form one sequence; a sequence of one row is
labelled; an empty table gives no rows; without a training window the labellers give probability 0.5 and the mean speed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gradients as G
from .gradients import Node, Params
from .sequences import in_windows

Names = Sequence[str]


def held_out(key: Column, share: int = 10) -> Column:
    """Every ``share``-th sequence, by hash; never seen in training."""
    return F.pmod(F.xxhash64(key, F.lit(42)), F.lit(share)) == 0


def moments(df: DataFrame, columns: Names) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column over all rows (variance at least 1e-12)."""
    r = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(columns)]).first()
    read = lambda p: np.array([r[f"{p}{k}"] or 0.0 for k in range(len(columns))])
    return read("m"), np.sqrt(np.maximum(read("v"), 1e-12))


def sampled_windows(df: DataFrame, keys: Names, index: str, columns: Names, size: int, stride: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(values [windows, size, columns], mask) of the ``sample`` windows that come first by hash; rows padded with 0."""
    w = in_windows(df, keys, index, size, stride)
    chosen = w.select(*keys, "start").distinct().orderBy(F.xxhash64(*keys, "start", F.lit(7)), *keys, "start").limit(sample)
    got = w.join(F.broadcast(chosen), [*keys, "start"], "left_semi").select(*keys, "start", index, *[F.col(c).cast("double").alias(c) for c in columns]).toPandas()
    if not len(got):
        return np.zeros((0, size, len(columns))), np.zeros((0, size))
    got = got.sort_values([*keys, "start", index])
    number = got.groupby([*keys, "start"], sort=False, dropna=False).ngroup().to_numpy()
    at = (got[index] - got["start"]).to_numpy(int)
    out, mask = np.zeros((number.max() + 1, size, len(columns))), np.zeros((number.max() + 1, size))
    out[number, at] = np.nan_to_num(got[list(columns)].to_numpy(float))
    mask[number, at] = 1
    return out, mask


def _parts(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Nine tenths of the windows to fit, one to decide when to stop."""
    order = np.random.default_rng(seed).permutation(n)
    return order[max(1, n // 10) :], order[: max(1, n // 10)]


def _batches(rows: np.ndarray, size: int, seed: int):
    mixed = np.random.default_rng(seed).permutation(rows)
    return [mixed[k : k + size] for k in range(0, len(mixed), size)]


# --- recurrent ----------------------------------------------------------------------------------------------------------


def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
    i, f, g, o = np.split(z, 4, axis=-1)
    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    return s(i), s(f), np.tanh(g), s(o)


def cells(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, h: np.ndarray, c: np.ndarray, lengths: np.ndarray | None = None):
    """A layer of long short-term memory over x [n, T, inputs] from states h and c, which it moves on in place. With
    ``lengths`` (not increasing) a row stops at its own. Returns hidden states and what the backward step needs."""
    n, t_max, _ = x.shape
    size = u.shape[0]
    z = x @ w + b
    hs, steps = np.zeros((n, t_max, size)), []
    for t in range(t_max):
        k = n if lengths is None else int(np.searchsorted(-lengths, -t, side="left"))
        i, f, g, o = _gates(z[:k, t] + h[:k] @ u)
        before = c[:k].copy()
        c[:k] = f * before + i * g
        tc = np.tanh(c[:k])
        if lengths is None:
            steps.append((i, f, g, o, before, tc, h.copy()))
        h[:k] = o * tc
        hs[:k, t] = h[:k]
    return hs, steps


def recurrent_layer(x: Node, w: Node, u: Node, b: Node) -> Node:
    n, t_max, _ = x.data.shape
    size = u.data.shape[0]
    hs, steps = cells(x.data, w.data, u.data, b.data, np.zeros((n, size)), np.zeros((n, size)))
    kept: dict[int, tuple] = {}

    def back(g):
        """Through time, once for all parents."""
        if id(g) not in kept:
            dz, du = np.zeros((n, t_max, 4 * size)), np.zeros_like(u.data)
            dh, dc = np.zeros((n, size)), np.zeros((n, size))
            for t in range(t_max - 1, -1, -1):
                i, f, a, o, before, tc, h = steps[t]
                dh = dh + g[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[:, t] = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - a * a), dh * tc * o * (1 - o)], axis=1)
                du += h.T @ dz[:, t]
                dh, dc = dz[:, t] @ u.data.T, dc * f
            kept.clear()
            kept[id(g)] = (dz @ w.data.T, x.data.reshape(n * t_max, -1).T @ dz.reshape(n * t_max, -1), du, dz.sum(axis=(0, 1)))
        return kept[id(g)]

    return Node(hs, ((x, lambda g: back(g)[0]), (w, lambda g: back(g)[1]), (u, lambda g: back(g)[2]), (b, lambda g: back(g)[3])))


class Recurrent:
    """Layers of memory cells with a visibility head and a speed head; inputs normalised, speed in its own units."""

    def __init__(self, params: Params, layers: int, mean, scale, speed: tuple[float, float]):
        self.params, self.layers, self.mean, self.scale, self.speed = params, layers, mean, scale, speed

    @property
    def hidden(self) -> int:
        return self.params["l0.u"].shape[0]

    def states(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.zeros((n, self.hidden)), np.zeros((n, self.hidden))) for _ in range(self.layers)]

    def label(self, x: np.ndarray, lengths: np.ndarray, states) -> tuple[np.ndarray, np.ndarray]:
        """(probability, speed) of x [n, T, inputs], rows by length, longest first; ``states`` move on to each row's end."""
        h = np.nan_to_num((x - self.mean) / self.scale)
        p = self.params
        for k, (hk, ck) in enumerate(states):
            h, _ = cells(h, p[f"l{k}.w"], p[f"l{k}.u"], p[f"l{k}.b"], hk, ck, lengths)
        logit, speed = heads({k: Node(v) for k, v in p.items()}, Node(h))
        return 1 / (1 + np.exp(-np.clip(logit.data, -60, 60))), speed.data * self.speed[1] + self.speed[0]


def heads(p: dict[str, Node], h: Node) -> tuple[Node, Node]:
    out = [G.column(G.apply_dense(p, f"{n}2", G.relu(G.apply_dense(p, f"{n}1", h))), 0) for n in ("see", "go")]
    return out[0], out[1]


def recurrent_params(rng: np.random.Generator, inputs: int, hidden: int, layers: int) -> Params:
    out: Params = {}
    bound = hidden**-0.5
    for k in range(layers):
        n = inputs if k == 0 else hidden
        out |= {f"l{k}.w": rng.uniform(-bound, bound, (n, 4 * hidden)), f"l{k}.u": rng.uniform(-bound, bound, (hidden, 4 * hidden)), f"l{k}.b": rng.uniform(-bound, bound, 4 * hidden)}
    for n in ("see", "go"):
        out |= G.dense(rng, f"{n}1", hidden, max(hidden // 2, 1)) | G.dense(rng, f"{n}2", max(hidden // 2, 1), 1)
    return out


def recurrent_loss(p: dict[str, Node], x, seen, speed, mask, pos_weight: float, layers: int) -> Node:
    h = Node(x)
    for k in range(layers):
        h = recurrent_layer(h, p[f"l{k}.w"], p[f"l{k}.u"], p[f"l{k}.b"])
    logit, go = heads(p, h)
    return G.bce(logit, seen, mask, pos_weight) + G.smooth_l1(go, speed, mask)


def fit_recurrent(df: DataFrame, keys: Names, index: str, features: Names, visible: str, speed: str, size: int = 96, stride: int = 48, sample: int = 1200, hidden: int = 64, layers: int = 2, epochs: int = 12, patience: int = 4, seed: int = 42) -> Recurrent:
    """Fit on ``sample`` windows of ``df`` (index counts each sequence's rows from 0). Stops on the speed error of a tenth of
    the windows."""
    mean, scale = moments(df, features)
    level, spread = moments(df, [speed])
    n = df.agg(F.count_if(F.col(visible)).alias("p"), F.count_if(~F.col(visible)).alias("n")).first()
    pos_weight = max(1.0, n["n"] / max(n["p"], 1))
    data, mask = sampled_windows(df, keys, index, [*features, visible, speed], size, stride, sample)
    params = recurrent_params(np.random.default_rng(seed), len(features), hidden, layers)
    model = Recurrent(params, layers, mean, scale, (float(level[0]), float(spread[0])))
    if not len(data):
        flat = {k: np.zeros_like(v) for k, v in params.items()}
        return Recurrent(flat, layers, mean, scale, model.speed)
    x = np.nan_to_num((data[..., : len(features)] - mean) / scale) * mask[..., None]
    seen, go = data[..., -2], (data[..., -1] - level[0]) / spread[0]
    train, check = _parts(len(data), seed)

    def losses(e):
        return [lambda p, r=r: recurrent_loss(p, x[r], seen[r], go[r], mask[r], pos_weight, layers) for r in _batches(train, 32, seed + e)]

    def error(p):
        h = x[check]
        for k in range(layers):
            h, _ = cells(h, p[f"l{k}.w"], p[f"l{k}.u"], p[f"l{k}.b"], np.zeros((len(h), hidden)), np.zeros((len(h), hidden)), np.full(len(h), h.shape[1]))
        got = heads({k: Node(v) for k, v in p.items()}, Node(h))[1].data
        return float(np.sqrt((((got - go[check]) ** 2) * mask[check]).sum() / max(mask[check].sum(), 1)))

    model.params = G.fit(params, losses, error, epochs, patience)
    return model


def _recurrent_rows(model: Recurrent, n_keys: int, features: Names):
    """Rows sorted by sequence and order, labelled batch by batch; the last sequence's state goes on to the next batch."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for k in range(n_keys):
                code = batch.column(k).dictionary_encode()
                code = code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            lengths = np.diff(np.append(first, n))
            order = np.argsort(-lengths, kind="stable")
            x = np.zeros((len(first), int(lengths.max()), len(features)))
            row, step = np.repeat(np.argsort(order), lengths), np.arange(n) - np.repeat(first, lengths)
            for k, c in enumerate(features):
                x[row, step, k] = batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            names = [tuple(batch.column(k)[int(a)].as_py() for k in range(n_keys)) for a in (0, first[-1])]
            states = model.states(len(first))
            if last == names[0] and held is not None:
                at = int(np.flatnonzero(order == 0)[0])
                for (h, c), (h0, c0) in zip(states, held):
                    h[at], c[at] = h0, c0
            probability, speed = model.label(x, lengths[order], states)
            at = int(np.flatnonzero(order == len(first) - 1)[0])
            last, held = names[1], [(h[at].copy(), c[at].copy()) for h, c in states]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability[row, step]), pa.array(speed[row, step])], names=[*batch.schema.names, "visible_prob", "speed_pred"])

    return run


def label_recurrent(df: DataFrame, model: Recurrent, keys: Names, order: Names, features: Names) -> DataFrame:
    """Every row with ``visible_prob`` and ``speed_pred``: one shuffle by sequence, rows streamed in order."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("visible_prob", T.DoubleType()), T.StructField("speed_pred", T.DoubleType())])
    return rows.mapInArrow(_recurrent_rows(model, len(keys), features), schema).select(*df.columns, "visible_prob", "speed_pred")


# --- attention ----------------------------------------------------------------------------------------------------------


def places(n: int, width: int) -> np.ndarray:
    """Sines and cosines of positions, wavelengths in geometric progression."""
    at = np.arange(n)[:, None] / 10000.0 ** (np.arange(0, width, 2) / width)
    out = np.zeros((n, width))
    out[:, 0::2], out[:, 1::2] = np.sin(at), np.cos(at[:, : width // 2])
    return out


def boundary_inputs(time: np.ndarray, size: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Time, size, time since the row before (at least 1e-9), its logarithm, and position as a share of the window."""
    time, size = time * mask, size * mask
    gap = np.maximum(np.diff(time, axis=1, prepend=time[:, :1]) * mask, 1e-9)
    share = np.broadcast_to(np.arange(time.shape[1]) / max(time.shape[1] - 1, 1), time.shape)
    return np.stack([time, size, gap, np.log(gap), share], axis=-1)


def attention_params(rng: np.random.Generator, width: int = 16, layers: int = 4, inner: int = 16) -> Params:
    out = G.dense(rng, "in", 5, width) | G.dense(rng, "out1", width, width // 2) | G.dense(rng, "out2", width // 2, 1)
    for k in range(layers):
        for n in ("q", "k", "v", "o"):
            out |= G.dense(rng, f"a{k}.{n}", width, width)
        out |= G.dense(rng, f"f{k}.1", width, inner) | G.dense(rng, f"f{k}.2", inner, width)
        for n in ("a", "f"):
            out |= {f"n{k}.{n}.w": np.ones(width), f"n{k}.{n}.b": np.zeros(width)}
    return out


def attend(p: dict[str, Node], x: np.ndarray, mask: np.ndarray) -> Node:
    """Logits [n, T] of windows x [n, T, 5]: norm first, one head, padding never attended to."""
    width = p["in.w"].data.shape[1]
    h = G.relu(G.apply_dense(p, "in", x)) + places(x.shape[1], width)
    hidden = np.where(mask[:, None, :] > 0, 0.0, -1e9)
    layer = 0
    while f"a{layer}.q.w" in p:
        z = G.normalised(h) * p[f"n{layer}.a.w"] + p[f"n{layer}.a.b"]
        q, k, v = (G.apply_dense(p, f"a{layer}.{n}", z) for n in ("q", "k", "v"))
        weight = G.softmax((q @ G.turned(k)) * width**-0.5 + hidden)
        h = h + G.apply_dense(p, f"a{layer}.o", weight @ v)
        z = G.normalised(h) * p[f"n{layer}.f.w"] + p[f"n{layer}.f.b"]
        h = h + G.apply_dense(p, f"f{layer}.2", G.relu(G.apply_dense(p, f"f{layer}.1", z)))
        layer += 1
    return G.column(G.apply_dense(p, "out2", G.relu(G.apply_dense(p, "out1", h))), 0)


def boundary_loss(logit: Node, target: np.ndarray, mask: np.ndarray, pos_weight: float = 18.0, count: float = 1.0, spare: float = 0.1) -> Node:
    """Cross-entropy, expected count against true count, and sparsity."""
    return G.bce(logit, target, mask, pos_weight) + G.count_loss(logit, target, mask) * count + G.sparsity(logit, mask, spare)


class Attention:
    def __init__(self, params: Params, mean, scale):
        self.params, self.mean, self.scale = params, mean, scale

    def inputs(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((data - self.mean) / self.scale)
        return boundary_inputs(z[..., 0], z[..., 1], mask)

    def label(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        logit = attend({k: Node(v) for k, v in self.params.items()}, self.inputs(data, mask), mask).data
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit_attention(df: DataFrame, keys: Names, index: str, time: str, size: str, target: str, window: int = 250, stride: int = 25, sample: int = 600, epochs: int = 12, patience: int = 4, seed: int = 42, pos_weight: float = 18.0, rate: float = 3e-3) -> Attention:
    """Fit on ``sample`` windows of ``df``; stops on the loss of a tenth of the windows."""
    mean, scale = moments(df, [time, size])
    data, mask = sampled_windows(df, keys, index, [time, size, target], window, stride, sample)
    params = attention_params(np.random.default_rng(seed))
    if not len(data):
        return Attention({k: v * (not k.startswith("out2")) for k, v in params.items()}, mean, scale)
    longest = int(mask.sum(axis=1).max())
    data, mask = data[:, :longest], mask[:, :longest]
    x, y = Attention(params, mean, scale).inputs(data[..., :2], mask), data[..., 2]
    train, check = _parts(len(data), seed)
    loss = lambda p, r: boundary_loss(attend(p, x[r], mask[r]), y[r], mask[r], pos_weight)
    score = lambda p: float(loss({k: Node(v) for k, v in p.items()}, check).data)
    return Attention(G.fit(params, lambda e: [lambda p, r=r: loss(p, r) for r in _batches(train, 16, seed + e)], score, epochs, patience, rate), mean, scale)


def label_attention(df: DataFrame, model: Attention, keys: Names, index: str, time: str, size: str, window: int = 250, stride: int = 25) -> DataFrame:
    """(keys, index, boundary_prob, n_windows): each window labelled on its own, a row's probabilities averaged."""
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, df.schema[index], T.StructField("p", T.DoubleType())])

    def one(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(index)
        data = x[[time, size]].to_numpy(float)[None]
        return x[[*[f.name for f in key_fields], index]].assign(p=model.label(data, np.ones(data.shape[:2]))[0])

    w = in_windows(df, keys, index, window, stride).select(*keys, "start", index, F.col(time).cast("double").alias(time), F.col(size).cast("double").alias(size))
    return w.groupBy(*keys, "start").applyInPandas(one, schema).groupBy(*keys, index).agg(F.avg("p").alias("boundary_prob"), F.count("*").alias("n_windows"))
