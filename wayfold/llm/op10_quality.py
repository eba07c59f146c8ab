"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Texts become ``WIDTH`` surface statistics (numpy over UTF-8 bytes). A small tanh network is fitted on trusted positives
(label 1 in training folds) against unlabelled texts of the same folds: minimise
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic losses. The prior comes from the data too: a first
network separates positives from unlabelled texts, and the least ratio of their upper tails bounds the share of
positives among the unlabelled. The fit sees a bounded hash sample (``SAMPLE`` positives and as many unlabelled texts,
parameters, drawn by row); scoring sees every whole text, row by row, without a shuffle.

Cases: null and empty texts score as the zero vector does; repeated rows score alike; without any positive label
everything scores 0.5; an empty table gives no rows; label rows with null or repeated ids count once or not at all;
other columns pass through or are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, SPACE, blocks, fold, free_name, owner, prefix_hash, runs, span_hash

SAMPLE, HIDDEN, STEPS, THRESHOLD = 8000, 24, 900, 0.3
#: Bytes of text looked at together: numpy needs some fifty times as much.
BLOCK = 1 << 19

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True  # upper case
_CLASS[1, 97:123] = True  # lower case
_CLASS[2, 48:58] = True  # digits
_CLASS[3, 128:] = True  # beyond ASCII
for _k, _marks in ((4, b"#$%&*@^~`"), (5, b"|<>{}[]\\/=_+"), (6, b"!?"), (7, b"\n\r")):
    _CLASS[_k, list(_marks)] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
WIDTH = 22


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    starts, ends = runs(~SPACE[data], offsets)
    whose = owner(starts, offsets)
    words = np.bincount(whose, minlength=n)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    total = np.zeros(len(data) + 1, np.int64)
    for k in range(8):
        np.cumsum(_CLASS[k][data], out=total[1:])
        out[:, 2 + k] = np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) * per_byte)
    length = ends - starts
    h = span_hash(prefix_hash(LOWER[data]), starts, ends)
    share = lambda mask: np.bincount(whose, mask, n) * per_word
    out[:, 10] = np.log1p(np.bincount(whose, length, n) * per_word)
    out[:, 11] = share(length <= 3)
    out[:, 12] = share(length >= 14)
    out[:, 13] = share(_CLASS[0][data[starts]])
    out[:, 14] = share(_STOP[data[ends - 1]])
    out[:, 15] = share(_CLASS[4][data[ends - 1]] | _CLASS[6][data[ends - 1]])
    for k, lag in ((16, 1), (17, 2)):
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (whose[lag:] == whose[:-lag])
        out[:, k] = share(same)
    order = np.lexsort((h, whose))
    a, b = h[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = np.bincount(b[new], minlength=n)
    out[:, 18] = distinct * per_word
    out[:, 19] = np.log1p(distinct)
    pair = h.copy()
    pair[1:] ^= h[:-1] * np.uint64(0x9FB21C651E98DF25)
    order = np.lexsort((pair, whose))
    a, b = pair[order], whose[order]
    new[:] = True
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out[:, 20] = np.bincount(b[new], minlength=n) * per_word
    single = (length <= 1) & (_CLASS[5][data[starts]] | _CLASS[4][data[starts]])
    out[:, 21] = share(single)
    return out


class Network:
    """Standardised inputs, one tanh layer, one logit; plain numpy."""

    def __init__(self, mean, scale, layers):
        self.mean, self.scale, self.layers = mean, scale, layers

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)), -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Adam on the non-negative risk; with ``prior`` None the plain contrast of positives and unlabelled texts."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    layers = [rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        a, b = p[rng.integers(0, len(p), 1024)], u[rng.integers(0, len(u), 1024)]
        w, bias, v, c = layers
        hidden = np.tanh(np.concatenate([a, b]) @ w + bias)
        z = hidden @ v + c
        s = _sigmoid(z)
        sp, su = s[:1024], s[1024:]
        g = np.zeros(2048)
        if prior is None:
            g[:1024], g[1024:] = (sp - 1) / 1024, su / 1024
        else:
            negative = -np.log1p(-np.clip(su, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-9)).mean()
            if negative >= 0:  # descend the whole risk
                g[:1024], g[1024:] = prior * (sp - 1) / 1024 - prior * sp / 1024, su / 1024
            else:  # the negative part went below zero: step back from it
                g[:1024], g[1024:] = prior * sp / 1024, -su / 1024
        dh = np.outer(g, v) * (1 - hidden**2)
        grads = [np.concatenate([a, b]).T @ dh + 1e-4 * w, dh.sum(axis=0), hidden.T @ g + 1e-4 * v, np.array([g.sum()])]
        rate = 0.01 * min(1, 4 * (1 - step / (STEPS + 1)))
        for x, d, m, r in zip(layers, grads, first, second):
            m *= 0.9
            m += 0.1 * d
            r *= 0.999
            r += 0.001 * d * d
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, layers)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: least ratio of upper tails of a held-out contrast score."""
    contrast = fit(positive[::2], unlabelled[::2], None, seed=11)
    p, u = np.sort(contrast.logit(positive[1::2])), np.sort(contrast.logit(unlabelled[1::2]))
    t = p[: max(1, int(len(p) * 0.8))]  # tails of a fifth of the positives at least
    tail_p, tail_u = np.maximum(1 - np.searchsorted(p, t) / len(p), 1e-9), np.maximum(1 - np.searchsorted(u, t) / len(u), 1e-9)
    at = int(np.argmin(tail_u / tail_p))
    ratio = tail_u[at] / tail_p[at]
    error = ratio * np.sqrt((1 - tail_u[at]) / (len(u) * tail_u[at]) + (1 - tail_p[at]) / (len(p) * tail_p[at]))
    # an estimate above the truth turns whole groups of bad texts into positives; one below only lowers all scores a
    # little: two standard errors below the ratio
    return float(np.clip(ratio - 2 * error, 0.05, 0.98))


def _feature_rows(batches):
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", BLOCK):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["labelled", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network | None:
    """Fit on hash samples of about ``sample`` rows each, drawn from all rows of the training folds (crc32 mod 5 not 0)."""
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("bigint").alias("l")).filter("l is not null").filter(fold(F.col("l"), 5) != 0).distinct()
    counts = trusted.agg(F.count("*").alias("n")).crossJoin(docs.agg(F.count("*").alias("m"))).first()
    if not counts.n or not counts.m:
        return None
    grade = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    some = trusted.filter(grade(F.col("l"), 1) < sample / counts.n)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("text")).filter(fold(F.col("i"), 5) != 0)
    # about `sample` ids by the line above, however large the corpus
    marked = rows.join(F.broadcast(some), F.col("i") == F.col("l"), "left")
    # by row, not by id: however many rows share one
    drawn = grade(F.xxhash64("i", "text"), 2) < sample / counts.m
    both = marked.select(F.array(F.col("l").isNotNull(), drawn).alias("kind"), "text").filter("kind[0] or kind[1]")
    split = both.select(F.explode(F.when(F.col("kind")[0] & F.col("kind")[1], F.array(F.lit(1), F.lit(0))).when(F.col("kind")[0], F.array(F.lit(1))).otherwise(F.array(F.lit(0)))).alias("labelled"), "text")
    # the shares above give about `sample` rows of each kind; the limit holds where one row or label repeats without end.
    # Texts become numbers where they are read, so that no task gets the texts of all
    got = split.mapInArrow(_feature_rows, "labelled int, x array<float>").limit(6 * sample).toPandas()
    if not len(got):
        return None
    x, is_p = np.stack(got["x"].to_numpy()).astype(np.float64), got["labelled"].to_numpy() == 1
    order = np.lexsort((*x.T, is_p))
    x, is_p = x[order], is_p[order]
    if is_p.sum() < 8 or (~is_p).sum() < 8:
        return None
    mixed = np.random.default_rng(3)
    p, u = mixed.permutation(x[is_p]), mixed.permutation(x[~is_p])
    return fit(p, u, estimate_prior(p, u))


def with_score(docs: DataFrame, network: Network | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and, last, a double ``score_col`` or the next free name (0 to 1)."""
    score_col = free_name(docs, score_col)

    def rows(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col, BLOCK):
                x = features(data, offsets)
                score = network.score(x) if network is not None else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, score_col])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op10_quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    network = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(rows, network)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
