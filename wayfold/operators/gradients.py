"""Reverse-mode gradients for the sequence labellers: arrays with a backward step, a handful of operations, AdamW.

Small on purpose: training sees a bounded sample, and inference in tasks runs the same forward functions on plain arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class Node:
    """An array; ``parents`` are (node, function from this gradient to the parent's)."""

    def __init__(self, data, parents=()):
        self.data, self.parents, self.grad = np.asarray(data, np.float64), parents, None

    def __add__(self, other):
        return add(self, other)

    def __mul__(self, other):
        return mul(self, other)

    def __matmul__(self, other):
        return matmul(self, other)


def node(x) -> Node:
    return x if isinstance(x, Node) else Node(x)


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """Sum over axes that broadcasting stretched."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    long = tuple(k for k, n in enumerate(shape) if n == 1 and grad.shape[k] != 1)
    return grad.sum(axis=long, keepdims=True) if long else grad


def add(a, b) -> Node:
    a, b = node(a), node(b)
    return Node(a.data + b.data, ((a, lambda g: _fit(g, a.data.shape)), (b, lambda g: _fit(g, b.data.shape))))


def mul(a, b) -> Node:
    a, b = node(a), node(b)
    return Node(a.data * b.data, ((a, lambda g: _fit(g * b.data, a.data.shape)), (b, lambda g: _fit(g * a.data, b.data.shape))))


def matmul(a, b) -> Node:
    a, b = node(a), node(b)
    turned = lambda x: np.swapaxes(x, -1, -2)
    return Node(a.data @ b.data, ((a, lambda g: _fit(g @ turned(b.data), a.data.shape)), (b, lambda g: _fit(turned(a.data) @ g, b.data.shape))))


def pointwise(a, value: np.ndarray, slope: np.ndarray) -> Node:
    return Node(value, ((a, lambda g: g * slope),))


def relu(a: Node) -> Node:
    return pointwise(a, np.maximum(a.data, 0), (a.data > 0).astype(float))


def sigmoid(a: Node) -> Node:
    s = 1 / (1 + np.exp(-np.clip(a.data, -60, 60)))
    return pointwise(a, s, s * (1 - s))


def softplus(a: Node) -> Node:
    return pointwise(a, np.logaddexp(0, a.data), 1 / (1 + np.exp(-np.clip(a.data, -60, 60))))


def huber(a: Node, beta: float = 1.0) -> Node:
    near = np.abs(a.data) < beta
    return pointwise(a, np.where(near, 0.5 * a.data**2 / beta, np.abs(a.data) - 0.5 * beta), np.where(near, a.data / beta, np.sign(a.data)))


def softmax(a: Node) -> Node:
    e = np.exp(a.data - a.data.max(axis=-1, keepdims=True))
    s = e / e.sum(axis=-1, keepdims=True)
    return Node(s, ((a, lambda g: s * (g - (g * s).sum(axis=-1, keepdims=True))),))


def normalised(a: Node, eps: float = 1e-5) -> Node:
    """Zero mean and unit variance along the last axis."""
    d = a.data - a.data.mean(axis=-1, keepdims=True)
    inv = 1 / np.sqrt((d * d).mean(axis=-1, keepdims=True) + eps)
    y = d * inv
    return Node(y, ((a, lambda g: inv * (g - g.mean(axis=-1, keepdims=True) - y * (g * y).mean(axis=-1, keepdims=True))),))


def turned(a: Node) -> Node:
    return Node(np.swapaxes(a.data, -1, -2), ((a, lambda g: np.swapaxes(g, -1, -2)),))


def column(a: Node, k: int) -> Node:
    def back(g):
        out = np.zeros_like(a.data)
        out[..., k] = g
        return out

    return Node(a.data[..., k], ((a, back),))


def total(a: Node, axis=None) -> Node:
    def back(g):
        return np.broadcast_to(g if axis is None else np.expand_dims(g, axis), a.data.shape)

    return Node(a.data.sum(axis=axis), ((a, back),))


def backward(loss: Node) -> None:
    """Gradients of a scalar in all nodes before it."""
    order, seen, stack = [], set(), [(loss, False)]
    while stack:
        n, done = stack.pop()
        if done:
            order.append(n)
        elif id(n) not in seen:
            seen.add(id(n))
            stack.append((n, True))
            stack += [(p, False) for p, _ in n.parents]
    loss.grad = np.ones_like(loss.data)
    for n in reversed(order):
        for p, step in n.parents:
            g = step(n.grad)
            p.grad = g if p.grad is None else p.grad + g


Params = dict[str, np.ndarray]


def bce(logit: Node, target: np.ndarray, mask: np.ndarray, pos_weight: float = 1.0) -> Node:
    """Mean over the mask of the cross-entropy with logits, positives weighted."""
    n = max(mask.sum(), 1)
    return total(softplus(logit * -1.0) * (pos_weight * target * mask / n) + softplus(logit) * ((1 - target) * mask / n))


def smooth_l1(got: Node, target: np.ndarray, mask: np.ndarray) -> Node:
    return total(huber(got + -target) * (mask / max(mask.sum(), 1)))


def count_loss(logit: Node, target: np.ndarray, mask: np.ndarray) -> Node:
    """Smooth L1 between expected and true number of positives of each window, averaged."""
    expected = total(sigmoid(logit) * mask, axis=1)
    return total(huber(expected + -(target * mask).sum(axis=1))) * (1 / len(target))


def sparsity(logit: Node, mask: np.ndarray, weight: float = 0.1) -> Node:
    """Mean probability over the mask, weighted."""
    return total(sigmoid(logit) * mask) * (weight / max(mask.sum(), 1))


def gradients(params: Params, loss: Callable[[dict[str, Node]], Node]) -> tuple[float, Params]:
    nodes = {k: Node(v) for k, v in params.items()}
    out = loss(nodes)
    backward(out)
    return float(out.data), {k: np.zeros_like(n.data) if n.grad is None else n.grad for k, n in nodes.items()}


def fit(params: Params, epoch: Callable[[int], Iterable[Callable]], score: Callable[[Params], float], epochs: int, patience: int, rate: float = 3e-3, decay: float = 1e-4, clip: float = 1.0) -> Params:
    """AdamW with clipped gradients; ``epoch`` gives the losses of one pass. Ends after ``patience`` passes without a lower
    ``score``, and returns the parameters of the lowest."""
    params = {k: v.copy() for k, v in params.items()}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    best, kept, waited, step = np.inf, params, 0, 0
    for e in range(epochs):
        for loss in epoch(e):
            step += 1
            _, grads = gradients(params, loss)
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            scale = min(1.0, clip / (norm + 1e-12))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                params[k] = params[k] * (1 - rate * decay) - rate * m / (np.sqrt(v) + 1e-8)
        now = score(params)
        if now < best - 1e-6:
            best, kept, waited = now, {k: v.copy() for k, v in params.items()}, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept


def dense(rng: np.random.Generator, name: str, inputs: int, outputs: int) -> Params:
    bound = inputs**-0.5
    return {f"{name}.w": rng.uniform(-bound, bound, (inputs, outputs)), f"{name}.b": rng.uniform(-bound, bound, outputs)}


def apply_dense(p: dict[str, Node], name: str, x) -> Node:
    return node(x) @ p[f"{name}.w"] + p[f"{name}.b"]
