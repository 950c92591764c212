"""A small reverse-mode differentiation over NumPy arrays, with the layers that graph networks need, and Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array that remembers how it was made."""

    def __init__(self, value: np.ndarray, parents: tuple[tuple[Var, Callable], ...] = ()):
        self.value, self.parents, self.grad = np.asarray(value, float), parents, None

    def __matmul__(self, o: Var) -> Var:
        return Var(self.value @ o.value, ((self, lambda g: g @ o.value.T), (o, lambda g: self.value.T @ g)))

    def __add__(self, o: Var) -> Var:
        return Var(self.value + o.value, ((self, lambda g: _fit(g, self.value)), (o, lambda g: _fit(g, o.value))))

    def __mul__(self, o: Var) -> Var:
        return Var(self.value * o.value, ((self, lambda g: _fit(g * o.value, self.value)), (o, lambda g: _fit(g * self.value, o.value))))

    def __neg__(self) -> Var:
        return Var(-self.value, ((self, lambda g: -g),))

    def at(self, rows: np.ndarray) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, rows, g)
            return out

        return Var(self.value[rows], ((self, back),))

    def backward(self) -> None:
        order, seen = [], set()

        def visit(v: Var) -> None:
            if id(v) not in seen:
                seen.add(id(v))
                for p, _ in v.parents:
                    visit(p)
                order.append(v)

        visit(self)
        for v in order:
            v.grad = np.zeros_like(v.value)
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            for p, f in v.parents:
                p.grad = p.grad + f(v.grad)


def _fit(g: np.ndarray, like: np.ndarray) -> np.ndarray:
    """A gradient summed down to the shape of what was broadcast."""
    while g.ndim > like.ndim:
        g = g.sum(0)
    for i, n in enumerate(like.shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


def scatter(x: Var, to: np.ndarray, n: int) -> Var:
    """Rows of x added up by the node that they go to."""
    out = np.zeros((n, *x.value.shape[1:]))
    np.add.at(out, to, x.value)
    return Var(out, ((x, lambda g: g[to]),))


def pointwise(x: Var, f: np.ndarray, slope: np.ndarray) -> Var:
    return Var(f, ((x, lambda g: g * slope),))


def activation(name: str) -> Callable[[Var], Var]:
    """relu, elu, leaky_relu (0.01), tanh or sigmoid."""
    def act(x: Var) -> Var:
        v = x.value
        if name == "relu":
            return pointwise(x, np.maximum(v, 0), (v > 0).astype(float))
        if name == "elu":
            e = np.exp(np.minimum(v, 0))
            return pointwise(x, np.where(v > 0, v, e - 1), np.where(v > 0, 1, e))
        if name == "leaky_relu":
            return pointwise(x, np.where(v > 0, v, 0.01 * v), np.where(v > 0, 1, 0.01))
        if name == "tanh":
            return pointwise(x, np.tanh(v), 1 - np.tanh(v) ** 2)
        s = 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        return pointwise(x, s, s * (1 - s))

    if name not in ("relu", "elu", "leaky_relu", "tanh", "sigmoid"):
        raise ValueError(f"unknown activation {name!r}")
    return act


def dropout(x: Var, rate: float | bool, rng: np.random.Generator | None) -> Var:
    """Entries dropped with a probability (True: one half) while training (with a generator)."""
    p = 0.5 if rate is True else float(rate or 0)
    if rng is None or p <= 0:
        return x
    keep = (rng.random(x.value.shape) >= p) / (1 - p)
    return pointwise(x, x.value * keep, keep)


def segment_softmax(x: Var, to: np.ndarray, n: int) -> Var:
    """Softmax of edge scores (one column a head) among the edges into each node."""
    top = np.full((n, x.value.shape[1]), -np.inf)
    np.maximum.at(top, to, x.value)
    e = np.exp(x.value - top[to])
    total = np.zeros_like(top)
    np.add.at(total, to, e)
    s = e / total[to]

    def back(g: np.ndarray) -> np.ndarray:
        dot = np.zeros_like(total)
        np.add.at(dot, to, g * s)
        return s * (g - dot[to])

    return Var(s, ((x, back),))


def batch_norm(x: Var, scale: Var, shift: Var, stats: dict | None = None, train: bool = True, eps: float = 1e-5) -> Var:
    """Columns standardised by the batch, or by the running figures in stats when not training."""
    v = x.value
    if train:
        m, s = v.mean(0), v.var(0)
        if stats is not None:
            stats["m"], stats["s"] = 0.9 * stats.get("m", m) + 0.1 * m, 0.9 * stats.get("s", s) + 0.1 * s
    else:
        m, s = (stats or {}).get("m", v.mean(0)), (stats or {}).get("s", v.var(0))
    inv = 1 / np.sqrt(s + eps)
    z = (v - m) * inv

    def back(g: np.ndarray) -> np.ndarray:
        return inv * (g - g.mean(0) - z * (g * z).mean(0)) if train else g * inv

    return Var(z, ((x, back),)) * scale + shift


def mse(x: Var, y: np.ndarray) -> Var:
    d = x.value - y
    return Var((d * d).mean(), ((x, lambda g: g * 2 * d / d.size),))


def cross_entropy(x: Var, label: np.ndarray) -> Var:
    z = x.value - x.value.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    n = np.arange(len(label))

    def back(g: np.ndarray) -> np.ndarray:
        d = p.copy()
        d[n, label] -= 1
        return g * d / len(label)

    return Var(-np.log(np.maximum(p[n, label], 1e-300)).mean(), ((x, back),))


class Adam:
    def __init__(self, params: list[Var], rate: float = 1e-3, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = [[np.zeros_like(p.value), np.zeros_like(p.value)] for p in params]

    def step(self, rate: float | None = None) -> None:
        self.t += 1
        for p, m in zip(self.params, self.m, strict=True):
            g = (p.grad if p.grad is not None else 0) + self.decay * p.value
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p.value = p.value - (rate or self.rate) * (m[0] / (1 - 0.9**self.t)) / (np.sqrt(m[1] / (1 - 0.999**self.t)) + 1e-8)


class Linear:
    def __init__(self, n: int, m: int, rng: np.random.Generator):
        self.w, self.b = Var(rng.uniform(-1, 1, (n, m)) * np.sqrt(6 / (n + m))), Var(np.zeros(m))
        self.params = [self.w, self.b]

    def __call__(self, x: Var) -> Var:
        return x @ self.w + self.b
