"""A small random forest in NumPy, for scores inside a task.

Trees hold places of rows, never copies of them, and columns are read one at a time, so that beside the matrix (which may be of
single precision) a fit takes a few numbers a row.
"""

from __future__ import annotations

import numpy as np

def _column(x: np.ndarray, scale: np.ndarray | None, rows: np.ndarray, f: int) -> np.ndarray:
    v = x[rows, f].astype(float)
    return v if scale is None else v * scale[f]


def _mean(t: np.ndarray, width: int) -> np.ndarray:
    return np.bincount(t, minlength=width) / len(t) if width else t.mean(0)


def _best(v: np.ndarray, t: np.ndarray, width: int, least: int) -> tuple[float, float]:
    """What the best cut of a column gains, and the cut."""
    order = np.argsort(v, kind=None if width else "stable")  # numbers of classes are the same in any order of ties
    v, t, n = v[order], t[order], len(v)
    if width:
        # a row raises its class's number from m to m + 1 and the sum of squares by 2m + 1
        size = np.bincount(t, minlength=width)
        by, earlier = np.argsort(t, kind="stable"), np.empty(n)
        earlier[by] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        whole = float((size.astype(float) ** 2).sum())
        one = np.cumsum(2 * earlier + 1)[:-1]
        other = whole - 2 * np.cumsum(size.astype(float)[t])[:-1] + one
    else:
        sums = np.cumsum(t, 0)
        whole, one, other = (sums[-1] ** 2).sum(), (sums[:-1] ** 2).sum(1), ((sums[-1] - sums[:-1]) ** 2).sum(1)
    m = np.arange(1, n)
    gain = np.where((v[1:] > v[:-1]) & (m >= least) & (n - m >= least), one / m + other / (n - m) - whole / n, 0)
    k = int(gain.argmax())
    return float(gain[k]), float((v[k + 1] + v[k]) / 2)


def _tree(x: np.ndarray, scale: np.ndarray | None, t: np.ndarray, width: int, rows: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple:
    """(feature, cut, left, right) of the split that lowers the squared error most, or the mean as a leaf."""
    own = t[rows]
    if depth == 0 or len(rows) < 2 * least or ((own == own[0]).all() if width else np.allclose(own, own[0])):
        return (_mean(own, width),)
    best = (0.0, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, round(np.sqrt(x.shape[1]))), replace=False):
        gain, cut = _best(_column(x, scale, rows, f), own, width, least)
        if gain > best[0] + 1e-12:
            best = (gain, int(f), cut)
    if best[1] < 0:
        return (_mean(own, width),)
    left = _column(x, scale, rows, best[1]) <= best[2]
    return best[1], best[2], _tree(x, scale, t, width, rows[left], rng, depth - 1, least), _tree(x, scale, t, width, rows[~left], rng, depth - 1, least)


def _answer(tree: tuple, x: np.ndarray, scale: np.ndarray | None, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += tree[0]
        return
    left = _column(x, scale, rows[at], tree[0]) <= tree[1]
    _answer(tree[2], x, scale, out, rows, at[left])
    _answer(tree[3], x, scale, out, rows, at[~left])


def predict(x: np.ndarray, t: np.ndarray, train: np.ndarray, test: np.ndarray, trees: int = 50, depth: int = 8, least: int = 2, seed: int = 0, width: int = 0, scale: np.ndarray | None = None) -> np.ndarray:
    """Means over trees of bootstrapped rows of x, columns times scale, for its rows test; t holds a row of targets for each row of
    x, or the number of its class where width tells how many classes there are."""
    rng, out = np.random.default_rng(seed), np.zeros((len(test), width or t.shape[1]))
    for _ in range(trees):
        rows = train[rng.integers(0, len(train), len(train))]
        _answer(_tree(x, scale, t, width, rows, rng, depth, least), x, scale, out, test, np.arange(len(test)))
    return out / trees


def score(x: np.ndarray, y: np.ndarray, classes: bool, seed: int = 0, every: int = 4, scale: np.ndarray | None = None) -> float:
    """Accuracy, or minus the mean squared error, on each `every`-th row after a fit on the others."""
    test = np.arange(len(y)) % every == 0
    names, code = np.unique(y, return_inverse=True)
    t = code.astype(np.int16 if len(names) < 1 << 15 else np.int64) if classes else y[:, None]
    got = predict(x, t, np.flatnonzero(~test), np.flatnonzero(test), seed=seed, width=len(names) if classes else 0, scale=scale)
    return float((got.argmax(1) == code[test]).mean()) if classes else -float(((got[:, 0] - y[test]) ** 2).mean())
