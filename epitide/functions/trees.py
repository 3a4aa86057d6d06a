"""Small regression trees on binned columns for Arrow tasks: one tree, a forest's trees, boosting."""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

BINS = 255


@dataclass(frozen=True)
class TreeShape:
    """What bounds a tree, and the penalties on its leaves."""

    leaves: int | None = None
    depth: int | None = None
    least_rows: int = 1
    least_weight: float = 0.0
    square: float = 0.0
    absolute: float = 0.0


def cuts_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values between bins: midpoints of its different values, or of evenly spread ones where there are more."""
    out = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > bins:
            values = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, bins), method="inverted_cdf"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every value; BINS where it is missing."""
    codes = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)]) if cuts else np.zeros(x.shape, np.int64)
    return np.where(np.isnan(x), BINS, codes)


def strength(sums: np.ndarray, weight: np.ndarray, shape: TreeShape) -> np.ndarray:
    """How much a leaf with these sums lowers the loss, twice."""
    pull = np.maximum(np.abs(sums) - shape.absolute, 0.0)
    return np.divide(pull**2, weight + shape.square, out=np.zeros_like(pull), where=weight + shape.square > 0)


def best_split(codes: np.ndarray, residual: np.ndarray, weight: np.ndarray, columns: np.ndarray, shape: TreeShape):
    """(gain, column, last bin on the left, whether missing values go left) of the best split of these rows, or None.

    Histograms of rows, weights and weighted residuals over bins and columns; both ways are tried for missing values.
    """
    width = BINS + 1
    flat = (codes[:, columns] + np.arange(len(columns)) * width).ravel()

    def histogram(values):
        return np.bincount(flat, np.repeat(values, len(columns)), width * len(columns)).reshape(len(columns), width)
    sums = np.stack([histogram(residual * weight), histogram(weight), histogram((weight > 0).astype(float))])
    missing, total = sums[:, :, -1:], sums.sum(axis=2, keepdims=True)
    left = np.cumsum(sums[:, :, :-1], axis=2)
    left = np.stack([left, left + missing], axis=3)  # missing to the right, to the left
    right = total[..., None] - left
    fits = np.minimum(left[2], right[2]) >= max(shape.least_rows, 1)
    fits &= np.minimum(left[1], right[1]) >= shape.least_weight
    gain = strength(left[0], left[1], shape) + strength(right[0], right[1], shape) - strength(total[0], total[1], shape)[..., None]
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax())
    column, bin_, way = np.unravel_index(at, gain.shape)
    best = gain.flat[at]
    return None if not best > 1e-12 * max(1.0, float(total[1, 0, 0])) else (float(best), int(columns[column]), int(bin_), bool(way))


@dataclass
class Tree:
    """Nodes in arrays; column -1 marks a leaf."""

    column: list
    bin: list
    missing_left: list
    left: list
    right: list
    value: list
    gain: list

    def predict(self, codes: np.ndarray) -> np.ndarray:
        column, bin_, way, left, right = (np.array(v) for v in (self.column, self.bin, self.missing_left, self.left, self.right))
        node = np.zeros(len(codes), np.int64)
        while (inner := np.flatnonzero(column[node] >= 0)).size:
            at = node[inner]
            code = codes[inner, column[at]]
            node[inner] = np.where(np.where(code == BINS, way[at], code <= bin_[at]), left[at], right[at])
        return np.array(self.value)[node]


def grow(codes: np.ndarray, residual: np.ndarray, weight: np.ndarray, shape: TreeShape, columns: np.ndarray | None = None) -> Tree:
    """The tree that splits where it gains most, best leaf first."""
    columns = np.arange(codes.shape[1]) if columns is None else columns
    tree = Tree([], [], [], [], [], [], [])
    waiting = []

    def add(rows, depth):
        g, h = float((residual[rows] * weight[rows]).sum()), float(weight[rows].sum())
        node = len(tree.column)
        for field, v in ((tree.column, -1), (tree.bin, 0), (tree.missing_left, False), (tree.left, 0), (tree.right, 0), (tree.gain, 0.0),
                         (tree.value, np.sign(g) * max(abs(g) - shape.absolute, 0.0) / (h + shape.square) if h + shape.square > 0 else 0.0)):
            field.append(v)
        if (shape.depth is None or depth < shape.depth) and len(rows) >= 2 * max(shape.least_rows, 1) and len(columns):
            found = best_split(codes[rows], residual[rows], weight[rows], columns, shape)
            if found:
                heapq.heappush(waiting, (-found[0], node, found, rows, depth))
        return node

    add(np.flatnonzero(weight > 0), 0)
    leaves = 1
    while waiting and (shape.leaves is None or leaves < shape.leaves):
        _, node, (gain, column, bin_, way), rows, depth = heapq.heappop(waiting)
        code = codes[rows, column]
        to_left = np.where(code == BINS, way, code <= bin_)
        tree.column[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = column, bin_, way, gain
        tree.left[node], tree.right[node] = add(rows[to_left], depth + 1), add(rows[~to_left], depth + 1)
        leaves += 1
    return tree


def forest(x: np.ndarray, y: np.ndarray, new: np.ndarray, trees: int, rng: np.random.Generator, least_rows: int = 3) -> np.ndarray:
    """Mean prediction of trees grown on samples with replacement; every split looks at all columns."""
    cuts = cuts_of(x)
    codes, ahead, shape = binned(x, cuts), binned(new, cuts), TreeShape(least_rows=least_rows)
    out = np.zeros(len(new))
    for _ in range(trees):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        out += grow(codes, y, weight, shape).predict(ahead)
    return out / max(trees, 1)


def boost(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int, rate: float, shape: TreeShape, rng: np.random.Generator,
          rows: float = 1.0, columns: float = 1.0, valid: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 100):
    """(predictions, rounds kept, mean gain of each column as a share): trees on residuals, each shrunk by `rate`.

    rows and columns are the shares that a tree sees. With validation rows it stops once their error has not fallen for `patience`
    rounds, and the trees up to the best round count.
    """
    cuts = cuts_of(x)
    codes, ahead = binned(x, cuts), binned(new, cuts)
    held = None if valid is None else binned(valid[0], cuts)
    base = float(y.mean())
    fitted, out, kept = np.full(len(y), base), np.full(len(new), base), np.full(len(new), base)
    judged = None if valid is None else np.full(len(valid[1]), base)
    best, last, used, gains = np.inf, 0, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    final = used.copy(), gains.copy()
    if held is not None and len(held):
        best = float(np.mean((valid[1] - judged) ** 2))
    for turn in range(1, rounds + 1):
        weight = (rng.random(len(y)) < rows).astype(float) if rows < 1 else np.ones(len(y))
        some = np.sort(rng.permutation(x.shape[1])[:max(1, int(columns * x.shape[1]))]) if columns < 1 else None
        tree = grow(codes, y - fitted, weight, shape, some)
        fitted += rate * tree.predict(codes)
        out += rate * tree.predict(ahead)
        for column, gain in zip(tree.column, tree.gain, strict=True):
            if column >= 0:
                used[column] += 1
                gains[column] += gain
        if held is None or not len(held):
            kept, last, final = out, turn, (used, gains)
            continue
        judged += rate * tree.predict(held)
        error = float(np.mean((valid[1] - judged) ** 2))
        if error < best:
            best, last, kept, final = error, turn, out.copy(), (used.copy(), gains.copy())
        elif turn - last >= patience:
            break
    used, gains = final
    mean = np.divide(gains, used, out=np.zeros_like(gains), where=used > 0)
    return kept, last, mean / (mean.sum() or 1.0)
