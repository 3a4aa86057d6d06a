"""Small linear fits for Arrow tasks: least squares, ridge by leave-one-out error, elastic net by coordinate descent on sums of products."""
from __future__ import annotations

import numpy as np

from .numeric import RIDGE_ALPHAS

# Penalties and shares of the absolute penalty that the elastic net is chosen from.
NET_ALPHAS = tuple(np.logspace(2, -4, 20))
NET_MIXES = (0.1, 0.5, 0.9)
FOLDS = 5


def least_squares(x: np.ndarray, y: np.ndarray) -> dict:
    """The shortest of the best fits."""
    mean, centre = x.mean(axis=0), y.mean()
    slopes = np.linalg.lstsq(x - mean, y - centre, rcond=None)[0]
    return {"penalty": 0.0, "mix": 0.0, "intercept": centre - mean @ slopes, "slopes": slopes}


def ridge(x: np.ndarray, y: np.ndarray, alphas=RIDGE_ALPHAS) -> dict:
    """The penalty with the smallest leave-one-out error, which follows from one fit and the leverage of each row."""
    mean, centre = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    uy, best = u.T @ (y - centre), None
    for alpha in alphas:
        shrink = s**2 / (s**2 + alpha)
        left = 1.0 - 1.0 / len(y) - (u**2 * shrink).sum(axis=1)
        loss = np.mean(((y - centre - (u * shrink) @ uy) / np.maximum(left, 1e-10)) ** 2)
        if best is None or loss < best[0]:
            best = loss, alpha, vt.T @ (s / (s**2 + alpha) * uy)
    return {"penalty": best[1], "mix": 0.0, "intercept": centre - mean @ best[2], "slopes": best[2]}


def descend(gram: np.ndarray, rhs: np.ndarray, absolute: np.ndarray, square: np.ndarray, start: np.ndarray, sweeps: int = 10_000) -> np.ndarray:
    """Coordinate descent on k problems at once: w minimises w'Gw / 2 - r'w + absolute * |w| + square * w'w / 2."""
    w = start.copy()
    left = rhs - np.einsum("kij,kj->ki", gram, w)
    diagonal = np.einsum("kjj->kj", gram)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(w.shape[1]):
            pull = left[:, j] + diagonal[:, j] * w[:, j]
            weight = diagonal[:, j] + square
            new = np.where(weight > 0, np.sign(pull) * np.maximum(np.abs(pull) - absolute, 0.0) / np.where(weight > 0, weight, 1.0), 0.0)
            step = new - w[:, j]
            left -= gram[:, :, j] * step[:, None]
            w[:, j] = new
            moved = max(moved, np.abs(step).max())
        if moved <= 1e-10 * max(np.abs(w).max(), 1e-300):
            break
    return w


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of one, the columns and y: all that a fit and its error need to know of the rows."""
    z = np.column_stack([np.ones(len(y)), x, y])
    return z.T @ z


def centred(sums: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """Rows, means, mean of y, and the centred products of the columns with each other and with y."""
    n, mean, centre = sums[0, 0], sums[0, 1:-1] / sums[0, 0], sums[0, -1] / sums[0, 0]
    return n, mean, centre, sums[1:-1, 1:-1] - n * np.outer(mean, mean), sums[1:-1, -1] - n * mean * centre


def elastic_net(x: np.ndarray, y: np.ndarray, alphas=NET_ALPHAS, mixes=NET_MIXES, folds: int = FOLDS) -> dict:
    """Penalty and mix with the smallest mean error over contiguous folds, refitted on all rows.

    A fold's fit uses the sums of all rows without the fold's, its error the fold's sums; the rows are read once. The
    problems of all mixes and folds descend together, from the largest penalty on, each from where the last one ended.
    """
    folds = min(folds, len(y))
    parts = [products(x[rows], y[rows]) for rows in np.array_split(np.arange(len(y)), folds)]
    total = sum(parts)
    fits = [centred(total - part) for part in parts]
    k, p = len(mixes) * folds, x.shape[1]
    n = np.tile([f[0] for f in fits], len(mixes))
    gram, rhs = np.tile([f[3] for f in fits], (len(mixes), 1, 1)), np.tile([f[4] for f in fits], (len(mixes), 1))
    mix, w, best = np.repeat(mixes, folds), np.zeros((k, p)), None
    for alpha in sorted(alphas, reverse=True):
        w = descend(gram, rhs, n * alpha * mix, n * alpha * (1 - mix), w)
        errors = np.empty(k)
        for i in range(k):
            _, mean, centre, _, _ = fits[i % folds]
            line = np.concatenate([[mean @ w[i] - centre], -w[i], [1.0]])
            errors[i] = line @ parts[i % folds] @ line / parts[i % folds][0, 0]
        for m, error in zip(mixes, errors.reshape(len(mixes), folds).mean(axis=1), strict=True):
            if best is None or error < best[0]:
                best = error, alpha, m
    n, mean, centre, gram, rhs = centred(total)
    slopes = descend(gram[None], rhs[None], np.array([n * best[1] * best[2]]), np.array([n * best[1] * (1 - best[2])]), np.zeros((1, p)))[0]
    return {"penalty": best[1], "mix": best[2], "intercept": centre - mean @ slopes, "slopes": slopes}


LINES = {"ols": least_squares, "ridge": ridge, "elastic_net": elastic_net}
