"""The few vectorised (Arrow) functions: Spark has no error function and no matrix solve."""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT = T.StructType([
    T.StructField("intercept", T.DoubleType()),
    T.StructField("slopes", T.ArrayType(T.DoubleType())),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
])



@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Survival function of the standard normal, NULL for missing input."""
    tail = np.fromiter((math.erfc(v) for v in z.to_numpy(dtype=float) / math.sqrt(2.0)), float, len(z))
    return pd.Series(0.5 * tail).where(np.isfinite(z.to_numpy(dtype=float)))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def unpack_symmetric(packed: np.ndarray, k: int) -> np.ndarray:
    """Rows of upper triangles (row by row) to a stack of k x k matrices."""
    full = np.empty((packed.shape[0], k, k))
    rows, cols = np.triu_indices(k)
    full[:, rows, cols] = packed
    full[:, cols, rows] = packed
    return full


def solve_scaled(n, sx, sy, sxx, sxy, syy, alpha, x_scale, scale_y):
    """Ridge (alpha > 0) or least squares (alpha = 0) on z-scored columns from centred sums.

    All inputs carry one fit per row. Returns means, scales, coefficients on the z scale and the
    residual deviation on the scale of y.
    """
    k = sx.shape[1]
    n1 = n[:, None]
    mean_x, mean_y = sx / n1, sy / n
    cxx = unpack_symmetric(sxx, k) - n[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
    cxy = sxy - n1 * mean_x * mean_y[:, None]
    cyy = np.maximum(syy - n * mean_y**2, 0.0)
    dof = np.maximum(n - 1, 1) if x_scale == "sample" else n
    var_x = np.einsum("ijj->ij", cxx) / dof[:, None]
    floor = 1e-12 * np.maximum(np.einsum("ijj->ij", unpack_symmetric(sxx, k)) / n1, 1e-300)
    sd_x = np.where(var_x > floor, np.sqrt(np.maximum(var_x, 0.0)), 1.0)
    sd_y_raw = np.sqrt(cyy / np.maximum(n - 1, 1))
    sd_y = np.where(sd_y_raw > 0, sd_y_raw, 1.0) if scale_y else np.ones_like(sd_y_raw)
    gram = cxx / (sd_x[:, :, None] * sd_x[:, None, :])
    rhs = cxy / (sd_x * sd_y[:, None])
    if alpha > 0:
        coef = np.linalg.solve(gram + alpha * np.eye(k), rhs[:, :, None])[:, :, 0]
    else:
        coef = np.einsum("ijk,ik->ij", np.linalg.pinv(gram, rcond=1e-12, hermitian=True), rhs)
    slope = coef * sd_y[:, None] / sd_x
    rss = cyy - 2 * np.einsum("ij,ij->i", slope, cxy) + np.einsum("ij,ijk,ik->i", slope, cxx, slope)
    sigma = np.sqrt(np.maximum(rss, 0.0) / np.maximum(n - 1, 1))
    sigma = np.where((n > 2) & (sigma > 0), sigma, np.where(sd_y_raw > 0, sd_y_raw, 1.0))
    return mean_x, mean_y, sd_x, sd_y, coef, sigma


def ridge_from_sums(alpha: float, x_scale: str = "sample", scale_y: bool = True):
    """Arrow function: sums of one fit per row -> the fitted line on the raw scale.

    sums = struct(n, sx, sy, sxx, sxy, syy) as made by operators.moments; the result holds intercept and
    slopes relative to the same origin as the sums, z-scale coefficients and the residual deviation.
    """

    @F.pandas_udf(FIT)
    def fit(sums: pd.DataFrame) -> pd.DataFrame:
        n = sums["n"].to_numpy(dtype=float)
        where = np.flatnonzero(np.isfinite(n) & (n >= 1))
        intercept, sigma = np.full(len(n), np.nan), np.full(len(n), np.nan)
        slopes, coefficients = [None] * len(n), [None] * len(n)
        if len(where):
            part = sums.iloc[where]
            mean_x, mean_y, sd_x, sd_y, coef, sigma[where] = solve_scaled(
                n[where], np.stack(part["sx"].to_numpy()), part["sy"].to_numpy(dtype=float),
                np.stack(part["sxx"].to_numpy()), np.stack(part["sxy"].to_numpy()),
                part["syy"].to_numpy(dtype=float), alpha, x_scale, scale_y)
            slope = coef * sd_y[:, None] / sd_x
            intercept[where] = mean_y - np.einsum("ij,ij->i", slope, mean_x)
            for row, s, c in zip(where, slope, coef):
                slopes[row], coefficients[row] = s, c
        return pd.DataFrame({"intercept": intercept, "slopes": slopes, "coefficients": coefficients, "sigma": sigma})

    return fit


def past_quantiles(values: np.ndarray, q: float) -> np.ndarray:
    """For each value the q-quantile of those before it, interpolated; NaN for the first.

    A tree over the ranks of all values holds how many of them have been seen, so a value is added and the k-th smallest found in
    log n steps.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(1, n + 1)
    ordered, seen, out = values[order].tolist(), [0] * (n + 1), np.full(n, np.nan)
    top = 1 << max(0, n.bit_length() - 1)

    def smallest(k: int) -> float:
        at, step = 0, top
        while step:
            if at + step <= n and seen[at + step] < k:
                at += step
                k -= seen[at]
            step >>= 1
        return ordered[at]

    for i, r in enumerate(rank.tolist()):
        if i:
            place = q * (i - 1)
            low = int(place)
            a = smallest(low + 1)
            out[i] = a if place == low else a + (place - low) * (smallest(low + 2) - a)
        while r <= n:
            seen[r] += 1
            r += r & -r
    return out


RIDGE_ALPHAS = tuple(np.logspace(-4, 4, 25))


def ridge_cv(x: np.ndarray, y: np.ndarray, weight: np.ndarray, alphas=RIDGE_ALPHAS):
    """Weighted ridge on standardised columns, penalty by exact leave-one-out error.

    A weight counts copies of a row, as in a bootstrap sample. Returns intercept and slopes on the raw scale.
    """
    total = weight.sum()
    mean, centre = weight @ x / total, weight @ y / total
    sd = np.sqrt(weight @ (x - mean) ** 2 / total)
    sd[~(sd > 0)] = 1.0
    root = np.sqrt(weight)
    u, s, vt = np.linalg.svd(root[:, None] * (x - mean) / sd, full_matrices=False)
    uy = u.T @ (root * (y - centre))
    best = (np.inf, None)
    for alpha in alphas:
        shrink = s**2 / (s**2 + alpha)
        resid = y - centre - (u * shrink) @ uy / root
        leverage = (u**2 * shrink).sum(axis=1) / weight + 1.0 / total
        loss = weight @ (resid / np.maximum(1.0 - leverage, 1e-10)) ** 2 / total
        if loss < best[0]:
            best = (loss, (vt.T * (s / (s**2 + alpha))) @ uy)
    slope = best[1] / sd
    return centre - slope @ mean, slope
