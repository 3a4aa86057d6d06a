"""A small feed-forward network for Arrow tasks: rectified layers, Adam, a held-out share that ends the training."""
from __future__ import annotations

import numpy as np

# Step, decay of the two moments, and their floor.
STEP, FIRST, SECOND, FLOOR = 1e-3, 0.9, 0.999, 1e-8
BATCH, HELD_OUT, PATIENCE, LEAST_GAIN = 200, 0.1, 10, 1e-4


def start(sizes: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    """Weights and offsets of each layer, uniform within a bound that follows the layer's width."""
    out = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt((6.0 if len(out) // 2 < len(sizes) - 2 else 2.0) / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def forward(parameters: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The input and what each layer puts out; the last one has no rectifier."""
    layers = [x]
    for k in range(0, len(parameters), 2):
        z = layers[-1] @ parameters[k] + parameters[k + 1]
        layers.append(np.maximum(z, 0.0) if k + 2 < len(parameters) else z)
    return layers


def chance(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def loss_and_gradients(parameters: list[np.ndarray], x: np.ndarray, y: np.ndarray, classes: bool, decay: float) -> tuple[float, list[np.ndarray]]:
    """Mean loss of the rows (logistic, or half the squared error) with half the squared weights times decay / rows."""
    layers, n = forward(parameters, x), len(y)
    z = layers[-1][:, 0]
    loss = np.mean(np.logaddexp(0.0, z) - y * z) if classes else 0.5 * np.mean((z - y) ** 2)
    loss += 0.5 * decay / n * sum(float((w**2).sum()) for w in parameters[::2])
    error = (((chance(z) if classes else z) - y) / n)[:, None]
    gradients = [None] * len(parameters)
    for k in range(len(parameters) - 2, -1, -2):
        gradients[k] = layers[k // 2].T @ error + decay / n * parameters[k]
        gradients[k + 1] = error.sum(axis=0)
        error = (error @ parameters[k].T) * (layers[k // 2] > 0)
    return float(loss), gradients


def held_out(y: np.ndarray, classes: bool, rng: np.random.Generator) -> np.ndarray:
    """Marks a tenth of the rows, of each class where y holds classes; none where a class would be left with a single row."""
    out = np.zeros(len(y), bool)
    groups = [np.flatnonzero(y == c) for c in np.unique(y)] if classes else [np.arange(len(y))]
    for rows in groups:
        if len(rows) > 2:
            out[rng.permutation(rows)[:max(1, int(round(HELD_OUT * len(rows))))]] = True
    return out


def train(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], epochs: int, rng: np.random.Generator, classes: bool, decay: float = 1e-4) -> list[np.ndarray]:
    """Parameters with the best score on the held-out rows; training ends when it has not risen for some epochs."""
    apart = held_out(y, classes, rng)
    own, best, waited = np.flatnonzero(~apart), (-np.inf, None), 0
    parameters = start([x.shape[1], *hidden, 1], rng)
    first, second, turn = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            rows, turn = order[at:at + BATCH], turn + 1
            _, gradients = loss_and_gradients(parameters, x[rows], y[rows], classes, decay)
            step = STEP * np.sqrt(1 - SECOND**turn) / (1 - FIRST**turn)
            for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
                m += (1 - FIRST) * (g - m)
                v += (1 - SECOND) * (g**2 - v)
                p -= step * m / (np.sqrt(v) + FLOOR)
        if apart.any():
            z = forward(parameters, x[apart])[-1][:, 0]
            score = np.mean((z > 0) == (y[apart] > 0.5)) if classes else -np.mean((z - y[apart]) ** 2) / (np.var(y[apart]) or 1.0)
            waited = 0 if score > best[0] + LEAST_GAIN else waited + 1
            if score > best[0]:
                best = score, [p.copy() for p in parameters]
            if waited > PATIENCE:
                break
    return best[1] or parameters


def predict(parameters: list[np.ndarray], x: np.ndarray, classes: bool) -> np.ndarray:
    z = forward(parameters, x)[-1][:, 0]
    return chance(z) if classes else z
