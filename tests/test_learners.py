"""The small fits of a task against plain versions: penalties by refits, splits by trying all, gradients by differences."""
import numpy as np
import pytest

from epitide.functions import linear, networks, trees


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[:, 4] = x[:, 3] + rng.normal(0, 0.1, 60)
    return x, x @ [2.0, 0.0, -1.0, 0.5, 0.0] + rng.normal(0, 0.5, 60) + 7


def test_least_squares_of_dependent_columns(xy):
    x, y = xy
    twice = np.column_stack([x, x[:, 0]])
    line = linear.least_squares(twice, y)
    assert np.allclose(line["slopes"][0], line["slopes"][5]) and np.allclose(twice @ line["slopes"] + line["intercept"], np.column_stack(
        [np.ones(60), x]) @ np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0])


def test_ridge_penalty_by_leaving_rows_out(xy):
    x, y = xy
    alphas = np.logspace(-2, 2, 9)

    def solve(x, y, a):
        m, c = x.mean(0), y.mean()
        w = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(x.shape[1]), (x - m).T @ (y - c))
        return c - m @ w, w
    losses = []
    for a in alphas:
        errors = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            b, w = solve(x[keep], y[keep], a)
            errors.append((y[i] - b - x[i] @ w) ** 2)
        losses.append(np.mean(errors))
    line = linear.ridge(x, y, alphas)
    assert line["penalty"] == alphas[int(np.argmin(losses))]
    assert np.allclose(line["slopes"], solve(x, y, line["penalty"])[1])


def net_loss(x, y, b, w, alpha, mix):
    return np.mean((y - b - x @ w) ** 2) / 2 + alpha * mix * np.abs(w).sum() + alpha * (1 - mix) / 2 * (w**2).sum()


def test_elastic_net_is_the_minimum(xy):
    x, y = xy
    line = linear.elastic_net(x, y)
    best = net_loss(x, y, line["intercept"], line["slopes"], line["penalty"], line["mix"])
    rng = np.random.default_rng(0)
    for size in (1e-1, 1e-2, 1e-4):
        for _ in range(200):
            assert best <= net_loss(x, y, line["intercept"] + rng.normal() * size, line["slopes"] + rng.normal(size=5) * size, line["penalty"], line["mix"]) + 1e-12


def test_elastic_net_penalty_by_refits_of_the_folds(xy):
    x, y = xy
    alphas, mixes, losses = (10.0, 0.1, 0.01), (0.1, 0.9), {}
    for a in alphas:
        for m in mixes:
            errors = []
            for rows in np.array_split(np.arange(60), 5):
                keep = np.setdiff1d(np.arange(60), rows)
                mean, c, w = x[keep].mean(0), y[keep].mean(), np.zeros(5)
                for _ in range(3000):  # one column after the other
                    for j in range(5):
                        z = x[keep] - mean
                        pull = z[:, j] @ (y[keep] - c - z @ w + z[:, j] * w[j]) / len(keep)
                        w[j] = np.sign(pull) * max(abs(pull) - a * m, 0) / (z[:, j] @ z[:, j] / len(keep) + a * (1 - m))
                errors.append(np.mean((y[rows] - c - (x[rows] - mean) @ w) ** 2))
            losses[a, m] = np.mean(errors)
    line = linear.elastic_net(x, y, alphas, mixes)
    assert (line["penalty"], line["mix"]) == min(losses, key=losses.get)


def test_columns_without_spread():
    x, y = np.zeros((10, 2)), np.arange(10.0)
    for fit in linear.LINES.values():
        line = fit(x, y)
        assert np.allclose(line["slopes"], 0) and line["intercept"] == pytest.approx(4.5)


@pytest.mark.parametrize("shape", [trees.TreeShape(least_rows=3), trees.TreeShape(least_rows=2, square=1.5), trees.TreeShape(least_weight=4.0, square=2.0, absolute=0.3)])
def test_split_by_trying_all(shape):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[rng.random((40, 3)) < 0.15] = np.nan
    y, weight = rng.normal(size=40) + np.where(np.nan_to_num(x[:, 1], nan=1.0) > 0.2, 2, 0), rng.integers(0, 3, 40).astype(float)
    cuts = trees.cuts_of(x)
    codes = trees.binned(x, cuts)

    def score(rows):
        g, h = (y[rows] * weight[rows]).sum(), weight[rows].sum()
        return max(abs(g) - shape.absolute, 0) ** 2 / (h + shape.square)
    used = np.flatnonzero(weight > 0)
    best = 0.0
    for j in range(3):
        for cut in [*cuts[j], np.inf]:
            for way in (True, False):
                left = np.array([way if np.isnan(x[i, j]) else x[i, j] <= cut for i in used])
                a, b = used[left], used[~left]
                if min(len(a), len(b)) >= shape.least_rows and min(weight[a].sum(), weight[b].sum()) >= shape.least_weight:
                    best = max(best, score(a) + score(b) - score(used))
    found = trees.best_split(codes[used], y[used], weight[used], np.arange(3), shape)
    assert found[0] == pytest.approx(best)
    tree = trees.grow(codes, y, weight, trees.TreeShape(leaves=2, least_rows=shape.least_rows, least_weight=shape.least_weight, square=shape.square, absolute=shape.absolute))
    assert tree.gain[0] == pytest.approx(best) and len(set(tree.predict(codes))) == 2


def test_whole_tree_fits_every_row():
    x = np.arange(50.0)[:, None]
    y = np.random.default_rng(1).normal(size=50)
    codes = trees.binned(x, trees.cuts_of(x))
    assert np.allclose(trees.grow(codes, y, np.ones(50), trees.TreeShape()).predict(codes), y)
    assert trees.grow(codes, y, np.ones(50), trees.TreeShape(depth=3)).column.count(-1) <= 8
    assert trees.grow(codes, y, np.ones(50), trees.TreeShape(leaves=5)).column.count(-1) == 5


def test_boosting_stops_and_learns():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (300, 4))
    y = np.sin(x[:, 0]) * 3 + (x[:, 1] > 0) + rng.normal(0, 0.1, 300)
    x[rng.random(300) < 0.2, 2] = np.nan
    shape = trees.TreeShape(depth=3, least_weight=5.0, square=2.0, absolute=0.1)
    values, kept, share = trees.boost(x[:200], y[:200], x[250:], 2000, 0.05, shape, rng, 0.8, 0.8, (x[200:250], y[200:250]), 30)
    assert 0 < kept < 2000 and np.mean((values - y[250:]) ** 2) < 0.1 * np.var(y)
    assert share.sum() == pytest.approx(1.0) and set(np.argsort(share)[-2:]) == {0, 1}
    values, kept, _ = trees.boost(x[:200], y[:200], x[250:], 10, 0.1, shape, rng)
    assert kept == 10 and np.isfinite(values).all()


def test_forest_averages(xy):
    x, y = xy
    values = trees.forest(x[:50], y[:50], x[50:], 40, np.random.default_rng(0))
    assert np.corrcoef(values, y[50:])[0, 1] > 0.8 and values.min() >= y[:50].min() and values.max() <= y[:50].max()


@pytest.mark.parametrize("classes", [True, False])
def test_network_gradients_by_differences(classes):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 2, 12).astype(float)
    parameters = networks.start([3, 5, 4, 1], rng)
    _, gradients = networks.loss_and_gradients(parameters, x, y, classes, 0.5)
    for p, g in zip(parameters, gradients, strict=True):
        for at in np.ndindex(p.shape):
            keep, size = p[at], 1e-6
            p[at] = keep + size
            above = networks.loss_and_gradients(parameters, x, y, classes, 0.5)[0]
            p[at] = keep - size
            below = networks.loss_and_gradients(parameters, x, y, classes, 0.5)[0]
            p[at] = keep
            # offsets carry no penalty
            assert g[at] == pytest.approx((above - below) / (2 * size), abs=1e-6)


def test_network_learns_and_stops_early():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = networks.train(x[:500], y[:500], (64, 32), 400, rng, True)
    assert np.mean((networks.predict(net, x[500:], True) > 0.5) == (y[500:] > 0.5)) > 0.8
    line = networks.train(x[:500], x[:500, 2] * 2 + 1, (64, 32), 400, rng, False)
    assert np.mean((networks.predict(line, x[500:], False) - x[500:, 2] * 2 - 1) ** 2) < 0.1


def test_held_out_rows_by_class():
    y = np.array([1.0] * 4 + [0.0] * 36)
    apart = networks.held_out(y, True, np.random.default_rng(0))
    assert y[apart].sum() == 1 and apart.sum() == 5 and not networks.held_out(np.array([0.0, 1.0]), True, np.random.default_rng(0)).any()
