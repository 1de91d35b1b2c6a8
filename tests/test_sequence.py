"""The recurrent classifier: gradient, learning an order that no flat statistic shows, one class, errors."""

import numpy as np
import pytest

from tellumen.operators.conformal import auc
from tellumen.operators.sequence import Net, SequenceModel

T, D = 8, 2
COLUMNS = [f"{c}_t{t}" for t in range(T) for c in "ab"]


def test_gradient():
    rng = np.random.default_rng(1)
    net, x, y = Net(D, 5, seed=2), rng.normal(size=(7, T, D)), np.array([0, 1, 1, 0, 0, 1, 0.0])
    loss, g = net.gradient(x, y, 3.0)
    for i in rng.choice(len(g), 40, replace=False):
        keep = net.flat[i]
        net.flat[i] = keep + 1e-6
        up = net.gradient(x, y, 3.0)[0]
        net.flat[i] = keep - 1e-6
        down = net.gradient(x, y, 3.0)[0]
        net.flat[i] = keep
        assert np.isclose(g[i], (up - down) / 2e-6, atol=1e-6)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, T, D))
    y = (x[:, -4:, 0].sum(axis=1) > x[:, :4, 0].sum(axis=1) + 1).astype(int)
    rows = [(k, int(y[k]), *[None if k % 50 == 0 and j == 1 else float(v) for j, v in enumerate(x[k].ravel())]) for k in range(len(y))]
    return spark.createDataFrame(rows, ", ".join(["id int", "y int", *[f"{c} double" for c in COLUMNS]])).repartition(3)


def test_learns(windows):
    m = SequenceModel(COLUMNS, D, hidden=12, rounds=6, batch=32).fit(windows.filter("id < 900"))
    out = m.score(windows.filter("id >= 900"))
    assert auc(out, []).first().auc > 0.9 and out.count() == 300 and out.filter("p IS NULL OR p < 0 OR p > 1").isEmpty()
    assert len(m.history) >= 2 and min(m.history) < m.history[0] + 1e-9


def test_edges(windows):
    with pytest.raises(ValueError):
        SequenceModel(COLUMNS[:-1], D)
    with pytest.raises(ValueError):
        SequenceModel(COLUMNS, D).fit(windows.filter("1 = 0"))
    with pytest.raises(RuntimeError):
        SequenceModel(COLUMNS, D).score(windows)
    one = SequenceModel(COLUMNS, D).fit(windows.filter("y = 1")).score(windows)
    assert one.select("p").distinct().first().p == 1.0
