"""Training of graph networks: gradients, sums over tasks, epochs that go on."""

import numpy as np
import pytest

from faultline.operators import model, network

R = np.random.default_rng(5)
DOCS = [R.integers(0, 12, n) for n in (1, 6, 9, 30, 2, 14)] + [np.zeros(0, np.int32)]
Y = np.array([0, 1, 0, 1, 1, 0, 1], float)
NETS = [model.Network(), model.Network(residual=False, how="sum"), model.Network("gated", how="concat"), model.Network("gated", 1, False, scale=0.5)]


def weights(net, low_rank=False):
    w = network.fresh_weights(12, 4, 3, net, seed=3)
    if low_rank:
        w |= {"encode_down": R.normal(size=(4, 2)), "encode_up": R.normal(size=(2, 4))}
    return w


@pytest.mark.parametrize("net", NETS)
@pytest.mark.parametrize("loss", ["supcon", "triplet"])
def test_gradients_equal_finite_differences(net, loss):
    w, how = weights(net, net.scale != 1), network.Training(loss=loss, contrast=0.4, temperature=0.5)
    _, grads = network.gradients(DOCS, Y, w, net, how)
    for name, x in w.items():
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 12)]:
            ends = []
            for move in (1e-6, -1e-6):
                moved = x.copy()
                moved[at] += move
                ends.append(network.gradients(DOCS, Y, w | {name: moved}, net, how)[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - grads[name][at]) < 1e-6, (name, at)


def test_losses_by_loops():
    e = R.normal(size=(6, 3))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = np.array([0, 0, 1, 1, 1, 2])
    anchors = []
    for i in range(6):
        positives = [j for j in range(6) if j != i and y[j] == y[i]]
        total = sum(np.exp(e[i] @ e[k] / 0.07) for k in range(6) if k != i)
        if positives:
            anchors.append(-np.mean([e[i] @ e[j] / 0.07 - np.log(total) for j in positives]))
    assert np.isclose(network.supcon(e, y, 0.07)[0], np.mean(anchors))
    gap = lambda i, j: np.linalg.norm(e[i] - e[j])
    hard = [max(0, max(gap(i, j) for j in range(6) if j != i and y[j] == y[i]) - min(gap(i, j) for j in range(6) if y[j] != y[i]) + 0.3) for i in range(5)]
    assert np.isclose(network.triplet(e, y, 0.3)[0], np.mean(hard))
    assert network.supcon(e, np.arange(6), 0.07)[0] == network.triplet(e, np.zeros(6), 0.3)[0] == 0


def rows_of(spark, n=90):
    draw = np.random.default_rng(1)
    rows = [(i, [int(x) for x in draw.integers(0, 10, 12)] + [10 + i % 2] * 2, i % 2) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1), (n + 1, [], 0), (n + 2, [3], None)], "id long, ids array<int>, target int").repartition(3)


def test_sums_over_tasks_are_the_mean_over_batches(spark, monkeypatch):
    net, how = model.Network(), network.Training(batch=8, steps=3)
    w = weights(net)
    dealt = network.batches(rows_of(spark), "ids", "target", how)
    held = dealt.collect()
    assert sum(len(r.target) for r in held) == 92 and max(len(r.target) for r in held) <= 8 and {r.step for r in held} == {0, 1, 2}
    each = [(len(r.target), *network.gradients([np.array(x, np.int64) for x in r.ids], np.array(r.target, float), w, net, how)) for r in held]
    monkeypatch.setattr(network, "BLOCK", 7)
    n, loss, grads = network.mean_gradient(dealt, w, net, how)
    assert n == 92 and np.isclose(loss, sum(k * x for k, x, _ in each) / 92)
    for name in w:
        assert np.allclose(grads[name], sum(k * g[name] for k, _, g in each) / 92)


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    rows, net = rows_of(spark).filter("id <= 40"), model.Network("gated", 1, how="sum")
    how = network.Training(epochs=4, steps=2, batch=16, rate=0.03)
    whole = network.train(rows, rows, str(tmp_path / "a"), start=weights(net), net=net, how=how)
    network.train(rows, rows, str(tmp_path / "b"), start=weights(net), net=net, how=how, until=2)
    assert network.load(spark, str(tmp_path / "b"), best=False).epoch == 2
    again = network.train(rows, rows, str(tmp_path / "b"), net=net, how=how)
    last = [network.load(spark, str(tmp_path / k), best=False) for k in "ab"]
    assert again.epoch == whole.epoch and last[0].steps == last[1].steps == 8
    for name in whole.weights:
        assert np.array_equal(whole.weights[name], again.weights[name]) and np.array_equal(last[0].weights[name], last[1].weights[name])
    assert whole.accuracy >= last[0].accuracy and whole.accuracy > 0.9
    none = network.train(rows.limit(0), rows, str(tmp_path / "c"), start=weights(net), net=net, how=how)
    assert none.epoch == 0 and network.load(spark, str(tmp_path / "c")) is None
    with pytest.raises(ValueError, match="start"):
        network.train(rows, rows, str(tmp_path / "c"), net=net, how=how)


def test_rate_rises_and_falls():
    how = network.Training(rate=1.0)
    assert [round(network.rate_at(k, 20, how), 3) for k in (0, 1, 2, 11, 20)] == [0.0, 0.5, 1.0, 0.5, 0.0]
