"""Gradients of the network against differences of its loss."""

import numpy as np
import pytest

from quantloom.llm import cnn


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = cnn.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sizes = [1, 3, 700]  # the last document takes more than one block
    own = np.repeat(np.arange(3), sizes)
    block = rng.integers(0, 256, (sum(sizes), cnn.CHUNK), dtype=np.uint8)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    got = net.grads(block, own, y, weight)
    for name, g in got.items():
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            was, step = flat[i], 1e-6
            flat[i] = was + step
            up = net.loss(block, own, y, weight)
            flat[i] = was - step
            down = net.loss(block, own, y, weight)
            flat[i] = was
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7), (name, i)


def test_whole_texts_are_learned():
    """What tells the classes apart stands only at the end of long texts."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 1500, dtype=np.uint8)) + (b"$$$$ " * 12 if k % 2 else b"") for k in range(60)]
    net = cnn.fit_texts(texts, [1 - k % 2 for k in range(60)], 0.5)
    got = np.array(net.scores(texts))
    assert ((got > 0.5) == (np.arange(60) % 2 == 0)).all()
