"""Parts of the classifiers and of packing against plain arithmetic."""

import random

import numpy as np
import pytest

from cueloom.llm import packing, quality


def test_votes_are_those_of_a_plain_search():
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))(rng.standard_normal((n, 7)))
    model = quality.Model(np.ones(1), np.ones(1), unit(60), (rng.random(60) < 0.4).astype(np.float32), 0.4)
    rows = np.vstack([unit(600), np.zeros((1, 7), np.float32)])
    got = quality.vote(rows, model, neighbours=5)
    for row, score in zip(rows, got):
        near = sorted(range(60), key=lambda i: -float(row @ model.vectors[i]))[:5]
        weights = [max(0.0, float(row @ model.vectors[i])) ** quality.SHARPNESS for i in near]
        want = sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights) if sum(weights) > 1e-9 else 0.4
        assert score == pytest.approx(want, abs=1e-5)
    empty = quality.Model(np.ones(1), np.ones(1), np.zeros((0, 7), np.float32), np.zeros(0, np.float32), 0.25)
    assert quality.vote(rows, empty).tolist() == [0.25] * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_are_a_least_squares_solution(seed):
    """No repeat can be moved for a smaller distance: the slope is flat where it is positive, and rises where it is zero."""
    rng = random.Random(seed)
    window = 64
    counts = {n: rng.randrange(0, 400) for n in rng.sample(range(1, window + 1), 30)}
    combos = packing.combinations(sorted(n for n in counts if counts[n]), window)
    x = packing.least_squares({n: c for n, c in counts.items() if c}, combos, sweeps=4000)
    left = {n: c - sum(v * combo.count(n) for v, combo in zip(x, combos)) for n, c in counts.items()}
    for v, combo in zip(x, combos):
        slope = -sum(left[n] for n in combo)
        assert v >= 0 and (slope > -4.0 if v == 0 else abs(slope) < 4.0), (combo, v, slope)
    assert combos and all(sum(combo) == window for combo in combos)
    if combos:
        plain = np.array([[combo.count(n) for combo in combos] for n in counts], float)
        target = np.array(list(counts.values()), float)
        mine = np.sum((plain @ np.array(x) - target) ** 2)
        y = np.zeros(len(combos))  # projected gradient, a plain way to the same minimum
        step = 1 / np.linalg.norm(plain.T @ plain, 2)
        for _ in range(20_000):
            y = np.maximum(0, y - step * (plain.T @ (plain @ y - target)))
        assert mine <= np.sum((plain @ y - target) ** 2) * 1.001 + 1


def test_plans_use_every_piece_once():
    rng = random.Random(4)
    counts = {rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(200)} | {2048: 7, 1: 3}
    used: dict[int, int] = {}
    for parts, times in packing.plan(dict(counts)):
        assert sum(n * m for n, m in parts) <= 2048 and times > 0
        for n, m in parts:
            used[n] = used.get(n, 0) + m * times
    assert used == counts
