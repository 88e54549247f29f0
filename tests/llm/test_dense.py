"""The driver's own arithmetic: right, and never stuck beside a running JVM."""

import time

import numpy as np
import pytest

from tierloom.llm import dense, packing


def test_inverse_and_solution(spark):
    random = np.random.default_rng(3)
    for n in (1, 2, 17, 250):
        matrix, right = random.integers(-3, 4, (n, n)) + 9.0 * np.eye(n), random.random(n)
        assert np.allclose((dense.inverse(matrix)[:, :, None] * matrix[None]).sum(axis=1), np.eye(n), atol=1e-8)
        assert np.allclose((matrix * dense.solve(matrix, right)).sum(axis=1), right)
    assert dense.inverse(np.array([[0.0, 2.0], [4.0, 0.0]])).tolist() == [[0, 0.25], [0.5, 0]]
    with pytest.raises(ValueError):
        dense.inverse(np.zeros((2, 2)))


def test_a_whole_histogram_is_packed_beside_the_jvm(spark):
    assert spark.range(10).count() == 10
    random = np.random.default_rng(5)
    lengths = np.clip(random.lognormal(6, 0.9, 15_000).astype(int), 1, 1024)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert len(histogram) > 900
    began = time.time()
    runs = packing.pack_histogram(histogram, 1024)
    assert time.time() - began < 30
    packed: dict[int, int] = {}
    for run in runs:
        assert sum(run.lengths) <= 1024
        for n in run.lengths:
            packed[n] = packed.get(n, 0) + run.count
    assert packed == histogram
    over = sum(c for n, c in histogram.items() if n > 512)  # no two of these share a sequence
    assert sum(r.count for r in runs) <= 1.005 * max(over, sum(n * c for n, c in histogram.items()) / 1024)
