import math
import random

import numpy as np
import pytest

from symptomlake.llm import negatives


def plain(rows, noisy=True):
    """The contract by loops over Python's whole numbers."""
    live = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        if noisy and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        live.append((k, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for k, i, label, v in live:
        if i is None or i % 50:
            continue
        met = sorted(((-sum(x * y for x, y in zip(v, w)), math.inf if j is None else j, m, own) for m, j, own, w in live if m != k),
                     key=lambda x: x[:3])
        for s, j, _, own in [x for x in met if x[3] == label][:5]:
            s = -s
            fit = [(-t, n) for t, n, _, other in met if other != label and 50 * s <= -100 * t <= 95 * s][:3]
            out += [(i, None if j == math.inf else j, r, None if n == math.inf else n, s, t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(frame):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, row string, i int")


@pytest.mark.parametrize("size", [1.0, 30.0, 4e5])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "TILE", 3)
    rng = np.random.default_rng(int(size))
    centre = rng.normal(size=12)
    rows = [(k, (size * (centre + rng.normal(size=12))).round(2).tolist(), k % 4) for k in range(300)]
    rows += [(50, rows[7][1], 3)] * 3 + [(None, rows[8][1], 0), (None, rows[8][1], 1)]
    rows += [(1000, rows[3][1][:5], 2), (1050, [], 1), (1100, None, 1), (1150, [1.0, None], 1), (1200, [math.nan], 1),
             (1250, [math.inf, 1.0], 2), (1300, [1.0], None), (1350, [1e308], 2)]
    rows += [(2000 + k, rows[20][1], k % 2) for k in range(40)]  # ties
    want = plain(rows)
    assert len(want) > 50
    assert got(negatives.mine(frame(spark, rows), noisy=True)) == want
    assert got(negatives.mine(frame(spark, rows[:120]))) == plain(rows[:120], noisy=False)


def test_empty_and_alone(spark):
    assert got(negatives.mine(frame(spark, [(50, [1.0], 1)]))) == []
    assert got(negatives.mine(frame(spark, [(50, [1.0], 1)]).where("false"))) == []
    assert got(negatives.mine(frame(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]))) == [(50, 51, 1, 52, 0, 0)]


@pytest.mark.parametrize("dims, most", [(1, 3), (64, 135), (64, 2**20), (700, 2**22), (9000, 10**5), (9000, 1)])
def test_residue_scores_are_exact(dims, most):
    rng = np.random.default_rng(dims)
    x, y = (rng.integers(-most, most + 1, (5, dims)) for _ in range(2))
    x[0], y[0] = most, -most
    primes = negatives.primes_for(dims, most)
    assert math.prod(primes) > 2 * dims * most * most
    assert all((p // 2) ** 2 * min(dims, negatives.DIMS) < 2**24 and all(p % q for q in range(2, p)) for p in primes)
    found = negatives.scores(*(negatives.residues(m.astype(float), primes) for m in (x, y)), primes)
    assert found.tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]


def test_residues_of_huge_components():
    """Components beyond 64 bits still give the exact score where that has a value."""
    x, y = np.array([[2.0**70, 3.0]]), np.array([[0.0, 5.0]])
    primes = negatives.primes_for(2, 2**70)
    assert negatives.scores(negatives.residues(x, primes), negatives.residues(y, primes), primes).tolist() == [[15]]


def test_allowed():
    rng = random.Random(1)
    for s in [0, 1, -1, -7, 2**61] + [rng.randrange(10**6) for _ in range(200)]:
        low, high = negatives.allowed(s, negatives.Mining())
        assert 50 * s <= 100 * low < 50 * s + 100 and 95 * s - 100 < 100 * high <= 95 * s
