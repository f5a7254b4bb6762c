"""Exact rounding against Python's own round() over every small sum and count."""

from decimal import Decimal
from fractions import Fraction

import pytest
from symptomlake.functions import rounding


@pytest.mark.parametrize("digits,top", [(1, 5), (2, 3)])
def test_matches_python_round(spark, digits, top):
    pairs = [(t, n) for n in range(1, 130) for t in range(0, top * n + 1)]
    df = spark.createDataFrame(pairs, "t long, n long")
    got = df.select("t", "n", rounding.mean_rounded("t", "n", digits).alias("m")).collect()
    assert len(got) == len(pairs)
    assert [(r.t, r.n) for r in got if r.m != round(r.t / r.n, digits)] == []


def test_fixed_point_display_rounds_exact_ties_up(spark):
    pairs = [(t, n) for n in range(1, 60) for t in range(0, 5 * n + 1)]

    def shown(t, n):
        exact = Fraction(t / n)          # the binary value that gets printed
        tenths, rest = divmod(exact * 10, 1)
        return float(Decimal(int(tenths) + (1 if rest >= Fraction(1, 2) else 0)) / 10)

    df = spark.createDataFrame(pairs, "t long, n long")
    got = df.select("t", "n", rounding.mean_rounded("t", "n", 1, "up").alias("m")).collect()
    assert [(r.t, r.n, r.m) for r in got if r.m != shown(r.t, r.n)] == []


def test_empty_group_is_null(spark):
    row = spark.createDataFrame([(0, 0)], "t long, n long").select(
        rounding.mean_rounded("t", "n").alias("m")).first()
    assert row.m is None
