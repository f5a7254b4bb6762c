"""Exact decimal rounding of a mean given as integer sum and count.

A mean is rounded to ``digits`` from its integer parts, so the result does not
depend on summation order. Decimal ties are resolved the way IEEE doubles
print: by the binary value of ``total / n`` and, when that is exactly halfway,
to the even digit (``ties="even"``) or upwards (``ties="up"``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean_scaled(total: str, n: str, digits: int = 1, ties: str = "even") -> str:
    """Expression text of the rounded mean times ``10**digits`` as a long.

    ``total`` and ``n`` are expressions; null when there is nothing to average.
    Exact for non-negative means below 128 with one or two digits: a tie is
    compared with the binary mean in 64-bit arithmetic. The mean is scaled by
    the power of two that makes its 53-bit significand an integer.
    """
    step = 2 * 10**digits
    mean = f"(CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE))"
    scale = "CASE " + " ".join(f"WHEN {mean} >= {2.0**e}D THEN {2**(52 - e)}L" for e in range(6, -8, -1)) \
        + f" ELSE {2**60}L END"
    twice = f"({step}L * {total})"
    q = f"({twice} DIV {n})"
    off = f"(CAST({mean} * CAST({scale} AS DOUBLE) AS BIGINT) * {step}L - {q} * {scale})"
    down, up = f"({q} DIV 2)", f"(({q} + 1) DIV 2)"
    half = up if ties == "up" else f"CASE WHEN {down} % 2 = 0 THEN {down} ELSE {up} END"
    tie = f"CASE WHEN {off} > 0 THEN {up} WHEN {off} < 0 THEN {down} ELSE {half} END"
    return (f"CASE WHEN {n} > 0 THEN CASE WHEN {twice} % {n} = 0 AND {q} % 2 = 1 THEN {tie} "
            f"ELSE {up} END END")


def mean_rounded(total: str, n: str, digits: int = 1, ties: str = "even") -> Column:
    """Rounded mean as a double; null when there is nothing to average."""
    return F.expr(f"({mean_scaled(total, n, digits, ties)}) / {float(10**digits)}D")


def ratio(total: Column, n: Column) -> Column:
    """Unrounded mean, null for an empty group."""
    return F.when(n > 0, total.cast("double") / n.cast("double"))
