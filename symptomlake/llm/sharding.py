"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row ``r`` of ``n`` goes to ``p = permute(r)``; its shard is ``p % shards`` and its slot ``p // shards``. Shard and slot
of any row, and the row of any shard and slot (``row_of``), follow from ``r``, ``n`` and the key alone, without a look
at other rows. Shards differ by at most one row.

Nulls and edges: a null text has size 16 and CRC 0; null ids sort first; rows with equal ids are ordered by CRC and
size, and fully equal rows are interchangeable; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import order

#: Round multipliers below 2**31, so that products of 31-bit halves stay inside 62 bits.
MULTIPLIERS = (1_597_334_677, 1_566_083_941, 1_103_515_245, 1_431_655_781)
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round_keys(key: int) -> list[int]:
    out, x = [], key & 0x7FFFFFFF
    for k in range(ROUNDS):
        x = (x * MULTIPLIERS[k % 4] + 12_345 + k) & 0x7FFFFFFF
        out.append(x)
    return out


def _f(half: np.ndarray, k: int, round_key: int, mask: np.uint64) -> np.ndarray:
    x = (half ^ np.uint64(round_key)) & np.uint64(0x7FFFFFFF)
    for c in (MULTIPLIERS[k % 4], MULTIPLIERS[(k + 1) % 4]):
        x = (x * np.uint64(c)) & np.uint64(0x7FFFFFFF)
        x ^= x >> np.uint64(15)
    return x & mask


def _feistel(x: np.ndarray, bits: int, key: int, inverse: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for k, round_key in (list(enumerate(_round_keys(key)))[::-1] if inverse else enumerate(_round_keys(key))):
        if inverse:
            left, right = right ^ _f(left, k, round_key, mask), left
        else:
            left, right = right, left ^ _f(right, k, round_key, mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, key: int = 0, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. n-1 (or its inverse): values outside walk on along their cycle until they are inside."""
    bits = _half_bits(n)
    out = _feistel(np.asarray(x, np.uint64), bits, key, inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _feistel(out[outside], bits, key, inverse)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def row_of(shard: int, slot: int, n: int, shards: int, key: int = 0) -> int:
    """The row number that lies in ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), n, key, inverse=True)[0])


def permuted(row: Column, n: Column, key: int = 0) -> Column:
    @F.pandas_udf("long")
    def run(rows: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), int(total.iloc[0]), key) if len(rows) else [], dtype="int64")
    return run(row, n)


def shard_rows(docs: DataFrame, shards: int = 40, key: int = 20_240_229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row of ``docs``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    numbers = order.numbered(rows, "doc_id", "text_crc32", "size")
    p = numbers.withColumn("_p", permuted(F.col("row_number"), F.col("n_rows"), key))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("_p") % shards).cast("int").alias("shard"),
                    F.expr(f"_p div {int(shards)}").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "row_number")
