import zlib
from collections import Counter

import numpy as np
import pytest

from symptomlake.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    p = sharding.permute(np.arange(n), n, key=7)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, key=7, inverse=True) == np.arange(n)).all()


def test_another_key_is_another_order():
    a, b = (sharding.permute(np.arange(1000), 1000, key=k) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_whole_rows(spark):
    rows = [(i, "x" * i if i % 7 else None, 9) for i in range(203)] + [(5, "xxxxx", 9)] * 30 + [(None, "n", 1), (None, None, 1)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int"), shards=40).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert sharding.row_of(r.shard, r.slot, len(rows), 40, 20_240_229) == r.row_number
    assert len(by) == 40 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
