import random
import re

import numpy as np
import pyarrow as pa
import pytest

from symptomlake.llm import minhash
from symptomlake.llm.components import components


def brute(rows, n, over):
    """doc_id -> (set size, least id reachable)."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= over * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, base, n, most):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("n, over", [(3, 85), (5, 80)])
def test_against_brute_force(spark, n, over):
    rng = random.Random(over)
    texts = []
    for size, count, most in ((120, 60, 12), (40, 25, 4), (400, 12, 20)):  # families around the threshold
        texts += family(rng, [f"b{rng.randrange(10**6)}" for _ in range(size)], count, most)
    texts += ["One two", "one TWO", "one", "", None, "\t \n", "lone words never shared", "ONE two"] + [texts[0]] * 40
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.Links(n, over)).collect()}
    assert got == {i: (k, c, c == i) for i, (k, c) in brute(rows, n, over).items()}


def test_large_blocks(spark, monkeypatch):
    """A family that fills several blocks gives the same as brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(3)
    rows = list(enumerate(family(rng, [f"b{k}" for k in range(100)], 90, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, minhash.Links(3, 85)).collect()}
    assert got == brute(rows, 3, 85)


def test_estimate():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.9):
        base = rng.integers(0, 2**63, 4000).astype(np.uint64)
        k = int(len(base) * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 2**63, len(base) - k).astype(np.uint64)])
        a, b = (np.frombuffer(minhash.pack(minhash.minima(x)), np.uint8) for x in (base, other))
        assert abs(float(minhash.estimate(a, b)) - share) < 0.12
        assert len(a) * 8 >= minhash.B * minhash.K


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_with_a_crowded_node(spark):
    """A hub of many links, given in both directions and repeated, a path that ends in it, and links at random."""
    rng = random.Random(11)
    rows = [(5000, k) for k in range(1000, 3000)] + [(k, 5000) for k in range(1000, 1500)]
    rows += [(k, k + 1) for k in range(980, 1000)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(220)]
    up = {k: k for pair in rows for k in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in rows:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: find(k) for pair in rows if pair[0] != pair[1] for k in pair}
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_bit_table(spark, monkeypatch):
    """Every id put in is found, null too; the table grows with the ids up to its bound."""
    monkeypatch.setattr(minhash, "TABLE_BITS", (10, 14))
    rng = random.Random(12)
    ids = [None, 0, -1, 2**63 - 1, -2**63] + [rng.randrange(-2**63, 2**63) for _ in range(600)]
    tables = {n: minhash._bits(spark.createDataFrame([(i,) for i in ids[:n]], "doc_id long")) for n in (0, 5, 200, 605)}
    assert {n: t.power for n, t in tables.items()} == {0: 10, 5: 10, 200: 12, 605: 14}
    for n, t in tables.items():
        assert len(t.table) == 1 << t.power >> 3
        assert t.has(pa.array(ids[:n], pa.int64())).all()
    others = pa.array([rng.randrange(-2**63, 2**63) for _ in range(2000)], pa.int64())
    assert not tables[0].has(others).any() and tables[605].has(others).mean() < 0.07


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "q")],
                                 "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 2, True)], key=str)
    assert sorted(r.doc_id or 0 for r in minhash.keep_one(docs).collect()) == [0, 1, 2]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_keep_one_tells_documents_apart(spark):
    """Documents that share an id, or have none, stay unless they are equal to or linked with one that stays."""
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "other words that nobody has here"), (None, None), (None, ""), (None, ""),
            (5, "one two three four five"), (5, "ONE two three four five"), (5, "six seven eight nine ten eleven"), (5, ""), (5, None),
            (7, "six seven eight nine ten eleven"), (3, "p q r s t u v"), (7, "p q r s t u v"), (8, "q")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text if r.text is None else r.text.lower()) for r in out.collect()), key=str)
    assert got == sorted([(None, "a b c d e f"), (None, "other words that nobody has here"), (None, None), (None, ""),
                          (5, "one two three four five"), (5, "six seven eight nine ten eleven"), (5, ""), (5, None),
                          (3, "p q r s t u v"), (8, "q")], key=str)
