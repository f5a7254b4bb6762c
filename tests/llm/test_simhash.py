import random
import re

import numpy as np
import pytest
import xxhash

from symptomlake.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """doc_id -> (fingerprint, least id reachable)."""
    prints = {i: plain_print(t) for i, t in rows}
    return {i: (f"{prints[i]:016x}", c) for i, c in reach(prints).items()}


def reach(prints):
    up = {i: i for i in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(prints)
    value = np.array([prints[i] for i in ids], np.uint64)
    for k, a in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(value[k + 1:] ^ value[k]) <= 3):
            x, y = sorted((find(a), find(ids[k + 1 + j])))
            up[y] = x
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(5)
    out = ["", None, " \t", "One two", "one  TWO", "x", "Straße ÀB c", "straße Àb C", "a\x0bb\x0cc\x1cd e"]
    for size, copies in ((400, 25), (60, 30), (12, 20)):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(size)] = f"v{rng.randrange(10**5)}"
            out.append(" ".join(words))
    return out + [out[-1]] * 30


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got == want
    assert 10 < len({c for _, c in want.values()}) < len(want) - 60  # some are linked, others not


@pytest.mark.parametrize("cell", [1024, 8, 2])
def test_links_of_crowded_cells(spark, cell):
    """Fingerprints that crowd around a few centres, so that cells are cut at every level."""
    rng = random.Random(cell)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    low = rng.getrandbits(63)
    values |= {low ^ rng.getrandbits(11) << 20 for _ in range(200)}  # one half in common, close to one another
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.components(simhash.links(frame, cell)).collect()
    want = reach({k: int(np.int64(x).view(np.uint64)) for k, x in enumerate(signed)})
    groups = {}
    for k, c in want.items():
        groups.setdefault(c, set()).add(signed[k])
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_pieces_of_long_texts(monkeypatch):
    words = [f"w{k % 37}{'y' * (k % 11)}" for k in range(3000)]
    text = "  ".join(words).encode()
    want = simhash.fingerprint(text)
    assert want == plain_print(text.decode())
    monkeypatch.setattr(simhash, "pieces", lambda raw, gap, cut=simhash.pieces: cut(raw, gap, 50))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b"One two") == plain_print("one two")


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words are here now"), (9, None), (2, "")],
                                 "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 2), (2, 2)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
