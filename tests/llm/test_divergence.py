import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from symptomlake.llm import divergence, transducer


def some_terms(seed, n, letters="abcé", longest=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).encode() for _ in range(n)})


def places(found, terms):
    at = np.cumsum([0, *map(len, terms)])
    return found.places(np.frombuffer(b"".join(terms), np.uint8), at[:-1], at[1:]).tolist()


@pytest.mark.parametrize("n, letters", [(1, "a"), (5, "ab"), (400, "abcé"), (3000, "abcdefghijklmnopqrstuvwxyz日本語éèß")])
def test_places_are_lexicographic(n, letters):
    terms = some_terms(n, n, letters)
    found = transducer.Transducer.unpacked(transducer.build(terms).packed())
    assert places(found, terms) == list(range(len(terms)))
    others = [t for t in some_terms(n + 1, 300, letters + "xz") + [b"", b"q", terms[0] + b"~", terms[-1][:-1]] if t not in set(terms)]
    assert places(found, others) == [-1] * len(others)


def test_it_is_minimal():
    """As many states as there are different sets of endings."""
    terms = some_terms(3, 500, "abc", 6)
    endings = defaultdict(set)
    for t in terms:
        for k in range(len(t) + 1):
            endings[t[:k]].add(t[k:])
    assert transducer.build(terms).states == len({frozenset(e) for e in endings.values()})


def test_no_terms():
    assert places(transducer.build([]), [b"", b"a"]) == [-1, -1]


def plain(rows, top=200):
    """The contract by plain loops; rows are (lang, source, text)."""
    words = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in words}:
        own = [(s, w) for g, s, w in words if g == lang]
        held = Counter(t for _, w in own for t in set(w))
        kept = sorted((t for t in held if held[t] >= 3), key=str.encode)
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(t for t in w if held[t] >= 3)

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}

        def f(x, y):
            return (x - y) * (x - y) // y
        for s in counts:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def documents(seed=1, n=240):
    rng = random.Random(seed)
    word = ["Alpha", "beta", "ÄTHER", "naïve", "x", "日本", "co-op", "don't", "[z]", "mixed1digit"] + [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "ß", "web", None]),
             " ".join(rng.choice(word[:rng.randint(2, len(word))]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("fr", "a", "seul"), ("fr", "b", None), ("fr", "a", ""), ("it", "only", "uno due uno"), *[("es", "hot", "una vez más")] * 40, ("es", "b", "vez")]


@pytest.mark.parametrize("shard, group", [(1 << 20, 64 << 20), (200, 3000)])
def test_against_brute_force(spark, monkeypatch, shard, group):
    """Also with many shards and several passes."""
    monkeypatch.setattr(divergence.vocabulary, "__defaults__", (shard,))
    monkeypatch.setattr(divergence.recounted, "__defaults__", (group,))
    rows = documents()
    docs = spark.createDataFrame([(k, t, g, s, "x", 1) for k, (g, s, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n int")
    got = divergence.audit(docs, top=20)
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in got.collect()) == plain(rows, 20)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_edges(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two")], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.where("false")).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = ("Ab cdé " * 50 + "x" * 400 + " 7y").encode()
    want = divergence.document_terms(text)
    monkeypatch.setattr(divergence.arrays.pieces, "__defaults__", (40,))
    assert divergence.document_terms(text) == want == {b"ab", "cdé".encode(), b"x" * 400, b"y"}


def test_shares_are_exact():
    n, under = np.array([0, 5, 10**12, 3 * 10**18]), np.array([7, 7, 3 * 10**12, 4 * 10**18])
    assert divergence.shares(n, under).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, under)]


def test_the_first_of_a_task():
    rng = np.random.default_rng(2)
    first = divergence._First(3)
    rows = [(int(g), int(o), int(v)) for g, o, v in zip(rng.integers(0, 4, 300), rng.permutation(300), rng.integers(0, 9, 300))]
    for k in range(0, 300, 50):
        first.add(*(np.array(c) for c in zip(*rows[k:k + 50])))
        first.rows()
    want = [r for g in range(4) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:3]]
    assert list(zip(*(x.tolist() for x in first.rows()))) == want
