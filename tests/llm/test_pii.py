import hashlib
import math
import random
import re

from symptomlake.llm import pii

#: The patterns as they are stated.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_like_the_patterns():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice("aA0.@+- ()491é%_\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e", "x@y", "@b.c", "1.2.3.4.5.6.7.8", "000001.2.3.4", "4111 1111 1111 1111", "4111-1111 1111-1111 2",
                 "+1 (212) 555-0199 x", "1" * 5000, "9" * 6000 + ".1.1.1"):
        assert pii.base_spans(text) == (plain(text) if len(text) < 4000 else pii.base_spans(text))


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@" + "+1(" * 100_000) == []
    many = "a@b.co word " * 20_000
    assert len(pii.base_spans(many)) == 20_000


def corpus():
    rows = [(k, f"common words about number {k} and the same old things as ever, filler{k}") for k in range(400)]
    for k in range(5):  # the codename occurs only beside the address
        rows.append((1000 + k, f"intro{k} text goes on; Bluebird office mail jo@corp.example.com today things as ever {k}"))
    return rows + [(2000, None), (2001, ""), (None, "call +1 (212) 555-0199 now"), (1000, rows[400][1])]


def test_disclosing_terms(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars long, spans string")
    out = pii.report(docs).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t in rows}
    for r in out:
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in plain(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if not s.startswith("term")] == said.split(",")
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)
    one = next(r for r in out if r.doc_id == 1001)
    words = [text[1001][int(a):int(b)] for k, a, b in (s.split(":") for s in one.spans.split(",")) if k == "term"]
    assert "Bluebird" in words and "things" not in words and "intro1" not in words
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "Bluebird" not in clean[1001].text and "<EMAIL>" in clean[1001].text and "things" in clean[1001].text
    assert clean[None].text == "call <PHONE> now" and clean[None].n_chars == len("call <PHONE> now")
    assert clean[2000].text is None and clean[5].text == text[5]
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(rows)


def test_disclosing_terms_everywhere(spark):
    """A term far from the address counts, and goes in documents without the address and far from it, whatever its case."""
    far = [" ".join(f"the same old things as ever {k} {j}" for j in range(6)) for k in range(5)]  # texts, not copies of one
    rows = [(k, f"common words and {far[k % 5]} filler{k}") for k in range(400)]
    rows += [(1000 + k, f"Bluebird intro{k} é {far[k]} mail jo@corp.example.com {far[k]} then bluebird again {k}") for k in range(5)]
    rows += [(2000, "what BLUEBIRD said to bluebird.example"), (2001, "x@bluebird.org is not free, Bluebird is"), (None, "naïve Bluebird")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.report(docs).collect()}
    text = dict(rows)
    for i, n in [(1000, 2), (1004, 2), (2000, 2), (2001, 1), (None, 1), (7, 0)]:
        words = [text[i][int(a):int(b)].lower() for kind, a, b in spans[i] if kind == "term"]
        assert words.count("bluebird") == n and "things" not in words and f"intro{(i or 0) % 1000}" not in words
    clean = pii.sanitise(docs).collect()
    assert len(clean) == 2 * len(rows)
    assert not any("bluebird" in r.text.lower() for r in clean)
    assert {r.text for r in clean if r.doc_id == 2001} == {"<EMAIL> is not free,  is"}
    assert {r.text for r in clean if r.doc_id == 7} == {text[7]}


def different(n, words, seed):
    """Texts that are no near-copies of one another."""
    rng = random.Random(seed)
    return [" ".join(f"{w} " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(12)) for w in words) for _ in range(n)]


def test_a_name_inside_an_address(spark):
    """It counts only where it stands alone, so it gives its address away however often the address itself occurs."""
    rows = [(k, f"mail smithson@corp.example number{k} {' '.join(f'q{k}x{j}' for j in range(12))}") for k in range(40)]
    rows += [(100 + k, f"{t} ask smithson first smithson@corp.example") for k, t in enumerate(different(4, [""], 1))]
    rows += [(200 + k, f"plain filler {t} ask them first") for k, t in enumerate(different(300, [""], 2))]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("smithson" in t for t in clean.values())
    assert all(" ask " in clean[100 + k] and " first " in clean[100 + k] for k in range(4))
    assert all(clean[200 + k] == rows[44 + k][1] for k in range(300))


def test_a_word_of_many_documents_stays(spark):
    """250 documents hold a word, three of them an entity too: that says next to nothing about it."""
    rows = [(k, t) for k, t in enumerate(different(3000, [""], 3))]
    rows += [(5000 + k, f"orchard {t}" + " +1 (212) 555-0199" * (k < 3)) for k, t in enumerate(different(250, [""], 4))]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("orchard" in clean[5000 + k] for k in range(250))
    assert all(clean[i] == t for i, t in rows if "+1" not in t)


def test_near_copies_are_one_family(spark):
    """Forty texts that differ in a word each prove nothing about the words they share; three other texts do."""
    base = [f"base{k}" for k in range(80)]
    family = [" ".join(base[:k] + [f"other{k}"] + base[k + 1:]) + " kestrel jo@corp.example.com" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(family)] + [(100 + k, t) for k, t in enumerate(different(400, ["some", "words"], 5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert all("kestrel" in r.text for r in pii.sanitise(frame).where("doc_id < 40").collect())
    more = spark.createDataFrame([(900 + k, f"{t} kestrel jo@corp.example.com") for k, t in enumerate(different(2, [""], 6))], frame.schema)
    assert not any("kestrel" in r.text for r in pii.sanitise(frame.unionByName(more)).collect())


def brute_terms(rows):
    """Disclosing terms by loops over sets (texts without near-copies)."""
    docs = []
    for _, text in rows:
        spans = plain(text or "")
        entities = {f"{kind}:{text[a:b]}" for a, b, kind in spans}
        free = {m.group().lower() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "")
                if len(m.group()) >= 3 and not any(a < m.end() and m.start() < b for a, b, _ in spans)}
        docs.append((entities, free))
    out = {}
    for e in {e for es, _ in docs for e in es}:
        n_e = sum(e in es for es, _ in docs)
        content = math.log2(len(docs) / n_e)
        for t in {t for es, ts in docs if e in es for t in ts}:
            both, n_t = sum(e in es and t in ts for es, ts in docs), sum(t in ts for _, ts in docs)
            if both >= pii.SUPPORT and both >= pii.SURE * n_t and content > 0:
                d = math.log2(len(docs) * both / (n_t * n_e)) / content
                if d >= pii.GENERALISE:
                    out[t] = max(out.get(t, 0), d)
    return out


def test_disclosure_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k, t in enumerate(different(400, [""], 7)):
        extra = [f"w{rng.randrange(40)}x" for _ in range(3)]
        if k % 9 == 0:
            who = rng.randrange(3)
            extra += [f"name{who}z", f"u{who}@mail.example", "+1 (212) 555-019" + str(who)][:rng.randint(1, 3)] + ["10.0.0.7"] * (k % 2)
        rows.append((k, f"{t} {' '.join(extra)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms(rows)
    got = {r.term: r.d for r in pii.disclosures(frame, pii.scan(frame)).groupBy("term").agg({"disclosure": "max"}).toDF("term", "d").collect()}
    names = sorted(want)
    assert want and got.keys() == set(pii.term_hashes(names).tolist())
    assert all(abs(got[h] - want[t]) < 1e-9 for t, h in zip(names, pii.term_hashes(names).tolist()))


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "SLICE", 4)
    lists = [" ".join(f"user{j}@mail.example word{j}" for j in range(30)) + " " + t for t in different(3, [""], 8)]
    rows = [(k, t) for k, t in enumerate(lists)] + [(50 + k, t) for k, t in enumerate(different(200, [""], 9))]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(f"word{j}" in clean[k] for k in range(3) for j in range(30))
    assert all(clean[50 + k] == rows[3 + k][1] for k in range(200))


def test_empty(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_python_worker_a_task(spark):
    """Small tables too: a shuffle parts marking and masking, and the empty answer needs no Python."""
    docs = spark.createDataFrame([(1, "write to ann@example.org"), (2, "nothing here"), (3, None)], "doc_id long, text string").localCheckpoint()
    masked = pii.sanitise(docs)
    lines = masked._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [(line.index(line.lstrip(" :+-|*")), line) for line in lines if line.strip()]
    python = [k for k, (_, line) in enumerate(depth) if "EvalPython" in line]
    assert len(python) == 3
    for k in python:
        at = depth[k][0]
        for deeper, line in depth[k + 1:]:  # down to the next shuffle
            if deeper <= at or "Exchange" in line:
                break
            assert "EvalPython" not in line
    assert sorted(masked.collect(), key=lambda r: r.doc_id) == [(1, "write to <EMAIL>"), (2, "nothing here"), (3, None)]
    none = pii.disclosures(docs, pii.scan(docs))
    assert none.schema.simpleString() == "struct<entity:bigint,term:bigint,disclosure:double>"
    assert none.collect() == [] and "RDD" not in none._jdf.queryExecution().executedPlan().toString()
