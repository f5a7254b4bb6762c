import re

from symptomlake.llm import decontam


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            q, both = len(shingles(item)), len(shingles(item) & shingles(text))
            if d is not None and i is not None and q and both * 5 >= q * 4:
                out[d, i] = (both, q)
    return out


def test_against_brute_force(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(6 + k))) for k in range(0, 60, 5)] + [
        (90, "short one"), (91, ""), (92, None), (None, "a b c d e f"), (93, "Same words, in: the SHORT item!"), (94, "i5w0 i5w1 i5w2 i5w3 i5w4 i5w5")]
    docs = [(0, "nothing here at all for anyone")]
    for k in range(0, 60, 5):
        text = items[k // 5][1].split()
        for cut in range(0, len(text), max(1, len(text) // 6)):  # from whole to hardly any of the item
            docs.append((len(docs), "before " * 300 + " ".join(text[cut:]) + " after" * 300))
    docs += [(900, None), (901, ""), (902, "short one"), (903, "Short ONE!"), (904, "a short one is here now"),
             (905, "x same, WORDS in the short item y"), (None, items[3][1])] + [(906, items[4][1])] * 20
    got = decontam.matches(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, q int"),
                           spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.shared, r.q) for r in got.collect()} == brute(docs, items)
    clean = decontam.clean(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"))
    dirty = {d for d, _ in brute(docs, items)}
    assert clean.count() == sum(d not in dirty for d, _ in docs)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k + j}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"w{k + j}" for j in range(12))) for k in range(40)], "item_id long, text string")
    sent = sorted(decontam.matches(docs, items).collect())
    monkeypatch.setattr(decontam, "SENT_ROWS", 0)
    assert sorted(decontam.matches(docs, items).collect()) == sent and len(sent) > 100


def test_empty_and_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    out = decontam.matches(docs, items)
    assert out.count() == 0
    assert decontam.matches(docs, items.where("false")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_rows_without_id_are_searched(spark):
    item = " ".join(f"w{k}" for k in range(12))
    rows = [(None, f"before {item} after"), (None, "clean words of no item at all"), (None, None), (None, ""), (1, item), (1, "same id"),
            (2, "clean words of no item at all"), (None, "w0 w1 w2 w3 w4 w5 only half")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, q int")
    out = decontam.clean_rows(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(rows[1:4] + rows[6:], key=str)


def test_rows_of_one_id_count_together(spark):
    """Two rows with 46 and 54 of an item's 100 shingles hold it together, however small each is; two others do not."""
    words = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(words[:50])), (1, " ".join(words[46:])), (2, " ".join(words[:50])), (2, " ".join(words[:60])), (3, "x " + " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.q) for r in decontam.matches(docs, items).collect()}
    assert got == {(1, 7): (100, 100), (3, 7): (100, 100)}


def test_a_lead_that_items_share(spark):
    """A common lead is no minimum of items that have other shingles, and nothing is lost."""
    lead = "read the passage below and answer"
    items = [(k, f"{lead} " + " ".join(f"i{k}w{j}" for j in range(40))) for k in range(60)]
    docs = [(k, f"{lead} " + " ".join(f"d{k}w{j}" for j in range(60))) for k in range(50)] + [(100 + k, f"say {t} now") for k, t in items[:9]]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.shared, r.q) for r in decontam.matches(*frames).collect()} == brute(docs, items)
    held = decontam.item_shingles(frames[1]).where("minimum").groupBy("shingle").count()
    assert held.agg({"count": "max"}).first()[0] == 1
