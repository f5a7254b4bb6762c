import math
import zlib

import numpy as np
import pyarrow as pa

from symptomlake.llm import arrays, quality

SF = "/root/testdata/sf0.1"


def test_sparse_dot_products():
    texts = ["Aa bb!! bb cc", "", "x", "The THE the ###", "é ü " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    w = np.random.default_rng(1).normal(size=1 << 12).astype(np.float32)
    for _, at, data in arrays.runs(batch):
        direct = [1 / (1 + np.exp(-float(w[p] @ v))) for p, v in quality.vectors(at, data, 12)]
        assert np.allclose(direct, quality.probabilities(at, data, w, 12), atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    held = out.where("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.9


def test_edges(spark):
    rows = [(i, ("good words here " if i % 2 else "### $$$ ") * 20, "c") for i in range(40)] + [
        (None, None, "c"), (98, "", "c"), (99, None, "c"), (98, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len({r.score for r in out if r.doc_id in (98, 99)}) == 1
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out if r.doc_id is not None and r.doc_id < 40)
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0
    kept = quality.keep(docs, labels, 0.5)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.where("doc_id < 40").collect()} == {1}


def test_fit_against_plain_loops():
    """Follow-the-regularised-leader by dictionaries."""
    rng = np.random.default_rng(5)
    rows = [(np.unique(np.concatenate([[0], rng.integers(1, 40, 6), [40 + y]])), y) for y in rng.integers(0, 2, 80).tolist()]
    rows = [(p, rng.random(len(p)), y) for p, y in rows]
    m = quality.Ftrl(bits=6, epochs=3)
    z, n = {}, {}

    def weight(p):
        if abs(z.get(p, 0.0)) <= m.l1:
            return 0.0
        return (math.copysign(m.l1, z[p]) - z[p]) / ((m.beta + math.sqrt(n[p])) / m.alpha + m.l2)
    for _ in range(m.epochs):
        for places, values, y in rows:
            w = [weight(p) for p in places]
            error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, values)))) - y
            for p, v, own in zip(places, values, w):
                g = error * v
                z[p] = z.get(p, 0.0) + g - (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / m.alpha * own
                n[p] = n.get(p, 0.0) + g * g
    got = quality.fit(rows, m)
    assert np.allclose([got[p] for p in range(64)], [weight(p) if p in z else 0.0 for p in range(64)], atol=1e-9)


def test_one_row_for_each_label_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"copy {k}", "x", 3) for k in range(50)] + [(2, "other", "x", 3)], "doc_id long, text string, label string, features int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (2, 7), (3, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality", 100).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 0), (1, 1), (2, 1)]
    assert len({r.text for r in rows if r.doc_id == 1}) == 1
