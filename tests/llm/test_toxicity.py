import math

import numpy as np

from symptomlake.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_ordered_thresholds_and_shared_weights():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        grade = int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))
        rows.append((np.unique(np.concatenate([rng.integers(100, 900, 30), np.arange(grade * 4)])), grade))
    w, cut = toxicity.fit(rows, toxicity.Ordinal(bits=10))
    assert (np.diff(cut) >= 0).all()
    level = [np.mean([1 / (1 + np.exp(cut - w[p].sum())) for p, g in rows if g == k], axis=0).sum() for k in range(4)]
    assert (np.diff(level) > 0.3).all()


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels)
    held = out.where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    bad, good = ([r.p_toxic for r in held if r.label == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert np.mean([r.toxic for r in held if r.label == 0]) < 0.02
    assert np.mean([r.toxic for r in held if r.label == 1]) > 0.75
    assert all(abs(r.p_toxic) <= 1 and r.p_toxic - 1e-6 <= r.expected_severity <= 3 * r.p_toxic + 1e-6 for r in held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "bad words", 5), (2, None, 5), (None, "", 5), (1, "bad words", 5)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == 4 and {(r.expected_severity, r.toxic) for r in out} == {(0.0, 0)}
    assert toxicity.score(docs.where("false"), labels).count() == 0


def plain_fit(rows, m):
    """The model by loops over dictionaries; slopes are differences of the log-likelihood, not derived."""
    held = {}
    for places, _ in rows:
        for p in places:
            held[p] = held.get(p, 0) + 1
    worth = {p: min(1.0, toxicity.COMMON * len(rows) / c) for p, c in held.items()}
    penalty = m.l1 * len(rows) ** 0.5
    z, n = dict.fromkeys(held, 0.0), dict.fromkeys(held, 0.0)

    def weight(p):
        if abs(z[p]) <= penalty:
            return 0.0
        return (math.copysign(penalty, z[p]) - z[p]) / ((m.beta + math.sqrt(n[p])) / m.alpha + m.l2)

    def loss(margin, cut, grade):
        upto = [0.0, *(1 / (1 + math.exp(-(c - margin))) for c in cut), 1.0]
        return -math.log(upto[grade + 1] - upto[grade])
    share = [sum(g <= k for _, g in rows) / len(rows) for k in range(3)]
    cut = [math.log((s + 1e-3) / (1 - s + 1e-3)) + k * 1e-3 for k, s in enumerate(share)]
    total, e = [1.0] * 3, 1e-6
    for _ in range(m.epochs):
        for places, grade in rows:
            w = {p: weight(p) for p in places}
            margin = sum(w[p] * worth[p] for p in places)
            slope = (loss(margin + e, cut, grade) - loss(margin - e, cut, grade)) / (2 * e)
            step = [(loss(margin, cut[:k] + [c + e] + cut[k + 1:], grade) - loss(margin, cut[:k] + [c - e] + cut[k + 1:], grade)) / (2 * e)
                    for k, c in enumerate(cut)]
            for p in places:
                g = slope * worth[p]
                z[p] += g - (math.sqrt(n[p] + g * g) - math.sqrt(n[p])) / m.alpha * w[p]
                n[p] += g * g
            total = [t + s * s for t, s in zip(total, step)]
            cut = [c - 0.3 * s / math.sqrt(t) for c, s, t in zip(cut, step, total)]
            cut = [max(cut[:k + 1]) for k in range(3)]
    return {p: weight(p) * worth[p] for p in held}, cut


def test_fit_against_plain_loops():
    rng = np.random.default_rng(7)
    rows = [(np.unique(np.concatenate([rng.integers(20, 60, 8), np.arange(g * 3)])), g) for g in rng.integers(0, 4, 60).tolist()]
    model = toxicity.Ordinal(bits=6, l1=0.01, epochs=2)
    w, cut = toxicity.fit(rows, model)
    want, want_cut = plain_fit([(p.tolist(), g) for p, g in rows], model)
    assert np.allclose(cut, want_cut, atol=1e-5)
    assert all(abs(w[p] - v) < 1e-5 for p, v in want.items()) and np.count_nonzero(w) > 5


def graded_documents():
    rng = np.random.default_rng(3)
    bad = [[f"bad{g}word{j}" for j in range(12)] for g in range(4)]
    rows = []
    for k in range(800):
        g = k % 4
        rows.append((k, " ".join([f"plain{rng.integers(400)}" for _ in range(30)] + [w for h in range(1, g + 1) for w in rng.choice(bad[h], 4)]), g))
    return rows


def test_real_grades_are_used(spark):
    rows = graded_documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1, None), (2, 9), (None, 3)], "doc_id long, grade int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(g, out[i]) for i, _, g in rows if out[i].held_out]
    order = [a.expected_severity < b.expected_severity for g, a in held for h, b in held if g < h]
    assert np.mean(order) > 0.95  # rank agreement on rows that did not train
    means = [np.mean([r.expected_severity for g, r in held if g == k]) for k in range(4)]
    assert (np.diff(means) > 0.4).all() and np.mean([r.grade == g for g, r in held]) > 0.8
    one = toxicity.score(docs, labels.where("grade = 2")).select("expected_severity").distinct().collect()
    assert len(one) == 1 and abs(one[0][0] - 2) < 1e-6


def test_binary_labels_above_one_are_no_labels(spark):
    docs = spark.createDataFrame([(k, f"w{k} text") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 2 + k % 2) for k in range(20)], "doc_id long, toxic int")
    assert {r.expected_severity for r in toxicity.score(docs, labels).collect()} == {0.0}
