"""SQL parity of the registered queries, and the pipeline held against brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from symptomlake.llm import decontam, queries
from tests.llm.test_minhash import brute
from tests.llm.test_pii import plain
from workload.compare import duck, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    want = duck(SMALL).execute(queries.SQL[name])
    assert rows_of(out.columns, out.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    raw = docs = queries.table(spark, SMALL, "documents")
    labels = {r.doc_id: r.quality for r in queries.table(spark, SMALL, "labels").collect()}
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == raw.columns
        steps.append({r.doc_id: r.text for r in docs.collect()})
    good, different, unseen, private = steps
    gone = [labels[i] for i in {r.doc_id for r in raw.select("doc_id").collect()} - set(good) if i in labels]
    assert gone and sum(gone) / len(gone) < 0.35
    assert set(different) == {c for _, c in brute(list(good.items()), 5, 80).values()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(different.items()))
    dirty = {r[0] for r in con.execute(decontam.SQL).fetchall()}
    assert set(unseen) == set(different) - dirty and set(private) == set(unseen)
    assert not any(plain(t) for t in private.values())
    assert all(private[i] == unseen[i] for i in private if not plain(unseen[i]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(private)


def small_tables(spark, path, rows):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, kept boolean",
             "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    labels = [(i, 1, 0) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 7, 7)]
    benchmark = [(1, "what is the capital of the country by the sea"), (2, None), (None, "nothing")]
    for name, data in (("documents", rows), ("labels", labels), ("benchmark", benchmark)):
        spark.createDataFrame(data, kinds[name]).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_with_edges(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeats, ties and columns with the names of intermediate ones."""
    def row(i, text):
        return (i, text, None, None, None if text is None else len(text), 0.5, 7, True)
    good = [f"good words about thing {k} that only document {k} tells in its own way {k}" for k in range(40)]
    rows = [row(k, t) for k, t in enumerate(good)] + [row(k, good[1]) for k in (1, 1, 90, 91)]
    rows += [row(None, None), row(None, ""), row(60, None), row(61, ""), row(62, "long " * 60_000 + "end"),
             row(63, "before it what is the capital of the country by the sea after it"), row(64, "write to jo@corp.example.com or +1 (212) 555-0199 today")]
    out = corpus_pipeline.run(spark, small_tables(spark, tmp_path / "t", rows))
    pieces = out.collect()
    ids = {p.doc_id for p in pieces}
    assert {62, 64, 0, 1} <= ids and 63 not in ids and not {90, 91} & ids  # one kind of label: nothing is rejected
    assert sum(p.length for p in pieces if p.doc_id == 62) > 60_000
    assert corpus_pipeline.run(spark, small_tables(spark, tmp_path / "e", [])).count() == 0
