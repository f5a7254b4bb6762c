"""Stored tables change only where they must."""

import json
import os

import pytest
from pyspark.sql import functions as F

from symptomlake.operators import quality
from symptomlake.sources import stored
from symptomlake.sources.tables import first_per_key
from symptomlake.streaming import jobs
from workload import adapter as A

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "user_id long, at int")


def test_a_batch_reads_a_falling_share(spark, tmp_path):
    """Batches of one size: the table grows and is split, the share of files that a batch reads falls."""
    path, seen = str(tmp_path / "t"), []
    insert = jobs.insert_batch(path, ["user_id"], "at", rows_per_bucket=64, compact_every=4, on_files=lambda *x: seen.append(x))
    for k in range(13):
        insert(spark.range(k * 40, k * 40 + 40).select(F.col("id").alias("user_id"), F.lit(k).alias("at")), 2 * k)
        insert(pairs(spark, (k * 40, 99), (10**6 + k, 1)), 2 * k + 1)  # one is known, one is new
    rows = spark.read.parquet(path)
    assert rows.count() == 13 * 41 and rows.select("user_id").distinct().count() == 13 * 41
    assert rows.where("at = 99").count() == 0
    assert json.loads((tmp_path / "t" / "_buckets").read_text())["n"] >= 4
    share = [a / b for batch, a, b in seen if batch % 2 and b]
    assert share[0] == 1.0 and share[-1] <= 0.5
    insert(pairs(spark, (10**6, 5), (7, 5)), 100)  # replayed keys
    assert spark.read.parquet(path).count() == 13 * 41


def test_a_cut_off_split_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    table = stored.KeyedTable(spark, path, ["user_id"], 10)
    table.insert_if_absent(pairs(spark, *((k, k) for k in range(5))), lambda r: first_per_key(r, ["user_id"], "at"))
    schema = spark.read.parquet(path).schema
    assert table.buckets() == 1
    table.files.write("_buckets", json.dumps({"n": 1, "to": 4}))  # as a run leaves it that was cut off
    assert table.compact(schema) == 4
    rows = table.read(schema)
    assert sorted(r.user_id for r in rows.collect()) == list(range(5))
    assert rows.where(F.col("_bucket") != F.pmod(F.xxhash64("user_id"), F.lit(4))).count() == 0


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = stored.KeyedTable(spark, path, ["user_id"], 20)
    table.upsert(pairs(spark, *((k, k) for k in range(160))))
    before = files(path)
    assert table.buckets() == 8 and len(before) == 8
    change = pairs(spark, (3, 30), (1000, 1), (4, 4))
    assert table.upsert(change) in (1, 2)
    after = files(path)
    assert len(before & after) >= 6
    assert table.upsert(change) == 0 and files(path) == after  # a repeated run changes nothing
    got = {r.user_id: r.at for r in spark.read.parquet(path).collect()}
    assert got == {k: k for k in range(160)} | {3: 30, 1000: 1}
    assert table.upsert(pairs(spark, (5, None))) == 1 and table.upsert(pairs(spark, (5, None))) == 0


@pytest.mark.parametrize("by", [[], ["part"]])
def test_delete_rewrites_touched_files_only(spark, tmp_path, by):
    path = str(tmp_path / "t")
    rows = spark.range(400).select((F.col("id") % 40).alias("user_id"), "id", (F.col("id") / 100).cast("int").alias("part"))
    writer = rows.repartitionByRange(8, "id").write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    extra = pairs(spark, (777, 1)).select("user_id", F.lit(1000).cast("long").alias("id"), F.lit(9).alias("part"))
    (extra.write.mode("append").partitionBy(*by) if by else extra.write.mode("append")).parquet(path)
    before = files(path)
    assert stored.delete_rows(spark, path, pairs(spark, (12345, 0)), ["user_id"], by)["removed"] == 0 and files(path) == before
    out = stored.delete_rows(spark, path, pairs(spark, (777, 0)), ["user_id"], by)
    assert (out["removed"], out["rewritten"]) == (1, 1) and out["files"] == len(before)
    assert len(before - files(path)) == 1  # that file is gone, the others keep their names
    assert stored.delete_rows(spark, path, pairs(spark, (3, 0), (5, 0)), ["user_id"], by)["removed"] == 20
    got = spark.read.parquet(path)
    assert got.count() == 380 and got.where("user_id IN (3, 5, 777)").count() == 0
    assert sorted(got.columns) == ["id", "part", "user_id"] and got.where("part = int(id / 100)").count() == 380


def test_a_cut_off_delete_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    pairs(spark, *((k, k) for k in range(20))).coalesce(1).write.parquet(path)
    finish = stored._finish
    monkeypatch.setattr(stored, "_finish", lambda f: None)
    stored.delete_rows(spark, path, pairs(spark, (3, 0)), ["user_id"])
    monkeypatch.setattr(stored, "_finish", finish)
    assert (tmp_path / "t" / "_pending").exists() and spark.read.parquet(path).count() == 20
    assert stored.delete_rows(spark, path, pairs(spark, (4, 0)), ["user_id"])["removed"] == 1
    assert sorted(r.user_id for r in spark.read.parquet(path).collect()) == [k for k in range(20) if k not in (3, 4)]


def test_quarantine_in_one_pass(spark, tmp_path):
    rows = A.pending_signups(spark, SF).withColumns({"password": F.lit("secret"), "email": F.lit("a@b.org")})
    ok, bad, counts = stored.quarantine(rows, quality.signup_rules(), str(tmp_path / "q"))
    checked = quality.conformance(rows, quality.signup_rules())
    assert (ok.count(), bad.count()) == (counts["_valid"], counts["_rows"] - counts["_valid"])
    assert ok.columns == rows.columns and bad.columns == [*rows.columns, "violations"]
    each = {r.v: r["count"] for r in checked.select(F.explode("violations").alias("v")).groupBy("v").count().collect()}
    assert {c: counts[c] for c in quality.signup_rules() if counts[c]} == each
    assert sorted(map(str, bad.collect())) == sorted(map(str, checked.where(F.size("violations") > 0).select(*bad.columns).collect()))


def test_overview_reads_no_data_pages(spark):
    frame = stored.footer_overview(spark, {"orders": (f"{SF}/orders.parquet", "o_orderkey"), "events": (f"{SF}/events.parquet", "event_id")})
    plan = frame._jdf.queryExecution().toString()
    assert plan.count("PushedAggregation: [COUNT(*)") >= 2 and "MIN(" in plan and "ReadSchema: struct<count" in plan
    got = {r.collection: (r.documents, r.first, r.last) for r in frame.collect()}
    for name, key in (("orders", "o_orderkey"), ("events", "event_id")):
        want = spark.read.parquet(f"{SF}/{name}.parquet").agg(F.count("*"), F.min(key), F.max(key)).first()
        assert got[name] == (want[0], str(want[1]), str(want[2]))
