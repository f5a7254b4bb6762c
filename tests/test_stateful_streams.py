"""Typed state: history, waiting messages, expiry and newest alerts, over several micro-batches."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from symptomlake.operators import careteam, streaks
from symptomlake.streaming import jobs, stateful
from workload import adapter as A

from .test_streaming_sources import drain, feed

SF = "/root/testdata/sf0.001"


def test_streaks_go_on_from_stored_history(spark, tmp_path):
    """Half of the days as history and half as a stream are the same as the batch operator over all."""
    rows = A.activity_days(spark, SF)
    cut = "2024-01-16"
    history = streaks.active_days(rows.where(F.col("ts") < cut))
    late = rows.where(F.col("ts") >= cut).select("user_id", "ts")
    frames = [late.where((F.col("ts") < "2024-01-24")), late.where(F.col("ts") >= "2024-01-24")]
    log = drain(jobs.stream_streaks(feed(spark, str(tmp_path / "in"), frames), history), tmp_path, "streak")
    last = log.groupBy("user_id").agg(F.max(F.struct("day", "streak", "longest_streak")).alias("s"))
    got = {r.user_id: (r.s.streak, r.s.longest_streak) for r in last.collect()}
    islands = streaks.streak_islands(streaks.active_days(rows))
    want = {r.user_id: (r.l.length, r.m) for r in islands.groupBy("user_id").agg(
        F.max(F.struct("last_day", "length")).alias("l"), F.max("length").alias("m")).where(F.col("l.last_day") >= cut).collect()}
    assert got == want and len(want) > 10
    before = {r.user_id: r.longest for r in stateful.streak_history(history).collect()}
    assert any(want[u][1] == before.get(u) and want[u][0] < before[u] for u in want)  # some longest streak is history


def messages(spark, *rows):
    t0 = datetime(2024, 1, 1, 9)
    return spark.createDataFrame([(s, m, t0 + timedelta(minutes=at), start) for s, m, at, start in rows],
                                 "session_id string, message_id int, ts timestamp, is_start boolean")


@pytest.mark.parametrize("salts", [1, 3])
def test_early_messages_wait_for_their_start(spark, tmp_path, salts):
    frames = [messages(spark, ("s", 2, 5, False), ("s", 3, 8, False), ("x", 9, 1, False)),
              messages(spark, ("s", 1, 4, True), ("y", 7, 3, False)),  # a start in a later micro-batch
              messages(spark, ("s", 4, 40, False), ("y", 8, 41, False)),  # the watermark passes what x and y wait for
              messages(spark, ("y", 6, 42, True), ("z", 5, 200, True))]
    got = drain(jobs.stream_sessions(feed(spark, str(tmp_path / "in"), frames), salts=salts), tmp_path, "session")
    assert {r.message_id: r.accepted for r in got.collect()} == {
        1: True, 2: True, 3: True, 9: False, 7: False, 4: False, 8: False, 6: True, 5: True}


def test_starts_are_kept_once(spark, tmp_path):
    frames = [messages(spark, *((f"s{k}", k, k, True) for k in range(20)))]
    drain(jobs.stream_sessions(feed(spark, str(tmp_path / "in"), frames), ttl_seconds=86_400), tmp_path, "starts")
    state = spark.read.format("statestore").option("stateVarName", "start").load(str(tmp_path / "starts-progress"))
    assert state.count() == 20


def once(stream, tmp_path, name):
    """All data present in one micro-batch; a query on processing time has no last one by itself."""
    jobs.run_once(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-progress"))
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / f"{name}-out"))


def test_codes_expire_by_themselves(spark, tmp_path):
    t0 = datetime(2024, 1, 1)

    def batch(*rows):
        return spark.createDataFrame([(k, i, t0 + timedelta(seconds=at), c, new) for k, i, at, c, new in rows],
                                     "key string, use_id long, at timestamp, code string, issued boolean")
    source = str(tmp_path / "in")
    stream = feed(spark, source, [batch(("a", 0, 1, "111", True), ("a", 0, 2, "222", True), ("a", 1, 3, "222", False), ("a", 2, 3, "111", False),
                                        ("b", 0, 1, "333", True), ("c", 3, 1, "444", False))])
    live = jobs.stream_codes(stream, ttl_seconds=6)
    first = {r.use_id: r.accepted for r in once(live, tmp_path, "codes").collect()}
    assert first == {1: True, 2: False, 3: False}

    def state():
        rows = spark.read.format("statestore").option("stateVarName", "code").load(str(tmp_path / "codes-progress"))
        return {r.key[0] for r in rows.collect()}
    assert state() == {"a", "b"}
    time.sleep(7)
    batch(("a", 5, 9, "222", False), ("d", 0, 9, "555", True), ("d", 6, 9, "555", False)).coalesce(1).write.parquet(f"{source}/part1")
    second = {r.use_id: r.accepted for r in once(live, tmp_path, "codes").collect()}
    assert second == first | {5: False, 6: True}
    assert state() == {"d"}


def test_newest_alerts_equal_the_batch(spark, tmp_path):
    rows = A.assessments(spark, SF)
    care = A.assignments(spark, SF)
    parts = [rows.where(F.col("assessment_id") % 3 == k) for k in range(3)]
    log = drain(stateful.stream_doctor_alerts(feed(spark, str(tmp_path / "in"), parts), care, 7), tmp_path, "alerts")
    now = stateful.current_alerts(log, rows.schema).select("doctor_id", "rank", "session_id", "user_id", "created_at")
    want = careteam.doctor_alerts(care, rows, 7).select("doctor_id", "rank", "session_id", "user_id", "created_at")
    assert sorted(now.collect()) == sorted(want.collect()) and want.count() > 50
    assert log.groupBy("doctor_id").agg(F.max("change").alias("n")).where("n > 1").count() > 0
