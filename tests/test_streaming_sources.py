"""Streams in several micro-batches against their batch twins; files and sinks."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from symptomlake.operators import escalation, questionnaire, streaks
from symptomlake.sources import json_files, tables
from symptomlake.streaming import jobs


def feed(spark, path, frames):
    """Each frame becomes one file, read one per micro-batch in this order."""
    import os
    import time
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/part{i}")
    names = []
    for i in range(len(frames)):
        folder = f"{path}/part{i}"
        names += [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
    start = time.time() - 1000
    for i, name in enumerate(names):
        os.utime(name, (start + i * 10, start + i * 10))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def drain(stream, tmp_path, name):
    out, progress = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-progress")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_streak_stream_equals_batch(spark, tmp_path):
    offsets = [[0, 1, 1, 2], [2, 3, 7], [8, 9, 5], [20]]
    frames = [spark.createDataFrame([(u, datetime(2024, 1, 1, 9) + timedelta(days=o + k)) for o in part for k, u in enumerate("ab")],
                                    "user_id string, ts timestamp") for part in offsets]
    log = drain(jobs.stream_streaks(feed(spark, str(tmp_path / "in"), frames)), tmp_path, "streak")
    last = {r.user_id: (r.s.streak, r.s.longest_streak) for r in
            log.groupBy("user_id").agg(F.max(F.struct("day", "streak", "longest_streak")).alias("s")).collect()}
    everything = frames[0]
    for f in frames[1:]:
        everything = everything.unionByName(f)
    # day 5 arrives after day 9 and is ignored by the stream
    days = streaks.active_days(everything.where(~F.to_date("ts").isin("2024-01-06", "2024-01-07") | (F.col("user_id") == "z")))
    islands = streaks.streak_islands(days)
    longest = {r.user_id: r.m for r in islands.groupBy("user_id").agg(F.max("length").alias("m")).collect()}
    assert {u: v[1] for u, v in last.items()} == longest and {v[0] for v in last.values()} == {1}
    assert log.count() == log.dropDuplicates(["user_id", "day"]).count()


def test_sessions_have_an_absolute_lifetime(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 9)

    def batch(*rows):
        return spark.createDataFrame([(s, m, t0 + timedelta(minutes=at), start) for s, m, at, start in rows],
                                     "session_id string, message_id int, ts timestamp, is_start boolean")
    frames = [batch(("s", 2, 5, False), ("s", 1, 0, True), ("x", 9, 1, False)),
              batch(("s", 3, 20, False), ("s", 4, 30, False)), batch(("s", 5, 31, False)),
              batch(("y", 20, 600, True)), batch(("s", 6, 601, False), ("y", 21, 605, False))]
    got = drain(jobs.stream_sessions(feed(spark, str(tmp_path / "in"), frames), salts=3), tmp_path, "session")
    assert {r.message_id: r.accepted for r in got.collect()} == {
        1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 9: False, 20: True, 21: True}


def test_session_start_in_the_last_of_many_frames(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 9)
    rows = [("s", m, t0 + timedelta(seconds=1 + m), False) for m in range(100)] + [("s", 1000, t0, True)]
    frame = spark.createDataFrame(rows, "session_id string, message_id int, ts timestamp, is_start boolean").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = drain(jobs.stream_sessions(feed(spark, str(tmp_path / "in"), [frame]), salts=2), tmp_path, "late").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 101 and all(r.accepted for r in got)


def test_keyed_sink_reads_its_own_partitions_only(spark, tmp_path):
    target = str(tmp_path / "stored")
    insert = jobs.insert_batch(target, ["user_id"], "at")
    insert(spark.range(200).select(F.col("id").alias("user_id"), F.lit(1).alias("at")), 0)
    insert(spark.createDataFrame([(7, 2), (7, 3), (900, 9), (900, 8)], "user_id long, at int"), 1)
    stored = spark.read.parquet(target)
    assert stored.count() == 201 and stored.where("user_id = 900").first()["at"] == 8
    one = stored.where(F.col("_bucket") == stored.where("user_id = 7").first()["_bucket"])
    assert "PartitionFilters: [isnotnull(_bucket" in one._jdf.queryExecution().toString()


def test_enrichment_stream_equals_batch(spark, tmp_path):
    frames = [spark.createDataFrame([(i, {"appetite_rating": str(1 + i % 5), "bowel_frequency": "6+"})],
                                    "submission_id int, answers map<string,string>") for i in range(3)]
    live = drain(jobs.stream_enrich(feed(spark, str(tmp_path / "in"), frames)).select("submission_id", "summary"), tmp_path, "enrich")
    batch = questionnaire.enrich(frames[0].unionByName(frames[1]).unionByName(frames[2])).select("submission_id", "summary")
    assert sorted(live.collect()) == sorted(batch.collect())


def test_alert_feed_and_insert_if_absent_survive_a_replay(spark, tmp_path):
    frames = [spark.createDataFrame([(1, "a", True, "none"), (2, "a", False, "none")],
                                    "assessment_id int, user_id string, flag_for_oncologist boolean, oncologist_notification_level string"),
              spark.createDataFrame([(3, "b", None, "red"), (4, "c", True, "red")],
                                    "assessment_id int, user_id string, flag_for_oncologist boolean, oncologist_notification_level string")]
    care = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b")], "doctor_id string, user_id string")
    out = str(tmp_path / "alerts")
    write = jobs.alert_batch(care, out)
    for i, f in enumerate(frames):
        write(f, i)
        write(f, i)
    assert sorted((r.doctor_id, r.assessment_id) for r in spark.read.parquet(out).collect()) == [("d1", 1), ("d1", 3), ("d2", 3)]

    stored = str(tmp_path / "unlocked")
    stream = feed(spark, str(tmp_path / "in"), [spark.createDataFrame(rows, "user_id string, achievement_id string, at int") for rows in (
        [("a", "day10", 2), ("a", "day10", 1)], [("a", "day10", 3), ("b", "day10", 4)])])
    jobs.stream_insert_if_absent(stream, stored, str(tmp_path / "progress"), ["user_id", "achievement_id"], "at").awaitTermination()
    insert = jobs.insert_batch(stored, ["user_id", "achievement_id"], "at")
    insert(spark.createDataFrame([("b", "day10", 9)], "user_id string, achievement_id string, at int"), 7)
    assert sorted(map(tuple, spark.read.parquet(stored).drop("_bucket").collect())) == [("a", "day10", 1), ("b", "day10", 4)]


def test_json_directory(spark, tmp_path):
    docs = {"patient_p1_assessment_1.json": json.dumps({"timestamp": "2024-01-01T00:00:00", "patient_id": "p1",
                                                        "symptoms": {"pain": {"severity_rating": 4}}}, indent=1),
            "patient_p1_assessment_2.json": "{not json", "patient_p_2_assessment_1.json": json.dumps({"mood_assessment": "ok", "symptoms": []}),
            "patient_p3.json": "{}", "notes.json": "{}"}
    for name, body in docs.items():
        (tmp_path / name).write_text(body)
    got = json_files.read_assessment_json(spark, str(tmp_path)).orderBy("file_patient_id").collect()
    assert [(r.file_patient_id, json.loads(r.symptoms)) for r in got] == [("p1", {"pain": {"severity_rating": 4}}), ("p_2", [])]
    reports = escalation.flatten_symptoms(json_files.read_assessment_json(spark, str(tmp_path))
                                          .withColumnRenamed("symptoms", "symptoms_json")).collect()
    assert [(r.symptom, r.severity_rating) for r in reports] == [("pain", 4)]
    assert sorted(r.patient_id for r in json_files.list_patients(spark, str(tmp_path)).collect()) == ["p", "p1", "p3"]


def test_append_overview_and_profile_updates(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, date string")
    path = str(tmp_path / "t")
    tables.write_append(df, path, ["date"])
    tables.write_append(df, path, ["date"])
    assert tables.table_overview({"t": spark.read.parquet(path), "e": df.limit(0)}).collect() == [("t", 4), ("e", 0)]
    people = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "user_id string, checkups string, height int")
    updates = spark.createDataFrame([("a", 1, "old", 5), ("a", 2, None, 6)], "user_id string, at int, checkups string, height int")
    got = tables.apply_profile_updates(people, updates, ["checkups", "height"], ["at"]).orderBy("user_id").collect()
    assert [tuple(r) for r in got] == [("a", None, 6), ("b", "y", 2)]
    secret = spark.createDataFrame([("a", "pw", 3), ("b", "pw", 9)], "username string, password string, at int")
    assert tables.latest_row(secret, "at").collect() == [("b", 9)]
    assert "pw" not in tables.sample_row(secret).first().sample


def test_cascade_delete(spark):
    users = spark.createDataFrame([("a",), ("b",)], "username string")
    answers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "user_id string, v int")
    survivors, counts = tables.cascade_delete(users, {"answers": answers, "drafts": answers.where("v > 2")},
                                              spark.createDataFrame([("a",), ("nobody",)], "username string"))
    assert sorted(map(tuple, counts.collect())) == [("answers", 2), ("users", 1)]
    assert survivors["answers"].collect() == [("b", 3)] and survivors["users"].collect() == [("b",)]
