"""Streaks, scheduling, rates, care team, lookups: hand-made rows and brute force."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from symptomlake import dims
from symptomlake.functions import symptoms as S
from symptomlake.operators import (accounts, careteam, joins, next_question, ranking, rates, scheduling,
                                   streaks, timeline, triage, weekly)

DAY0 = date(2024, 1, 1)


def day_rows(spark, offsets_by_user):
    rows = [(u, datetime(2024, 1, 1, 12) + timedelta(days=o)) for u, os in offsets_by_user.items() for o in os]
    return spark.createDataFrame(rows, "user_id string, ts timestamp")


def islands(spark, offsets_by_user):
    return streaks.streak_islands(streaks.active_days(day_rows(spark, offsets_by_user)))


def test_streaks_follow_the_incremental_rule(spark):
    rng = random.Random(7)
    days = {f"u{i}": sorted(rng.sample(range(60), rng.randint(1, 40))) for i in range(25)}
    got = {r.user_id: (r.longest_streak, r.streak) for r in streaks.active_streak(
        spark.createDataFrame([(u,) for u in [*days, "nobody"]], "user_id string"),
        islands(spark, {u: d * 2 for u, d in days.items()}), DAY0 + timedelta(days=40)).collect()}
    for user, seen in days.items():
        streak = longest = 0
        last = None
        for d in seen:
            streak = streak + 1 if last == d - 1 else 1
            longest, last = max(longest, streak), d
        assert got[user] == (longest, streak if last in (39, 40) else 0)
    assert got["nobody"] == (0, 0)


@pytest.mark.parametrize("longest,expected", [
    (0, []), (6, []), (7, ["7daystreak"]), (14, ["7daystreak", "day10", "14daystreak"]),
    (25, ["7daystreak", "day10", "14daystreak", "day20", "21daystreak", "25logs"]),
    (50, [a[0] for a in dims.ACHIEVEMENTS])])
def test_achievements_reached(spark, longest, expected):
    df = spark.createDataFrame([("alice", longest)], "user_id string, longest_streak int")
    assert [r.achievement_id for r in streaks.reached(df).collect()] == expected


def test_second_run_unlocks_nothing_and_users_are_independent(spark):
    df = spark.createDataFrame([("alice", 7), ("bob", 7)], "user_id string, longest_streak int")
    reached = streaks.reached(df)
    alice = reached.where("user_id = 'alice'").select("user_id", "achievement_id")
    assert [r.user_id for r in streaks.newly_unlocked(reached, alice).collect()] == ["bob"]


def test_unlock_date_is_the_day_the_threshold_was_met(spark):
    rows = streaks.unlock_dates(islands(spark, {"a": list(range(3)) + list(range(10, 21))})).collect()
    assert {r.achievement_id: r.unlocked_on for r in rows} == {
        "7daystreak": date(2024, 1, 17), "day10": date(2024, 1, 20)}


def test_free_slots_against_brute_force(spark):
    rng = random.Random(3)
    base = datetime(2024, 5, 1)
    events, slots = [], []
    for i in range(120):
        start = base + timedelta(minutes=rng.randint(0, 3 * 1440), seconds=rng.randint(0, 59))
        length = rng.choice([-40, 0, 1, 5, 30, 90, 1500])  # some end before they start
        events.append((i, rng.randint(0, 1), start, start + timedelta(minutes=length),
                       rng.choice(["confirmed", "cancelled", None])))
    events.append((999, 0, None, None, "confirmed"))
    for doctor in (0, 1):
        for d in range(4):
            for _ in range(25):
                lo, hi = rng.randint(0, 23), rng.randint(0, 23)
                slots.append((doctor, date(2024, 5, 1) + timedelta(days=d),
                              f"{lo:02d}{rng.choice(['00', '15', '30', '45'])}", f"{hi:02d}{rng.choice(['00', '20', '59'])}"))
    bad = [(0, date(2024, 5, 1), s, e) for s, e in (("2400", "2500"), ("9am", "1000"), ("0900", "1060"), ("", "1000"))]
    edf = spark.createDataFrame(events, "event_id int, doctor_id int, start timestamp_ntz, end timestamp_ntz, status string")
    sdf = spark.createDataFrame(slots + bad, "doctor_id int, date date, start_time string, end_time string")
    got = Counter((r.doctor_id, r.start, r.end) for r in scheduling.free_slots(sdf, edf).collect())
    want = Counter()
    for doctor, day, lo, hi in slots:
        s = datetime(day.year, day.month, day.day, int(lo[:2]), int(lo[2:]))
        e = datetime(day.year, day.month, day.day, int(hi[:2]), int(hi[2:]))
        if not any(ev[1] == doctor and ev[4] != "cancelled" and ev[2] and ev[2] < e and ev[3] > s for ev in events):
            want[doctor, s, e] += 1
    # events outside the asked day cannot reach a slot that ends before it starts
    assert {w: n for w, n in want.items() if w[1] < w[2]} == {g: n for g, n in got.items() if g[1] < g[2]}


def test_slot_minutes_are_read_to_the_end(spark):
    slots = spark.createDataFrame([(1, date(2024, 5, 1), "09000000000030", "1000")],
                                  "doctor_id int, date date, start_time string, end_time string")
    assert [r.start_minute for r in scheduling.parse_slots(slots).collect()] == [570]


def test_event_defaults(spark):
    day = date(2024, 5, 2)
    rows = [(1, 1, None, None, day, day, None, None, None),
            (2, 1, datetime(2024, 5, 1, 9), datetime(2024, 5, 1, 10), None, None, "Visit", "tentative", [("a@b.c",), (None,)]),
            (3, 1, None, None, None, None, "no start", None, None)]
    df = spark.createDataFrame(rows, "event_id int, doctor_id int, start timestamp_ntz, end timestamp_ntz, start_date date, "
                               "end_date date, summary string, status string, attendees array<struct<email:string>>")
    got = scheduling.upcoming(df, "2024-05-01").collect()
    assert [(r.event_id, r.summary, r.status, r.attendees) for r in got] == [
        (2, "Visit", "tentative", ["a@b.c", ""]), (1, "No Title", "confirmed", [])]
    assert got[1].end == datetime(2024, 5, 2, 23, 59, 59)
    assert [r.event_id for r in scheduling.upcoming(df, "2024-05-01", 1).collect()] == [2]


@pytest.mark.parametrize("window,limit,inclusive", [(3600, 3, True), (60, 5, False), (30, 1, True)])
def test_rates_against_brute_force(spark, window, limit, inclusive):
    rng = random.Random(window)
    log = [("hot" if rng.random() < 0.7 else "cold", 1_700_000_000_000_000 + int(rng.random() ** 2 * 18_000) * 500_000)
           for _ in range(600)]
    df = spark.createDataFrame(log, "key string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {(r.key, r.at_us): (r.requests, r.prior, r.over_limit)
           for r in rates.rate_audit(df, ["key"], "ts", window, limit, inclusive).collect()}
    for key, at in set(log):
        n = log.count((key, at))
        ages = [at - t for k, t in log if k == key and t < at]
        prior = sum(1 for age in ages if age < window * 1e6 or inclusive and age == window * 1e6)
        over = sum(1 for j in range(n) if prior + j >= limit)
        assert got[(key, at)] == (n, prior, over)
    assert len(got) == len(set(log))


def test_rate_bounds(spark):
    def at(*seconds):
        return spark.createDataFrame([(1, int(s * 1e6)) for s in seconds], "user_id int, us long").withColumn(
            "ts", F.timestamp_micros("us"))
    attempts = rates.too_many_attempts(at(0, 1, 2, 3, 4, 60), ["user_id"], "ts", F.lit(True)).collect()
    assert {r.at_us: (r.prior, r.over_limit) for r in attempts}[60_000_000] == (4, 0)  # the first is exactly 60 s old
    assert [r.over_limit for r in rates.early_reissues(at(0, 30.9), ["user_id"], "ts").orderBy("at_us").collect()] == [0, 0]
    assert [r.over_limit for r in rates.early_reissues(at(0, 30), ["user_id"], "ts").orderBy("at_us").collect()] == [0, 1]


def test_access_code_precedence(spark):
    pending = spark.createDataFrame([(1, "pat", "AAAA"), (2, "doc", "HHHH"), (3, "bad", "XXXX"), (4, "taken", "AAAA"),
                                     (5, "pat2", "BOTH")], "pending_id int, username string, access_code string")
    doctors = spark.createDataFrame([("drA", "AAAA"), ("drB", "BOTH"), ("drC", "BOTH")], "username string, code string")
    hospitals = spark.createDataFrame([("General", "HHHH"), ("Other", "BOTH")], "name string, code string")
    patients = spark.createDataFrame([("taken",)], "username string")
    got = accounts.resolve_access_codes(pending, doctors, hospitals, patients).orderBy("pending_id").collect()
    assert [(r.status, r.doctor, r.hospital) for r in got] == [
        ("patient", "drA", None), ("doctor", None, "General"), ("invalid", None, None),
        ("duplicate", None, None), ("patient", "drB", None)]
    assert [r.username for r in accounts.taken_usernames(pending, patients, doctors).collect()] == ["taken"]


def test_account_names_are_never_broadcast(spark):
    pending = spark.range(50).selectExpr("id AS pending_id", "concat('u', id) AS username", "concat('D', id % 3) AS access_code")
    doctors = spark.range(3).selectExpr("concat('u', id) AS username", "concat('D', id) AS code")
    hospitals = spark.range(2).selectExpr("concat('h', id) AS name", "concat('H', id) AS code")
    patients = spark.range(60, 70).selectExpr("concat('u', id) AS username")
    rows = accounts.resolve_access_codes(pending, doctors, hospitals, patients)
    assert rows.where("status = 'duplicate'").count() == 3 and len(rows.collect()) == 50
    for df in (rows, accounts.taken_usernames(pending, patients, doctors)):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_account_flags(spark):
    df = spark.createDataFrame([(1, "alice"), (2, " "), (3, "abc"), (4, "alice"), (5, None), (6, "alice")],
                               "account_id int, username string")
    assert [r.flags for r in accounts.account_audit(df).orderBy("account_id").collect()] == [
        [], ["EMPTY"], ["SHORT"], ["DUPE"], ["EMPTY"], ["DUPE"]]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("a.b", "x@y", "Ann"), ("aXb", "x@y", None)], "username string, email string, full_name string")
    assert [r.username for r in accounts.search_users(df, "A.B").collect()] == ["a.b"]
    assert accounts.search_users(df, None).count() == 2


def assessments(spark, rows):
    """(id, user, created_at, {symptom: severity}, level, flag, triage level)"""
    out = [(i, u, f"s{i}", datetime.fromisoformat(t), [(n, "rated", v, 1, None, None, None, None) for n, v in s.items()]
            if s is not None else None, lvl, flag, (tri, "why", ["pain"], "soon", "high", TREAT) if tri else None, "UNKNOWN")
           for i, u, t, s, lvl, flag, tri in rows]
    return spark.createDataFrame(out, f"assessment_id int, user_id string, session_id string, created_at timestamp, "
                                 f"symptoms {S.SYMPTOMS_TYPE}, oncologist_notification_level string, flag_for_oncologist boolean, "
                                 "triage struct<alert_level:string,alert_rationale:string,key_symptoms:array<string>,"
                                 "recommended_timeline:string,confidence_level:string,treatment_status:string>, alert_level string") \
        .withColumn("assessment_type", F.lit("x")).withColumn("triage", F.when(F.col("triage").isNotNull(), F.struct(
            "triage.*", F.lit(None).cast("array<struct<urgency:int>>").alias("diagnosis_predictions"))))


TREAT = "undergoing_treatment"


def test_weekly_report_by_hand(spark):
    rows = [(1, "a", "2024-01-22 00:00:00", {"pain": 5, "cough": 5}, "amber", True, None),
            (2, "a", "2024-01-22 23:59:59", {"cough": 4, "pain": 4, "nausea": 0}, None, None, None),
            (3, "a", "2024-01-28 23:59:59", {"pain": 1}, "red", True, "RED"),
            (4, "a", "2024-01-29 00:00:00", {"pain": 5}, "red", True, "RED"),
            (5, "a", "2024-01-24 10:00:00", None, "odd", False, None)]
    report = weekly.weekly_report(spark.createDataFrame([("a",), ("b",)], "user_id string"),
                                  assessments(spark, rows), "2024-01-28").orderBy("user_id").collect()
    a, b = report
    assert (a.total_assessments, a.total_alerts, a.alerts_none, a.alerts_amber, a.alerts_red) == (4, 2, 1, 1, 1)
    assert (a.top_symptom, a.top_avg_severity) == ("Cough", 4.5)
    assert [(d.avg_severity, d.assessment_count, d.has_data) for d in a.daily_data] == [
        (4.5, 2, True), (0.0, 0, False), (0.0, 1, True), (0.0, 0, False), (0.0, 0, False), (0.0, 0, False), (1.0, 1, True)]
    assert a.overall_trend == "Improving"
    assert [c.id for c in a.insights] == ["concerning_symptom", "improving_trend"]
    assert b.overall_trend == "No Data" and [c.id for c in b.insights] == ["no_data"] and b.daily_data is None


def test_tie_goes_to_the_symptom_seen_first(spark):
    rows = [(1, "a", "2024-01-23 10:00:00", {"pain": 3, "cough": 3}, None, None, None),
            (2, "a", "2024-01-22 10:00:00", {"nausea": 3}, None, None, None)]
    assert weekly.most_concerning_symptom(assessments(spark, rows), "2024-01-28").first().symptom_name == "Nausea"


def test_trend_matrix_keeps_the_last_value(spark):
    rows = [(2, "a", "2024-01-22 10:00:00", {"pain": 3}, None, None, None),
            (1, "a", "2024-01-22 11:00:00", {"pain": 2}, None, None, None),
            (3, "a", "2024-01-22 12:00:00", {"pain": 0}, None, None, None)]
    assert weekly.symptom_trend_matrix(assessments(spark, rows), "2024-01-28").first().severity == 2


def test_care_team(spark):
    rows = [(i, "a", f"2024-01-{i:02d} 10:00:00", {}, "amber", None, "ORANGE" if i % 2 else None) for i in range(1, 10)]
    rows += [(20, "b", "2024-02-01 10:00:00", {}, "none", True, None), (21, "b", "2024-02-02 10:00:00", {}, "none", False, "RED")]
    df = assessments(spark, rows)
    docs = spark.createDataFrame([("d1", ["a", "b", "ghost", "a"]), ("d2", [])], "doctor_id string, patients array<string>")
    care = careteam.care_assignments(docs)
    alerts = careteam.doctor_alerts(care, df, 3).orderBy("rank").collect()
    assert [(r.session_id, r.alert_level) for r in alerts] == [("s20", "UNKNOWN"), ("s9", "ORANGE"), ("s8", "UNKNOWN")]
    people = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "user_id string, password string")
    panel = careteam.care_panel(care, people, df).orderBy("user_id").collect()
    assert [(r.user_id, r.latest_alert_level) for r in panel] == [("a", "ORANGE"), ("a", "ORANGE"), ("b", "RED")]
    assert "password" not in panel[0].asDict()
    seen = careteam.accessible_rows(
        spark.createDataFrame([("v1", "d1", None), ("v1", None, "a"), ("v2", None, "c")], "viewer_id string, doctor_id string, user_id string"),
        care, df.select("user_id", "assessment_id"))
    assert seen.count() == 11


def test_triage_numbers(spark):
    df = assessments(spark, [(1, "a", "2024-01-01 00:00:00", {}, None, None, "RED"), (2, "a", "2024-01-02 00:00:00", {}, None, None, None)])
    stats = {r.user_id: r for r in triage.triage_stats(spark.createDataFrame([("a",), ("z",)], "user_id string"), df).collect()}
    assert (stats["a"].total_assessments, stats["a"].n_red, stats["a"].average_confidence) == (1, 1, 3.0)
    assert (stats["z"].total_assessments, stats["z"].average_confidence) == (0, 0.0)


def test_lookup_prefers_the_conversation(spark):
    df = assessments(spark, [(1, "a", "2024-01-01 00:00:00", {"pain": 1}, None, None, None)])
    checkins = spark.createDataFrame([(1, "a", datetime(2024, 1, 2), ["x", "y"]), (2, "a", None, None)],
                                     "checkin_id int, user_id string, timestamp timestamp, answers array<string>")
    ids = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "b"), ("1", "a")], "id string, user_id string")
    got = timeline.lookup_records(ids, df, checkins).orderBy("id").collect()
    assert [(r.id, r.type, r.summary) for r in got] == [
        ("1", "conversation", "AI conversation completed"), ("2", "daily_checkin", "Completed questionnaire with 0 responses")]
    order = [r.id for r in timeline.timeline_sorted(checkins, df).collect()]
    assert order == ["1", "1", "2"]


def test_newest_rows_and_nulls_last(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 9), (4, "b", 1)], "id int, k string, t int")
    assert [r.id for r in ranking.newest_n(df, "k", ["t", "id"], 2).orderBy("k", "newest_rank").collect()] == [3, 1, 4]
    assert [r.id for r in ranking.newest_first(df, "t", "id").collect()] == [3, 1, 4, 2]


@pytest.mark.parametrize("how,expected", [("left", 6), ("left_semi", 4), ("left_anti", 2), ("inner", 4)])
def test_salted_join_equals_plain_join(spark, how, expected):
    rows = spark.createDataFrame([("hot", i) for i in range(4)] + [("x", 8), (None, 9)], "k string, v int").repartition(3)
    look = spark.createDataFrame([("hot", 1)], "k string, w int")
    got = joins.salted_join(rows, look, ["k"], how)
    plain = rows.join(look, ["k"], how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert got.count() == expected


def test_next_question_prerequisites(spark):
    catalogue = [{"question_number": 1, "text": "Pain?", "prerequisites": None},
                 {"question_number": 2, "text": "Where?", "prerequisites": [{"question_number": 1, "allowed_answers": ["yes"]}]},
                 {"question_number": 3, "text": "Sleep?", "prerequisites": []}]
    df = spark.createDataFrame([("a", {}), ("b", {"1": ["yes", "no"]}), ("c", {"1": ["no"]}), ("d", {"1": ["no"], "3": ["ok"]})],
                               "user_id string, answers map<string,array<string>>")
    got = next_question.next_question(df, catalogue).orderBy("user_id").collect()
    assert [(r.question_number, r.next_question, r.completed) for r in got] == [
        (1, "Pain?", False), (2, "Where?", False), (3, "Sleep?", False), (2, None, True)]
