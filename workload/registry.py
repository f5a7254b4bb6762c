"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from symptomlake.functions import symptoms as S, text, timing
from symptomlake.operators import (accounts, calendar_views, careteam, escalation, messages, monthly,
                                   quality, questionnaire, ranking, rates, scheduling, streaks, triage, weekly)
from symptomlake.operators import next_question as next_question_ops
from symptomlake.operators import timeline as timeline_ops
from symptomlake.plans import reports
from symptomlake.session import shared_dir
from symptomlake.sources import json_files, stored, tables
from symptomlake.sources.tables import read_table
from symptomlake.streaming import jobs, stateful

from . import adapter as A
from .portable import portable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# -- weekly -----------------------------------------------------------------

@query
def week_window(spark, sf):
    return weekly.week_of(A.assessments(spark, sf), A.AS_OF, 1).select(
        "assessment_id", "user_id", "created_at",
        timing.week_start(F.col("created_at")).alias("week_start"))


@query
def weekly_daily_series(spark, sf):
    return weekly.weekly_daily_series(A.assessments(spark, sf), A.AS_OF)


@query
def weekly_severity_by_symptom(spark, sf):
    return weekly.weekly_severity_by_symptom(A.assessments(spark, sf), A.AS_OF)


@query
def most_concerning_symptom(spark, sf):
    return weekly.most_concerning_symptom(A.assessments(spark, sf), A.AS_OF)


@query
def weekly_alerts(spark, sf):
    return weekly.weekly_alerts(A.assessments(spark, sf), A.AS_OF)


@query
def weekly_trend(spark, sf):
    return weekly.weekly_trend(A.assessments(spark, sf), A.AS_OF)


@query
def symptom_trend_matrix(spark, sf):
    return weekly.symptom_trend_matrix(A.assessments(spark, sf), A.AS_OF)


def _report(spark, sf):
    return weekly.weekly_report(A.users(spark, sf), A.assessments(spark, sf), A.AS_OF)


@query
def weekly_report(spark, sf):
    days = F.transform("daily_data", lambda d: F.concat_ws(
        " ", F.date_format(d["day"], "yyyy-MM-dd"), F.format_string("%.1f", d["avg_severity"]), d["assessment_count"], d["has_data"]))
    return _report(spark, sf).drop("insights").withColumn("daily_data", F.array_join(days, "; "))


@query
def weekly_insights(spark, sf):
    return _report(spark, sf).select("user_id", F.array_join(F.transform(
        "insights", lambda c: F.concat(c["id"], F.lit(" ("), c["type"], F.lit(", "), c["icon"], F.lit(", "), c["title"], F.lit("): "), c["description"])),
        " | ").alias("insights"))


# -- monthly ----------------------------------------------------------------

@query
def month_window(spark, sf):
    return monthly.month_of(A.assessments(spark, sf), A.AS_OF).select(
        "assessment_id", "user_id", "created_at", F.month("created_at").alias("month"))


@query
def monthly_alerts_by_day(spark, sf):
    return monthly.monthly_alerts_by_day(A.assessments(spark, sf), A.AS_OF)


@query
def monthly_symptom_heatmap(spark, sf):
    return monthly.monthly_symptom_heatmap(A.assessments(spark, sf), A.AS_OF)


@query
def monthly_severity_by_day(spark, sf):
    return monthly.monthly_severity_by_day(A.assessments(spark, sf), A.AS_OF)


@query
def available_symptoms(spark, sf):
    return monthly.available_symptoms(A.assessments(spark, sf), A.AS_OF)


@query
def monthly_report(spark, sf):
    return monthly.monthly_report(A.users(spark, sf), A.assessments(spark, sf), A.AS_OF)


# -- rules ------------------------------------------------------------------

@query
def flatten_symptoms(spark, sf):
    docs = A.events(spark, sf).select(F.col("event_id").alias("assessment_id"), "user_id",
                                      A.symptom_json().alias("symptoms_json"))
    return escalation.flatten_symptoms(docs).select(
        "assessment_id", "user_id", "pos", "symptom", "shape", "severity_rating",
        "frequency_rating", "severity_text")


@query
def escalate(spark, sf):
    return escalation.escalate(A.sessions(spark, sf)).select(
        F.col("event_id").alias("assessment_id"), "flag", "level", "reason")


@query
def merge_notification(spark, sf):
    return A.derive_assessments(spark, sf).select(
        "assessment_id", "alert_level", "oncologist_notification_level", "flag_for_oncologist")


@query
def assemble_assessments(spark, sf):
    rows = A.sessions(spark, sf)
    structured = escalation.escalate(rows).select("session_id", F.struct("flag", "level").alias("structured"))
    triaged = A.assessments(spark, sf).select("session_id", "triage")
    return escalation.assemble_assessments(rows.select("session_id", "user_id"), structured, triaged) \
        .drop("structured", "triage")


@query
def flagged(spark, sf):
    return escalation.flagged(A.assessments(spark, sf)).select(
        "assessment_id", "user_id", F.col("oncologist_notification_level").alias("level"))


@query
def with_triage(spark, sf):
    return triage.with_triage(A.assessments(spark, sf)).select(
        "assessment_id", F.col("triage.alert_level").alias("triage_level"))


@query
def describe_alerts(spark, sf):
    return escalation.describe_alerts(A.assessments(spark, sf)).select("assessment_id", "alert_description")


@query
def severity_level(spark, sf):
    rows = A.assessments(spark, sf).select("assessment_id", F.explode("symptoms").alias("s")) \
        .select("assessment_id", "s.symptom", F.col("s.severity_rating").alias("severity"))
    return escalation.severity_names(rows).drop("severity")


# -- triage -----------------------------------------------------------------

def _joined_keys(df):
    df = df.withColumn("key_symptoms", F.array_join("key_symptoms", "|"))
    if "diagnosis_predictions" in df.columns:
        df = df.withColumn("diagnosis_predictions", F.array_join(F.transform("diagnosis_predictions", lambda d: F.concat_ws(
            ":", d["suspected_diagnosis"], d["probability"], d["urgency"].cast("string"), d["reasoning"])), "|"))
    return df


@query
def latest_triage(spark, sf):
    return _joined_keys(triage.latest_triage(A.assessments(spark, sf)))


@query
def triage_history(spark, sf):
    return _joined_keys(triage.triage_history(A.assessments(spark, sf)))


@query
def triage_levels(spark, sf):
    return triage.triage_levels(A.assessments(spark, sf))


@query
def triage_stats(spark, sf):
    return triage.triage_stats(A.users(spark, sf), A.assessments(spark, sf))


@query
def top_key_symptoms(spark, sf):
    return triage.top_key_symptoms(A.assessments(spark, sf))


@query
def smart_insights(spark, sf):
    # the newest triaged row first: only its document is decoded
    rows = ranking.latest_per_key(triage.with_triage(A.assessments(spark, sf).drop("symptoms")), "user_id",
                                  ["created_at", "assessment_id"])
    docs = A.events(spark, sf).select(F.col("event_id").alias("assessment_id"),
                                      S.symptom_entries(A.symptom_json()).alias("symptoms"))
    out = triage.smart_insights(rows.join(docs, "assessment_id"))
    return out.select("user_id", F.array_join(F.transform(
        "insights", lambda c: F.concat_ws(":", c["title"], c["kind"], c["icon"], c["description"])), "|").alias("insights"))


# -- care team --------------------------------------------------------------

@query
def care_panel(spark, sf):
    return careteam.care_panel(A.assignments(spark, sf),
                               A.users(spark, sf).select("user_id", "username", "email", "password"),
                               A.assessments(spark, sf))


@query
def doctor_alerts(spark, sf):
    return _joined_keys(careteam.doctor_alerts(A.assignments(spark, sf), A.assessments(spark, sf)))


@query
def accessible_rows(spark, sf):
    none = F.lit(None).cast("long")
    viewers = A.users(spark, sf).select(F.concat(F.lit("p"), "user_id").alias("viewer_id"),
                                        none.alias("doctor_id"), "user_id") \
        .unionByName(A.doctors(spark, sf).select(F.concat(F.lit("d"), "doctor_id").alias("viewer_id"),
                                                 "doctor_id", none.alias("user_id")))
    return careteam.accessible_rows(viewers, A.assignments(spark, sf),
                                    A.assessments(spark, sf).select("user_id", "assessment_id"))


# -- timeline and listings --------------------------------------------------

def _timeline(spark, sf):
    return timeline_ops.timeline(A.checkins(spark, sf), A.assessments(spark, sf))


@query
def timeline(spark, sf):
    return timeline_ops.timeline_sorted(A.checkins(spark, sf), A.assessments(spark, sf))


@query
def timeline_counts(spark, sf):
    return timeline_ops.timeline_counts(_timeline(spark, sf))


@query
def lookup_records(spark, sf):
    ids = A.checkins(spark, sf).select(F.col("checkin_id").cast("string").alias("id"), "user_id") \
        .unionByName(A.assessments(spark, sf).select(F.col("assessment_id").cast("string").alias("id"), "user_id"))
    return _detail_text(timeline_ops.lookup_records(ids, A.assessments(spark, sf), A.checkins(spark, sf))).withColumn(
        "answers", F.array_join("answers", ","))


def _detail_text(rows):
    """Arrays as text, for comparison."""
    said = F.transform("symptoms_data", lambda s: F.concat_ws(":", s["symptom"], s["name"], s["icon"], s["frequency"], s["intensity"],
                                                              F.array_join(s["key_indicators"], ","), s["additional_notes"], s["discussed"]))
    return rows.withColumns({"symptoms_data": F.array_join(said, "|"), "symptoms_assessed": F.array_join("symptoms_assessed", "|")})


@query
def assessment_detail(spark, sf):
    return _detail_text(timeline_ops.assessment_detail(A.assessments(spark, sf)))


@query
def symptom_detail(spark, sf):
    return timeline_ops.symptom_detail(A.assessments(spark, sf)).withColumn("key_indicators", F.array_join("key_indicators", ","))


@query
def patient_reports(spark, sf):
    return timeline_ops.patient_reports(A.assessments(spark, sf))


@query
def newest_overall(spark, sf):
    rows = A.assessments(spark, sf).select("assessment_id", "user_id", "created_at")
    return ranking.newest_overall(rows, ["created_at", "assessment_id"], 50)


@query
def newest_first(spark, sf):
    rows = A.events(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 9 != 0, F.col("created_at")).alias("ts"))
    return ranking.newest_first(rows, "ts", "event_id")


@query
def summary_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", text.summary_text(F.col("text")).alias("summary"))


@query
def title_symptom(spark, sf):
    return A.assessments(spark, sf).select("assessment_id", F.explode("symptoms").alias("s")) \
        .select("assessment_id", text.title_symptom(F.col("s.symptom")).alias("title"))


@query
def show_timestamps(spark, sf):
    return A.stamped_texts(spark, sf).select("event_id", timing.show_ts(F.col("started")).alias("shown"))


@query
def expire_sessions(spark, sf):
    return A.stamped_texts(spark, sf).select(
        "event_id", timing.is_expired(F.col("started"), 1800, "2024-01-15 12:00:00").alias("expired"))


@query
def live_sessions(spark, sf):
    """The sessions that are kept, and how many are swept."""
    rows = A.stamped_texts(spark, sf)
    live, expired = timing.split_expired(rows, F.col("started"), 1800, "2024-01-15 12:00:00")
    return live.select(F.lit("live").alias("state"), "event_id").unionByName(
        expired.select(F.lit("expired").alias("state"), "event_id"))


@query
def past_codes(spark, sf):
    return A.events(spark, sf).select("event_id", timing.is_past(
        F.when(F.col("k") % 7 != 0, F.timestamp_add("MINUTE", F.lit(10), F.col("created_at"))), "2024-01-15 12:00:00").alias("past"))


@query
def sample_row(spark, sf):
    return tables.sample_row(A.users(spark, sf).orderBy("user_id").select("user_id", "username", "email", "password"))


# -- accounts ---------------------------------------------------------------

@query
def drop_sensitive(spark, sf):
    return accounts.drop_sensitive(A.users(spark, sf))


@query
def search_users(spark, sf):
    return accounts.search_users(A.users(spark, sf), "Mach").select("user_id", "username", "email", "full_name")


def _pending(spark, sf):
    return A.pending_signups(spark, sf)


@query
def taken_usernames(spark, sf):
    return accounts.taken_usernames(_pending(spark, sf), A.users(spark, sf), A.doctors(spark, sf)) \
        .select("pending_id", "username")


@query
def resolve_access_codes(spark, sf):
    return accounts.resolve_access_codes(_pending(spark, sf), A.doctors(spark, sf), A.hospitals(spark, sf),
                                         A.users(spark, sf))


@query
def account_audit(spark, sf):
    return accounts.account_audit(A.junk_accounts(spark, sf)).withColumn("flags", F.array_join("flags", ", "))


@query
def duplicate_usernames(spark, sf):
    return accounts.duplicate_usernames(A.junk_accounts(spark, sf))


# -- streaks and achievements -----------------------------------------------

def _islands(spark, sf):
    return streaks.streak_islands(streaks.active_days(A.activity_days(spark, sf)))


def _questionnaire_islands(spark, sf):
    rows = A.checkins(spark, sf).select("user_id", F.col("timestamp").alias("ts"))
    return streaks.streak_islands(streaks.active_days(rows))


def _streaks(spark, sf):
    return streaks.active_streak(A.users(spark, sf), _islands(spark, sf), A.AS_OF_DAY)


def _stored_unlocks(spark, sf):
    return streaks.unlock_dates(_islands(spark, sf)).where(F.col("unlocked_on") <= "2024-01-12") \
        .withColumnRenamed("unlocked_on", "unlocked_at")


@query
def streak_islands(spark, sf):
    return _islands(spark, sf)


@query
def questionnaire_streaks(spark, sf):
    return _questionnaire_islands(spark, sf)


@query
def latest_island(spark, sf):
    return streaks.latest_island(_questionnaire_islands(spark, sf))


@query
def active_streak(spark, sf):
    return _streaks(spark, sf)


@query
def overall_longest(spark, sf):
    return streaks.overall_longest(_islands(spark, sf), _questionnaire_islands(spark, sf))


@query
def achievements_reached(spark, sf):
    return streaks.reached(_streaks(spark, sf))


@query
def unlock_dates(spark, sf):
    return streaks.unlock_dates(_islands(spark, sf))


@query
def newly_unlocked(spark, sf):
    return streaks.newly_unlocked(streaks.reached(_streaks(spark, sf)), _stored_unlocks(spark, sf))


@query
def achievement_status(spark, sf):
    return streaks.achievement_status(_streaks(spark, sf), _stored_unlocks(spark, sf))


# -- scheduling -------------------------------------------------------------

@query
def parse_slots(spark, sf):
    return scheduling.parse_slots(A.slot_requests(spark, sf)).drop("start_time", "end_time")


@query
def free_slots(spark, sf):
    return scheduling.free_slots(A.slot_requests(spark, sf), A.calendar_events(spark, sf))


@query
def normalize_events(spark, sf):
    return scheduling.normalize_events(A.calendar_events(spark, sf), "2024-01-10").withColumn(
        "attendees", F.array_join("attendees", "; "))


# -- calendar views ---------------------------------------------------------

@query
def severity_calendar(spark, sf):
    return calendar_views.severity_calendar(A.assessments(spark, sf), A.AS_OF)


@query
def day_severity(spark, sf):
    return calendar_views.day_severity(A.assessments(spark, sf), "2024-01-10", "2024-01-20")


@query
def monthly_symptom_averages(spark, sf):
    return calendar_views.monthly_symptom_averages(A.assessments(spark, sf), A.AS_OF)


@query
def yearly_summary(spark, sf):
    return calendar_views.yearly_summary(A.assessments(spark, sf), 2024)


@query
def alert_days_by_month(spark, sf):
    return calendar_views.alert_days_by_month(A.assessments(spark, sf))


@query
def weekly_rollup(spark, sf):
    return calendar_views.weekly_rollup(A.assessments(spark, sf), A.AS_OF)


def _series(spark, sf):
    return calendar_views.severity_series(A.assessments(spark, sf), "2024-01-22", "2024-01-28")


@query
def severity_series(spark, sf):
    return _series(spark, sf)


@query
def charted_symptoms(spark, sf):
    return calendar_views.charted_symptoms(_series(spark, sf))


# -- rates ------------------------------------------------------------------

def _log(spark, sf):
    return A.events(spark, sf).select("user_id", F.col("event_type").alias("purpose"), "created_at")


@query
def rate_issues(spark, sf):
    return rates.too_many_issues(_log(spark, sf), ["user_id"], "created_at")


@query
def rate_attempts(spark, sf):
    return rates.too_many_attempts(_log(spark, sf), ["user_id"], "created_at", F.col("purpose") != "purchase")


@query
def rate_reissues(spark, sf):
    return rates.early_reissues(_log(spark, sf), ["user_id", "purpose"], "created_at")


# -- questionnaire ----------------------------------------------------------

def _enriched(spark, sf, responses=False):
    return questionnaire.enrich(A.submissions(spark, sf), responses=responses, talk=responses)


@query
def question_responses(spark, sf):
    return questionnaire.question_responses(A.submissions(spark, sf)).select(
        "submission_id", "question_id", "was_shown", "was_required", "raw_value", "display_value",
        "severity_normalized", "region_count", "skip_reason", "section_id", "question_text", "type", "answered",
        F.array_join("display_list", ", ").alias("display_list"))


@query
def section_results(spark, sf):
    return questionnaire.section_results(_enriched(spark, sf), "submission_id").drop("section_pos") \
        .withColumns({"alert_flags": F.array_join("alert_flags", " | "), "details": F.array_join("details", ", ")})


@query
def alert_flags(spark, sf):
    return questionnaire.alert_flags(A.submissions(spark, sf)).select("submission_id", "question_id", "alert_flag")


@query
def completion_counts(spark, sf):
    return questionnaire.completion_counts(A.submissions(spark, sf)).drop("user_id", "submitted_at")


@query
def clinical_summary(spark, sf):
    return questionnaire.clinical_summary(_enriched(spark, sf), "submission_id") \
        .withColumns({"areas_of_concern": F.array_join(F.transform("areas_of_concern", lambda a: F.concat_ws(
            ": ", a["section_id"], a["area"], a["clinical_area"], F.when(a["severity_score"].isNull(), "-").otherwise(F.format_string("%.1f", a["severity_score"])),
            F.coalesce(a["severity_label"], F.lit("-")), F.coalesce(F.array_join(a["details"], ", "), F.lit("-")))), " | "),
                      "clinical_areas_affected": F.array_join("clinical_areas_affected", ", "),
                      "alert_flags": F.array_join("alert_flags", " | ")})


@query
def submission_messages(spark, sf):
    return messages.with_messages(_enriched(spark, sf, True)).select("submission_id", F.posexplode_outer("messages").alias("p", "m")) \
        .select("submission_id", (F.col("p") + 1).alias("pos"), "m.role", "m.content")


@query
def triage_status(spark, sf):
    return messages.triage_status(questionnaire.enrich(A.sparse_submissions(spark, sf), talk=True), A.derived_records(spark, sf))


@query
def pending_questionnaires(spark, sf):
    return messages.pending_questionnaires(A.submissions(spark, sf), A.derived_records(spark, sf)) \
        .select("submission_id", "user_id")


@query
def shape_messages(spark, sf):
    return messages.shape_messages(A.turns(spark, sf), "Be brief.")


@query
def turn_counts(spark, sf):
    return messages.turn_counts(A.turns(spark, sf))


@query
def next_question(spark, sf):
    return next_question_ops.next_question(A.respondents(spark, sf), A.question_list())


# -- maintenance ------------------------------------------------------------

def _assessment_files(spark, sf):
    """Assessments written as one JSON file each, by a streaming-free Spark job in the shared folder."""
    root = shared_dir(spark, "assessment-files")
    docs = A.events(spark, sf).where(F.col("event_id") % 50 == 0).select(
        F.concat(F.lit("patient_p"), "user_id", F.lit("_assessment_"), "event_id", F.lit(".json")).alias("name"),
        F.concat(F.lit('{"timestamp": "'), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('", "conversation_notes": "note '), "event_id",
                 F.lit('",\n"symptoms": '), A.symptom_json(), F.when(F.col("event_id") % 350 == 0, F.lit("")).otherwise(F.lit("}"))).alias("body"))
    json_files.write_documents(docs, root)
    return root


@query
def assessment_files(spark, sf):
    """Every readable document of a directory of files; every seventh is cut off and skipped."""
    docs = json_files.read_assessment_json(spark, _assessment_files(spark, sf))
    return docs.select("file_patient_id", "timestamp", "conversation_notes", F.size(S.symptom_entries(F.col("symptoms"))).alias("n_symptoms"))


@query
def patient_ids(spark, sf):
    return json_files.list_patients(spark, _assessment_files(spark, sf))


@query
def table_overview(spark, sf):
    names = ["customer", "orders", "events", "supplier", "nation", "conversations"]
    return tables.table_overview({n: read_table(spark, sf, n) for n in names})


@query
def footer_overview(spark, sf):
    """Counts and key ranges from the footers of the files alone."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
    return stored.footer_overview(spark, {n: (f"{sf}/{n}.parquet", key) for n, key in keys.items()})


@query
def delete_stored(spark, sf):
    """What is left of a stored table after users are deleted from the files that hold them."""
    path = shared_dir(spark, "deletions")
    A.checkins(spark, sf).select("user_id", "checkin_id").repartitionByRange(16, "user_id").write.parquet(path)
    doomed = A.users(spark, sf).where((F.col("c_mktsegment") == "MACHINERY") & (F.col("user_id") % 3 == 0)).select("user_id")
    stored.delete_rows(spark, path, doomed, ["user_id"])
    return spark.read.parquet(path)


@query
def upsert_stored(spark, sf):
    """Profiles in a keyed table after the latest updates of a fifth of the users."""
    path = shared_dir(spark, "profiles")
    patients = A.users(spark, sf).select("user_id", "username", F.col("c_mktsegment").alias("checkups"), F.lit(0).cast("long").alias("height"))
    updates = A.profile_updates(spark, sf).where(F.col("user_id") % 5 == 0)
    table = stored.KeyedTable(spark, path, ["user_id"])
    table.upsert(patients)
    known = table.read(spark.read.parquet(path).schema).drop("_bucket")
    changed = tables.apply_profile_updates(known, updates, ["checkups", "height"], ["updated_at", "update_id"])
    table.upsert(changed.join(updates.select("user_id").distinct(), "user_id", "left_semi"))
    return spark.read.parquet(path).drop("_bucket")


@query
def quarantine_signups(spark, sf):
    """Valid rows, quarantined rows and broken rules of sign-ups, from one pass."""
    rows = A.pending_signups(spark, sf).withColumns({
        "password": F.lit("secret"), "email": F.concat(F.lit("p"), "pending_id", F.when(
            F.col("pending_id") % 4 == 0, F.lit("example.org")).otherwise(F.lit("@example.org")))})
    ok, bad, counts = stored.quarantine(rows, quality.signup_rules(), shared_dir(spark, "quarantine"))
    broken = spark.createDataFrame([(k, v) for k, v in counts.items() if k[0] != "_"], "violations string, pending_id long")
    return ok.select(F.lit("valid").alias("part"), "pending_id", F.lit("").alias("violations")).unionByName(
        bad.select(F.lit("quarantine").alias("part"), "pending_id", F.array_join("violations", "|").alias("violations"))).unionByName(
        broken.select(F.lit("broken").alias("part"), "pending_id", "violations"))


@query
def latest_row(spark, sf):
    rows = A.assessments(spark, sf).select("assessment_id", "user_id", "created_at")
    return tables.latest_row(rows, "created_at", "assessment_id")


def _cascade(spark, sf):
    users = A.users(spark, sf).select(F.col("user_id").alias("username"), "c_mktsegment")
    related = {"answers": A.checkins(spark, sf).select("user_id", "checkin_id"),
               "assessments": A.events(spark, sf).select("user_id", "event_id"),
               "questionnaire_drafts": A.turns(spark, sf).select((-1 - F.col("conv_id")).alias("user_id"))}
    doomed = users.where(F.col("c_mktsegment") == "MACHINERY").select("username")
    return tables.cascade_delete(users, related, doomed)


@query
def cascade_delete_counts(spark, sf):
    return _cascade(spark, sf)[1]


@query
def cascade_delete_survivors(spark, sf):
    keys = {"users": "username", "answers": "checkin_id", "assessments": "event_id", "questionnaire_drafts": "user_id"}
    parts = [df.select(F.lit(name).alias("collection"),
                       (F.lit(None) if name == "users" else F.col("user_id")).cast("long").alias("user_id"), F.col(keys[name]).cast("string").alias("key"))
             for name, df in _cascade(spark, sf)[0].items()]
    return reduce(DataFrame.unionByName, parts)


@query
def insert_if_absent(spark, sf):
    new = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("achievement_id"),
        F.col("o_orderkey").alias("at"))
    existing = A.users(spark, sf).where(F.col("c_nationkey") < 10) \
        .select("user_id", F.lit("5-LOW").alias("achievement_id"))
    return tables.insert_if_absent(new, existing, ["user_id", "achievement_id"], "at")


@query
def latest_draft(spark, sf):
    removed = A.users(spark, sf).where(F.col("c_mktsegment") == "MACHINERY")
    return tables.without_users(tables.latest_draft(A.drafts(spark, sf), "event_id"), removed)


@query
def write_append(spark, sf):
    rows = A.assessments(spark, sf).select("assessment_id", "user_id", "flag_for_oncologist",
                                           F.date_format("created_at", "yyyy-MM-dd").alias("date"))
    path = shared_dir(spark, "assessments")
    tables.write_append(rows, path, ["date"])
    return spark.read.schema(rows.schema).parquet(path)


@query
def apply_profile_updates(spark, sf):
    patients = A.users(spark, sf).select("user_id", "username", F.col("c_mktsegment").alias("checkups"),
                                         F.lit(0).cast("long").alias("height"))
    return tables.apply_profile_updates(patients, A.profile_updates(spark, sf), ["checkups", "height"],
                                        ["updated_at", "update_id"])


# -- quality ----------------------------------------------------------------

def _codes(df, rules, key):
    return quality.conformance(df, rules).select(key, F.array_join("violations", "|").alias("violations"))


@query
def conformance_assessments(spark, sf):
    return _codes(A.assessments(spark, sf), quality.assessment_rules(), "assessment_id")


@query
def conformance_triage(spark, sf):
    return _codes(A.assessments(spark, sf), quality.triage_rules(), "assessment_id")


@query
def conformance_submissions(spark, sf):
    key = F.col("o_orderkey")
    rows = read_table(spark, sf, "orders").select(
        key.alias("submission_id"), (key % 16).alias("sections_completed"),
        (key % 15).alias("total_sections"), (key % 120).alias("completion_percentage"))
    return _codes(rows, quality.submission_rules(), "submission_id")


@query
def conformance_signups(spark, sf):
    rows = A.pending_signups(spark, sf).withColumns({
        "password": F.lit("secret"), "email": F.concat(F.lit("p"), "pending_id", F.when(
            F.col("pending_id") % 4 == 0, F.lit("example.org")).otherwise(F.lit("@example.org")))})
    return _codes(rows, quality.signup_rules(), "pending_id")


@query
def default_records(spark, sf):
    t = F.col("triage")
    rows = A.assessments(spark, sf).select(
        "assessment_id", "symptoms", t.isNull().alias("triage_failed"),
        t["alert_level"].alias("triage_alert_level"), t["alert_rationale"].alias("triage_rationale"),
        t["recommended_timeline"].alias("triage_timeline"), F.lit("").alias("triage_notes"),
        t["key_symptoms"].alias("triage_key_symptoms"))
    out = escalation.with_default_records(rows, F.col("assessment_id") % 9)
    return out.select("assessment_id", F.size("symptoms").alias("n_symptoms"), "conversation_notes",
                      F.array_join("triage_key_symptoms", "|").alias("triage_key_symptoms"), "triage_alert_level", "triage_rationale", "triage_timeline", "triage_notes")


# -- streams, each driven over the whole table ------------------------------

@query
def stream_streaks(spark, sf):
    checkins = A.stream_table(spark, sf, "events").select("user_id", "ts")
    log = jobs.run_available(jobs.stream_streaks(checkins), "streaks")
    return log.groupBy("user_id").agg(F.max(F.struct("day", "streak", "longest_streak")).alias("s")) \
        .select("user_id", F.date_from_unix_date("s.day").alias("last_day"), "s.streak", "s.longest_streak")


@query
def stream_sessions(spark, sf):
    minutes = (F.col("conv_id") * 60 + F.col("turn") * 10).cast("int")
    messages_in = A.stream_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"),
        F.timestamp_add("MINUTE", minutes, F.lit("2024-01-01").cast("timestamp")).alias("ts"),
        (F.col("turn") == 0).alias("is_start"))
    return jobs.run_available(jobs.stream_sessions(messages_in), "sessions") \
        .select("session_id", "message_id", "accepted")


@query
def stream_streaks_resumed(spark, sf):
    """The first half of the month is stored history, the rest a stream; users whose streak went on or began anew."""
    cut = "2024-01-16"
    history = streaks.active_days(A.activity_days(spark, sf).where(F.col("ts") < cut))
    checkins = A.stream_table(spark, sf, "events").select("user_id", "ts").where(F.col("ts") >= cut)
    log = jobs.run_available(jobs.stream_streaks(checkins, history), "streaks-resumed")
    return log.groupBy("user_id").agg(F.max(F.struct("day", "streak", "longest_streak")).alias("s")) \
        .select("user_id", F.date_from_unix_date("s.day").alias("last_day"), "s.streak", "s.longest_streak")


@query
def stream_codes(spark, sf):
    """Sign-ups issue a code, clicks enter one; an hour to live, so all of them live through one run."""
    rows = A.events(spark, sf, A.stream_table(spark, sf, "events")).where(F.col("event_type").isin("signup", "click")).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("use_id"), F.col("created_at").alias("at"),
        (F.col("k") % 3).alias("code"), (F.col("event_type") == "signup").alias("issued"))
    root = shared_dir(spark, "codes")
    out = jobs.stream_codes(rows, 3600)
    jobs.run_once(out, f"{root}/out", f"{root}/progress")
    return spark.read.schema(out.schema).parquet(f"{root}/out").select(F.col("key").alias("user_id"), "use_id", "accepted")


@query
def stream_doctor_alerts(spark, sf):
    """The newest alerts of each doctor, kept by a stream over all assessments."""
    rows = A.derive_assessments(spark, sf, A.stream_table(spark, sf, "events"))
    log = jobs.run_available(jobs.stream_doctor_alerts(rows, A.assignments(spark, sf)), "newest-alerts")
    return stateful.current_alerts(log, rows.schema).select(
        "doctor_id", "rank", "session_id", "user_id", "alert_level", "oncologist_notification_level", "created_at")


@query
def stream_alerts(spark, sf):
    rows = A.derive_assessments(spark, sf, A.stream_table(spark, sf, "events")).select(
        "assessment_id", "user_id", "flag_for_oncologist", "oncologist_notification_level")
    root = shared_dir(spark, "alerts")
    jobs.stream_alerts(rows, A.assignments(spark, sf), f"{root}/out", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/out") \
        .select("doctor_id", "assessment_id", "user_id", "oncologist_notification_level")


@query
def stream_enrich(spark, sf):
    rows = jobs.stream_enrich(A.derive_submissions(spark, sf, A.stream_table(spark, sf, "orders"))).select(
        "submission_id", "completion.questions_shown", "completion.questions_answered",
        "summary.symptom_count", "summary.max_severity", "summary.max_severity_area")
    return jobs.run_available(rows, "enriched")


@query
def stream_insert_if_absent(spark, sf):
    new = A.stream_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("achievement_id"),
        F.col("o_orderkey").alias("at"))
    root = shared_dir(spark, "unlocks")
    jobs.stream_insert_if_absent(new, f"{root}/out", f"{root}/progress",
                                 ["user_id", "achievement_id"], "at").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*new.columns)


# -- histories --------------------------------------------------------------

@query
def questionnaire_history(spark, sf):
    rows = A.submissions(spark, sf).select("user_id", "submission_id", "submitted_at", F.size("answers").alias("answered"))
    return ranking.newest_n(rows, "user_id", ["submitted_at", "submission_id"], 10)


@query
def patient_assessments(spark, sf):
    rows = accounts.drop_sensitive(triage.with_triage(A.assessments(spark, sf))).select(
        "user_id", "assessment_id", "created_at", "alert_level", F.array_size("symptoms").alias("n_symptoms"))
    return ranking.newest_n(rows, "user_id", ["created_at", "assessment_id"], 20)


@query
def upcoming_events(spark, sf):
    return scheduling.upcoming(A.calendar_events(spark, sf), "2024-01-10", 10).withColumn(
        "attendees", F.array_join("attendees", "; "))


@query
def scored_submissions(spark, sf):
    return reports.scored_submissions(
        A.submissions(spark, sf), A.derived_records(spark, sf), "submission_id", F.size("messages").alias("n_messages"),
        F.col("summary.symptom_count").alias("symptom_count")).select(
        "submission_id", "session_id", "n_messages", "symptom_count")
