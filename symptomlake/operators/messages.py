"""Message lists: shaping of chats and rendering of questionnaires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed texts
GREETING = ("Hello! I'm going to review your symptom questionnaire responses "
            "to assess how you're feeling today.")
MIN_MESSAGES = 3


def shape_history(history: Column, system_text: str | None = None) -> Column:
    """F21 on a message array: role and content only, one system message first."""
    kept = history if not system_text else F.filter(history, lambda m: m["role"] != "system")
    plain = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    if not system_text:
        return plain
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content"))), plain)


def shape_messages(turns: DataFrame, system_text: str | None = None) -> DataFrame:
    """F21 on turn rows, without collecting a conversation.

    The new system message is a row of its own at turn -1.
    """
    rows = turns.select("conv_id", "turn", "role", "content")
    if not system_text:
        return rows
    head = turns.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"),
        F.lit(system_text).alias("content"))
    return rows.where(F.col("role") != "system").unionByName(head)


def turn_counts(turns: DataFrame) -> DataFrame:
    """F14 on turn rows: messages in total and by the patient."""
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_messages"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _number(value: Column) -> Column:
    """A score without a needless fraction."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def submission_messages(sections: Column, alert_flags: Column) -> Column:
    """an enriched submission as a message array.

    Greeting, then a question and an answer message per section with answers,
    then the alert flags if there are any.
    """
    def lines(s):
        seen = F.filter(s["responses"], lambda r: r["was_shown"] & r["display_value"].isNotNull())
        return F.transform(seen, lambda r: F.concat(
            F.lit("- "), r["question_text"], F.lit(": "), r["display_value"]))

    bound = F.filter(F.transform(sections, lambda s: F.struct(
        s["title"].alias("title"), s["severity_score"].alias("score"),
        s["severity_label"].alias("label"), lines(s).alias("lines"))), lambda b: F.size(b["lines"]) > 0)

    def pair(b):
        note = F.when(b["score"].isNotNull() & (b["label"] != ""), F.concat(
            F.lit("\nOverall severity: "), b["label"], F.lit(" ("), _number(b["score"]), F.lit(")"))) \
            .otherwise(F.lit(""))
        return F.array(
            _message("assistant", F.concat(F.lit("Let me ask about "), b["title"], F.lit("."))),
            _message("user", F.concat(F.lit("Regarding "), b["title"], F.lit(":\n"),
                                      F.array_join(b["lines"], "\n"), note)))

    return _greeted(F.flatten(F.transform(bound, pair)), alert_flags)


def _greeted(talk: Column, alert_flags: Column) -> Column:
    """The messages on the sections between the greeting and the alert flags."""
    flags = F.when(F.size(alert_flags) > 0, F.array(_message("user", F.concat(
        F.lit("Additional concerns I want to flag:\n- "), F.array_join(alert_flags, "\n- ")))))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(_message("assistant", F.lit(GREETING))), talk, F.coalesce(flags, none))


def with_messages(enriched: DataFrame) -> DataFrame:
    """Adds ``messages``, as output of a one-row generator: a later filter on
    them would otherwise render them a second time. Sections already put into
    words (``enrich(talk=True)``) are taken as they are, else read from the responses."""
    flags = F.col("_alerts")
    rendered = _greeted(F.col("talk"), flags) if "talk" in enriched.columns else submission_messages(F.col("sections"), flags)
    # taken out first: the generator would have the whole summary built for its flags
    return enriched.withColumn("_alerts", F.col("summary.alert_flags")).select(
        *(c for c in enriched.columns if c != "talk"), F.inline_outer(F.array(F.struct(rendered.alias("messages")))))


def derived_session_id(submission_id: Column) -> Column:
    return F.concat(F.lit("questionnaire_"), submission_id.cast("string"))


def pending_questionnaires(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submissions without a derived assessment record yet.

    An outer join, as the optimizer would carry an anti join down to the scan,
    where whole answers are shuffled even if ``submissions`` was narrowed before.
    """
    done = assessments.select("session_id", F.lit(True).alias("_done"))
    return (submissions.withColumn("session_id", derived_session_id(F.col("submission_id")))
            .join(done, "session_id", "left").where(F.col("_done").isNull()).drop("_done"))


def triage_status(enriched: DataFrame, assessments: DataFrame) -> DataFrame:
    """skipped (under three messages) / completed / failed / unchanged.

    ``assessments`` has (session_id, alert_level) of derived records; a
    submission may carry its earlier ``triage_status`` and ``triage_error``.
    """
    rows = with_messages(enriched).select(
        "submission_id", F.size("messages").alias("n_messages"),
        *[F.col(c) if c in enriched.columns else F.lit(None).cast("string").alias(c)
          for c in ("triage_status", "triage_error")],
        derived_session_id(F.col("submission_id")).alias("session_id"))
    known = assessments.select("session_id", F.col("alert_level").alias("derived_level"))
    status = (F.when(F.col("n_messages") < MIN_MESSAGES, "skipped")
              .when(F.col("derived_level").isNotNull(), "completed")
              .when(F.col("triage_error").isNotNull(), "failed")
              .otherwise(F.coalesce("triage_status", F.lit("generating"))))
    return rows.join(known, "session_id", "left").select(
        "submission_id", "n_messages", status.alias("triage_status"),
        F.when(status == "completed", F.col("derived_level")).alias("alert_level"))
