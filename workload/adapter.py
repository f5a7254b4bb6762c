"""Clinical views over the generic star-schema test tables.

Deterministic integer formulas give the generic columns clinical meaning. The
same formulas are restated in DuckDB SQL in ``workload.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symptomlake import dims
from symptomlake.functions import symptoms as S
from symptomlake.functions.questionnaire import text
from symptomlake.session import shared_dir
from symptomlake.sources.tables import read_table

AS_OF = "2024-01-28"       # a Sunday: the week of 22-28 January is complete
AS_OF_DAY = "2024-01-30"   # last day with events

_STORED: dict[tuple, str] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the given tables: a table that has changed is derived anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def stored(spark: SparkSession, sf_dir: str, name: str, build, files: int | None = None) -> DataFrame:
    """A table derived from the given tables once per application, in ``files`` files.

    Analytics run on stored documents; writing the derived table to the shared
    folder first gives the queries a real scan with pushed filters and pruned
    columns instead of the formulas below. The given tables may be a single row
    group each, which is one task however many cores there are; so what is made
    from them is dealt over ``files`` parts first (by default as many as there
    are cores), at every size.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, files, _stamp(spark, sf_dir))
    if key not in _STORED:
        path = f"{shared_dir(spark, name)}/data"
        build(files or spark.sparkContext.defaultParallelism).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def prepared(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A given table, dealt over ``files`` files."""
    return stored(spark, sf_dir, f"dealt-{name}", lambda n: read_table(spark, sf_dir, name).repartition(n), files)


def events(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    if source is None:
        source = prepared(spark, sf_dir, "events")
    return source.select(
        "event_id", "user_id", F.col("ts").alias("created_at"),
        "event_type", "value",
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int").alias("k"))


def _severity(i: int) -> Column:
    return ((F.floor(F.col("k") / F.lit(i + 1)) + F.col("event_id") + i) % 6).cast("int")


def _frequency(i: int) -> Column:
    return ((F.col("k") + 2 * F.col("event_id") + i) % 5 + 1).cast("int")


def _present(i: int) -> Column:
    return (F.col("k") + i) % 4 != 0


def _worded(i: int) -> Column:
    return (F.col("event_id") + i) % 11 == 0


def _indicators(i: int) -> Column:
    return F.when((F.col("event_id") + i) % 3 != 0, F.transform(
        F.sequence(F.lit(1), (F.col("event_id") % 2 + 1).cast("int")), lambda j: F.concat(F.lit("sign "), j + i)))


def _notes(i: int) -> Column:
    return F.when((F.col("event_id") + i) % 5 == 0, F.concat(F.lit("note "), F.col("event_id")))


def symptom_array() -> Column:
    """Ordered symptom entries; some are worded only, some documents are absent."""
    rows = []
    for i, name in enumerate(dims.TARGET_SYMPTOMS):
        rows.append(F.when(_present(i), F.when(_worded(i), S._entry(F.lit(name), S.TEXT)).otherwise(
            S._entry(F.lit(name), S.RATED, _severity(i), _frequency(i), keys=_indicators(i), notes=_notes(i)))))
    return F.when(F.col("event_id") % 13 != 0,
                  F.filter(F.array(*rows), lambda s: s.isNotNull()))


def symptom_json() -> Column:
    """The same document as JSON text; every 17th one uses the list shape."""
    as_object, as_list = [], []
    for i, name in enumerate(dims.TARGET_SYMPTOMS):
        body = F.when(_worded(i), F.lit('"mild"')).otherwise(F.concat(
            F.lit('{"severity_rating": '), _severity(i).cast("string"),
            F.lit(', "frequency_rating": '), _frequency(i).cast("string"), F.lit("}")))
        as_object.append(F.when(_present(i), F.concat(F.lit(f'"{name}": '), body)))
        as_list.append(F.when(_present(i), F.concat(
            F.lit(f'{{"symptom": "{name}", "severity": "'),
            F.when(_severity(i) >= 4, F.lit("severe")).otherwise(F.lit("mild")), F.lit('"}'))))
    return F.when(F.col("event_id") % 17 == 0,
                  F.concat(F.lit("["), F.concat_ws(", ", *as_list), F.lit("]"))).otherwise(
        F.concat(F.lit("{"), F.concat_ws(", ", *as_object), F.lit("}")))


def triage_struct() -> Column:
    level = (F.when(F.col("value") < 20, "GREEN").when(F.col("value") < 60, "YELLOW")
             .when(F.col("value") < 120, "ORANGE").otherwise("RED"))
    confidence = F.when(F.col("k") % 4 == 0, "low").when(F.col("k") % 4 == 1, "medium") \
        .when(F.col("k") % 4 == 2, "high")
    keys = F.transform(
        F.filter(F.coalesce(F.col("symptoms"), S.no_symptoms()), lambda s: s["severity_rating"] >= 3),
        lambda s: s["symptom"])
    diagnosis = F.struct(F.lit("review").alias("suspected_diagnosis"),
                         F.lit("low").alias("probability"),
                         (1 + F.col("k") % 5).alias("urgency"), F.lit("").alias("reasoning"))
    return F.when(F.col("event_type").isin("error", "purchase", "click"), F.struct(
        level.alias("alert_level"),
        F.concat(F.lit("rationale "), F.col("event_id")).alias("alert_rationale"),
        F.when(level == "RED", "immediate").otherwise("within 24 hours").alias("recommended_timeline"),
        confidence.alias("confidence_level"),
        keys.alias("key_symptoms"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("because of "), F.col("k"))).alias("clinical_reasoning"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.array(diagnosis).alias("diagnosis_predictions"),
        F.col("treatment_status").alias("treatment_status")))


def sessions(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Finished sessions with their symptom document, before the rules ran."""
    status = (F.when(F.col("user_id") % 10 == 9, "unknown")
              .when(F.col("user_id") % 3 == 0, "in_remission").otherwise("undergoing_treatment"))
    return (events(spark, sf_dir, source)
            .withColumn("session_id", F.concat(F.lit("s"), F.col("event_id").cast("string")))
            .withColumn("treatment_status", status)
            .withColumn("symptoms", symptom_array()))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assessments."""
    return stored(spark, sf_dir, "assessments", lambda n: derive_assessments(spark, sf_dir, prepared(spark, sf_dir, "events", n)))


def derive_assessments(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Symptom rules and triage merged by the library, from events or a stream of them."""
    rows = (sessions(spark, sf_dir, source)
            .withColumn("structured", S.escalation(F.col("symptoms"), F.col("treatment_status")))
            .withColumn("triage", triage_struct()))
    merged = S.merge_notification(F.col("structured.level"), F.col("structured.flag"),
                                  F.col("triage").isNotNull(), F.col("triage.alert_level"))
    return rows.withColumn("m", merged).select(
        F.col("event_id").alias("assessment_id"), "session_id", "user_id", "created_at",
        F.timestamp_add("MINUTE", F.lit(12), F.col("created_at")).alias("completed_at"),
        "treatment_status", "symptoms", "triage",
        F.when(F.col("event_id") % 2 == 0, "en").otherwise("zh-HK").alias("language"),
        F.lit("conversation_with_triage").alias("assessment_type"),
        (F.col("event_id") % 5 != 0).alias("ai_powered"),
        F.col("m.alert_level").alias("alert_level"),
        F.col("m.level").alias("oncologist_notification_level"),
        F.col("m.flag").alias("flag_for_oncologist"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.concat(F.lower(F.col("c_mktsegment")), F.lit("."), F.col("c_custkey").cast("string"),
                 F.lit("@example.org")).alias("email"),
        F.concat(F.lit("Patient "), F.col("c_mktsegment")).alias("full_name"),
        F.lit("hash").alias("password"),
        (F.col("c_custkey") % 10).alias("doctor_id"), "c_nationkey", "c_mktsegment")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doctor_id, user_id); some assigned patients have no profile."""
    return read_table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("doctor_id"),
        F.when(F.col("o_custkey") % 50 == 49, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
        .alias("user_id")).distinct()


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doctor_id"), F.col("s_name").alias("username"),
        F.concat(F.lit("D"), F.col("s_suppkey")).alias("code"))


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.concat(F.when(F.col("n_nationkey") % 5 == 0, "D").otherwise("H"), F.col("n_nationkey"))
        .alias("code"))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily check-ins: one per order."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("checkin_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")),
                    lambda i: i.cast("string")).alias("answers"))


def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts) of everything that counts for the daily streak."""
    return read_table(spark, sf_dir, "events").select(
        "user_id", "ts")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text").alias("content"))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy intervals of a doctor; some are cancelled, some all-day."""
    start = F.col("ts")
    timed = F.col("event_type") != "signup"
    minutes = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), start)
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("doctor_id"),
        F.when(timed, start).alias("start"), F.when(timed, minutes).alias("end"),
        F.to_date(start).alias("start_date"), F.to_date(start).alias("end_date"),
        F.when(F.col("event_type") == "error", "cancelled")
        .when(F.col("event_type") == "view", F.lit(None)).otherwise("confirmed").alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("Visit "), F.col("event_id"))).alias("summary"),
        F.when(F.col("event_id") % 4 != 0, F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int")), lambda i: F.struct(
            F.when((i + F.col("event_id")) % 5 != 0, F.concat(F.lit("guest"), i, F.lit("@example.org"))).alias("email")))).alias("attendees"))


def slot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly slots 0900-1700 on every day a doctor has events, plus a bad one."""
    hours = F.array(*[F.struct(F.lit(f"{h:02d}00").alias("start_time"),
                               F.lit(f"{h + 1:02d}00").alias("end_time")) for h in range(9, 17)],
                    F.struct(F.lit("9am").alias("start_time"), F.lit("1000").alias("end_time")))
    return (read_table(spark, sf_dir, "events")
            .select(F.col("user_id").alias("doctor_id"), F.to_date("ts").alias("date")).distinct()
            .select("doctor_id", "date", F.inline(hours)))


def pending_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups with doctor, hospital and invalid codes and some taken names."""
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))) \
        .when(key % 5 == 1, F.col("c_name")).otherwise(F.concat(F.lit("new"), key))
    code = F.when(key % 3 == 0, F.concat(F.lit("D"), key % 200)) \
        .when(key % 3 == 1, F.concat(F.lit("H"), F.col("c_nationkey"))).otherwise(F.lit("X000"))
    return read_table(spark, sf_dir, "customer").select(
        key.alias("pending_id"), name.alias("username"), code.alias("access_code"))


def junk_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts where a third of all rows share one blank name."""
    name = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")) \
        .when(F.col("o_custkey") % 7 == 0, F.lit("ab")).otherwise(F.concat(F.lit("user"), F.col("o_custkey")))
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("account_id"), name.alias("username"))


def stamped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text: ISO with Z, with offset, plain, and unreadable."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    return read_table(spark, sf_dir, "events").select("event_id", F.when(kind == 0, F.concat(iso, F.lit("Z")))
        .when(kind == 1, F.concat(iso, F.lit("+00:00")))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("soon")).alias("started"))


def _answer(q: int, spec: dict) -> str:
    """Raw JSON fragment of question number ``q`` of order ``o_orderkey``."""
    key, kind, n = "o_orderkey", spec["type"], len(spec["options"])
    opts = "array(" + ", ".join(text(o) for o in spec["options"]) + ")"
    one = f"{opts}[CAST(({key} + {q}) % {max(n, 1)} AS INT)]"
    if kind == "rating":
        lo, hi = int(spec["min"]), int(spec["max"])
        value = f"CAST({lo} + ({key} * 7 + {q * 3}) % {hi - lo + 1} AS STRING)"
    elif kind == "slider":
        steps = round((spec["max"] - spec["min"]) / spec["step"])
        j = f"(({key} + {q}) % {steps + 1})"
        if spec["step"] == 0.5:
            halves = f"({j} + {round(spec['min'] * 2)})"
            value = f"concat(CAST({halves} DIV 2 AS STRING), CASE WHEN {halves} % 2 = 1 THEN '.5' ELSE '' END)"
        else:
            value = f"CAST({j} + {int(spec['min'])} AS STRING)"
    elif kind == "text":
        value = f"concat('note ', {key})"
    elif kind == "single-select":
        value = one
    elif kind == "color-chart":
        value = f"CASE WHEN {key} % 2 = 0 THEN {one} ELSE concat('[\"', {one}, '\"]') END"
    else:
        some = f"CAST(({key} + {q}) % {min(n, 12) + 1} AS INT)"
        value = (f"CASE WHEN {some} = 0 THEN '[]' ELSE concat('[\"', "
                 f"array_join(slice({opts}, 1, {some}), '\",\"'), '\"]') END")
    return f"CASE WHEN ({key} + {q}) % 7 <> 0 THEN {value} END"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored questionnaire submissions."""
    return stored(spark, sf_dir, "submissions", lambda n: derive_submissions(spark, sf_dir, prepared(spark, sf_dir, "orders", n)))


def derive_submissions(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """One questionnaire submission per order, from orders or a stream of them."""
    flat = dims.flat_questions()
    ids = ", ".join(text(spec["question_id"]) for spec in flat)
    answers = F.expr(f"map_filter(map_from_arrays(array({ids}), array({', '.join(f'_a{q}' for q in range(len(flat)))})), "
                     "(k, v) -> v IS NOT NULL)")
    if source is None:
        source = prepared(spark, sf_dir, "orders")
    rows = source.select("o_orderkey", "o_custkey", "o_orderdate")
    # inside the filter the answers would be interpreted; a few to a generator, each is code of a size that the JVM compiles
    for first in range(0, len(flat), 7):
        some = ", ".join(f"'_a{q}', {_answer(q, flat[q])}" for q in range(first, min(first + 7, len(flat))))
        rows = rows.select("*", F.expr(f"inline_outer(array(named_struct({some})))"))
    return rows.select(
        F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("submitted_at"), answers.alias("answers"))


def sparse_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of which a fifth were handed in empty."""
    rows = submissions(spark, sf_dir)
    return rows.withColumn("answers", F.when(
        F.col("submission_id") % 5 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.col("answers")))


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments derived from questionnaires: those of finished orders."""
    return (read_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
            .select(F.concat(F.lit("questionnaire_"), "o_orderkey").alias("session_id"),
                    F.lit("YELLOW").alias("alert_level")))


def question_list() -> list[dict]:
    """The catalogue as numbered questions with prerequisites."""
    flat = dims.flat_questions()
    number = {q["question_id"]: i + 1 for i, q in enumerate(flat)}
    options = {q["question_id"]: list(q["options"]) for q in flat}

    def allowed(q):
        dep, target = options[q["depends_on"]], q["targets"]
        if q["op"] == "gte":
            return [o for o in dep if int(o) >= int(target[0])]
        if q["op"] == "not_eq":
            return [o for o in dep if o != target[0]]
        return target

    return [{"question_number": i + 1, "text": q["text"], "prerequisites": [
        {"question_number": number[q["depends_on"]], "allowed_answers": allowed(q)}] if q["op"] else None}
        for i, q in enumerate(flat)]


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by question number, each as a list of chosen options."""
    numbers = {q["question_id"]: str(i + 1) for i, q in enumerate(dims.flat_questions())}
    number = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    listed = F.map_from_entries(F.transform(F.map_entries(F.col("answers")), lambda e: F.struct(
        number[e["key"]], F.when(e["value"].startswith("["), F.from_json(e["value"], "array<string>"))
        .otherwise(F.array(e["value"])))))
    return submissions(spark, sf_dir).select("submission_id", listed.alias("answers"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "user_id", "event_id", (F.col("k") % 13).alias("current_section"),
        F.col("created_at").alias("last_updated"))


def profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("update_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("checkups"),
        (F.col("o_orderkey") % 50 + 150).alias("height"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of the files it is dealt over."""
    table = prepared(spark, sf_dir, name)
    return spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
