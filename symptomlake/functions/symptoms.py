"""Symptom documents and the notification rules built on them.

Everywhere in the library an assessment carries ``symptoms`` as an ordered
``array<struct<symptom, shape, severity_rating, frequency_rating, severity_text,
key_indicators, additional_notes, location>>``. Document order is kept because
"first triggering symptom" and first-seen tie-breaks depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dims

RATED, TEXT, LISTED = "rated", "text", "listed"

ENTRY_FIELDS = ("symptom string, shape string, severity_rating int, frequency_rating int, "
                "severity_text string, key_indicators array<string>, additional_notes string, "
                "location string")
SYMPTOMS_TYPE = f"array<struct<{ENTRY_FIELDS}>>"

_RATED_DDL = ("struct<severity_rating:string,frequency_rating:string,severity:string,"
              "key_indicators:array<string>,additional_notes:string,location:string>")
_LISTED_DDL = "array<struct<symptom:string,severity:string>>"


def _entry(symptom, shape, sev=None, freq=None, text=None, keys=None, notes=None, place=None):
    null = F.lit(None)
    return F.struct(
        symptom.alias("symptom"), F.lit(shape).alias("shape"),
        (null if sev is None else sev).cast("int").alias("severity_rating"),
        (null if freq is None else freq).cast("int").alias("frequency_rating"),
        (null if text is None else text).cast("string").alias("severity_text"),
        (null if keys is None else keys).cast("array<string>").alias("key_indicators"),
        (null if notes is None else notes).cast("string").alias("additional_notes"),
        (null if place is None else place).cast("string").alias("location"))


def symptom_entries(json_text: Column) -> Column:
    """Decode a ``symptoms`` document in any of its three historical shapes.

    * object of objects with numeric ratings  -> ``rated``
    * object whose value is plain text        -> ``text`` (no ratings)
    * list of records with worded severity    -> ``listed``

    A string map keeps the document order of the keys.
    """
    doc = F.trim(json_text)

    def rated(kv):
        body = F.from_json(kv["value"], _RATED_DDL)
        return _entry(kv["key"], RATED, body["severity_rating"].try_cast("int"),
                      body["frequency_rating"].try_cast("int"), body["severity"],
                      body["key_indicators"], body["additional_notes"], body["location"])

    from_object = F.transform(
        F.map_entries(F.from_json(doc, "map<string,string>")),
        lambda kv: F.when(F.ltrim(kv["value"]).startswith("{"), rated(kv))
        .otherwise(_entry(kv["key"], TEXT)))
    from_list = F.transform(
        F.from_json(doc, _LISTED_DDL),
        lambda r: _entry(r["symptom"], LISTED, text=r["severity"]))
    return F.coalesce(F.when(doc.startswith("["), from_list).otherwise(from_object),
                      F.array().cast(SYMPTOMS_TYPE))


def no_symptoms() -> Column:
    return F.array().cast(SYMPTOMS_TYPE)


def entries(symptoms: Column) -> Column:
    """A missing document counts as one without symptoms."""
    return F.coalesce(symptoms, no_symptoms())


def severity_sum(symptoms: Column) -> Column:
    """Sum of the numeric severities of one assessment, zeros included."""
    return F.aggregate(entries(symptoms), F.lit(0),
                       lambda acc, s: acc + F.coalesce(s["severity_rating"], F.lit(0)))


def rated_severity(s: Column) -> Column:
    """Severity of an entry in the daily statistics: a rated entry without a
    severity counts as 0, text and listed entries carry none."""
    return F.when(s["shape"] == RATED, F.coalesce(s["severity_rating"], F.lit(0)))


def mean_severity_parts(symptoms: Column) -> tuple[Column, Column]:
    """(sum, count) of the rated severities of one assessment."""
    rated = F.filter(entries(symptoms), lambda s: s["shape"] == RATED)
    total = F.aggregate(rated, F.lit(0), lambda acc, s: acc + rated_severity(s))
    return total, F.size(rated)


def max_severity(symptoms: Column) -> Column:
    """Highest severity of one assessment, 0 when there is none."""
    return F.aggregate(entries(symptoms), F.lit(0),
                       lambda acc, s: F.greatest(acc, F.coalesce(s["severity_rating"], F.lit(0))))


def escalation(symptoms: Column, treatment_status: Column) -> Column:
    """struct(flag, level, reason) of the first symptom over its limits.

    Missing ratings count as 1. A treatment status without limits never flags.
    """
    def rate(s, field):
        return F.coalesce(s[field], F.lit(1))

    def over(s, status):
        freq_limit, sev_limit = dims.ESCALATION_LIMITS[status]
        return ((rate(s, "frequency_rating") >= freq_limit)
                | (rate(s, "severity_rating") >= sev_limit))

    def first_over(status):
        return F.get(F.filter(entries(symptoms), lambda s: over(s, status)), F.lit(0))

    treating, remission = dims.TREATMENT_STATUSES
    first_hit = F.when(treatment_status == treating, first_over(treating)) \
        .when(treatment_status == remission, first_over(remission))
    who = F.when(treatment_status == "in_remission", F.lit(" in remission patient")) \
        .otherwise(F.lit(""))
    reason = F.concat(F.lit("Severe "), first_hit["symptom"], who, F.lit(" - high frequency ("),
                      rate(first_hit, "frequency_rating").cast("string"), F.lit(") or severity ("),
                      rate(first_hit, "severity_rating").cast("string"), F.lit(")"))
    hit = first_hit.isNotNull()
    return F.struct(
        hit.alias("flag"),
        F.when(hit, F.lit("amber")).otherwise(F.lit("none")).alias("level"),
        F.when(hit, reason).otherwise(F.lit("")).alias("reason"))


def merge_notification(structured_level: Column, structured_flag: Column,
                       triage_present: Column, triage_level: Column) -> Column:
    """struct(alert_level, level, flag) from the symptom rules and the triage.

    RED and ORANGE override both outputs; YELLOW lifts ``none`` to amber but
    leaves the flag as it was.
    """
    level = F.coalesce(structured_level, F.lit("none"))
    flag = F.coalesce(structured_flag, F.lit(False))
    alert = F.when(triage_present, F.coalesce(triage_level, F.lit("UNKNOWN"))) \
        .otherwise(F.lit("UNKNOWN"))
    return F.struct(
        alert.alias("alert_level"),
        F.when(alert == "RED", F.lit("red")).when(alert == "ORANGE", F.lit("amber"))
        .when((alert == "YELLOW") & (level == "none"), F.lit("amber"))
        .otherwise(level).alias("level"),
        (flag | alert.isin("RED", "ORANGE")).alias("flag"))


def is_flagged(flag: Column, level: Column) -> Column:
    """Rows that belong on an alert list."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(level.isin("amber", "red"), F.lit(False))


def severity_level(level: Column, part: str = "name") -> Column:
    """Name or colour of a severity level 1..5, with the neutral default."""
    index = {"name": 0, "color": 1}[part]
    out = F.lit(dims.SEVERITY_DEFAULT[index])
    for value, parts in dims.SEVERITY_LEVELS.items():
        out = F.when(level == value, F.lit(parts[index])).otherwise(out)
    return out


def describe_alert(level: Column, language: Column) -> Column:
    """Sentence for an alert level; every language but ``zh-HK`` reads English."""
    lang = F.when(language == "zh-HK", F.lit("zh-HK")).otherwise(F.lit("en"))
    out = F.concat(F.lit("Unknown alert level: "), F.coalesce(level, F.lit("None")))
    for code, texts in dims.ALERT_DESCRIPTIONS.items():
        for name, sentence in texts.items():
            out = F.when((lang == code) & (level == name), F.lit(sentence)).otherwise(out)
    return out
