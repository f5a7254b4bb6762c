"""Questionnaire enrichment: responses, section results and clinical summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..functions import questionnaire as Q


def _array(parts: list[str]):
    return F.expr("array(" + ", ".join(parts) + ")")


def _held(parts: list[str]):
    """An array that is computed once: reads of a plain ``array(...)`` by index
    would be replaced by its elements and recomputed at every use."""
    return F.expr("concat(array(" + ", ".join(parts) + "))")


def _fenced(df: DataFrame, keep: list[str], **fields: str) -> DataFrame:
    """Adds computed columns as output of a one-row generator.

    A later filter on them then tests the finished values; through a plain
    projection the optimizer would copy the whole computation into the filter.
    Filters on the kept columns still pass down to the scan.
    """
    row = ", ".join(f"'{name}', {expr}" for name, expr in fields.items())
    return df.select(*keep, F.expr(f"inline_outer(array(named_struct({row})))"))


def _in_parts(df: DataFrame, size: int, **fields: str) -> DataFrame:
    """Adds computed columns, ``size`` to a generator: each is generated as a
    method of its own, of a size that the JVM compiles."""
    names = list(fields)
    for first in range(0, len(names), size):
        df = _fenced(df, df.columns, **{name: fields[name] for name in names[first:first + size]})
    return df


def _number(catalogue) -> dict[str, int]:
    return {q["question_id"]: i for i, q in enumerate(dims.flat_questions(catalogue))}


def _listed(q: dict, name: str, i: int) -> str | None:
    return f"{name}[{i}]" if q["type"] in Q.LIST_TYPES else None


STAGED = ["_raw", "_items", "_shown", "_lists", "_flags"]


def _stage(submissions: DataFrame, catalogue) -> DataFrame:
    """Raw answers, decoded lists, visibility, labels and alert texts.

    Each is computed once per row, as an array in catalogue order that later
    steps refer to by index. Keys and values are copied out of the columnar batch
    first, where each lookup would decode all keys again.
    """
    flat = dims.flat_questions(catalogue)
    number = _number(catalogue)

    def raw(qid):
        return f"_raw[{number[qid]}]" if qid in number else Q.answer(qid)

    no_list = "CAST(NULL AS ARRAY<STRING>)"
    items = [Q.as_list(f"_raw[{i}]") if q["type"] in Q.LIST_TYPES else no_list for i, q in enumerate(flat)]
    listed = {q["question_id"] for q in flat if q["type"] in Q.LIST_TYPES}
    shown = [Q.is_shown(q, raw(q["depends_on"]) if q["depends_on"] else None,
                        f"_items[{number[q['depends_on']]}]" if q["depends_on"] in listed else None) for q in flat]
    lists = [Q.display_list(q, f"_items[{i}]") if q["type"] in Q.LIST_TYPES else no_list for i, q in enumerate(flat)]
    flags = [Q.alert_flag(q["title"], q, f"_raw[{i}]", _listed(q, "_items", i)) for i, q in enumerate(flat)]
    given = _fenced(submissions, submissions.columns, _keys="concat(map_keys(answers))", _values="concat(map_values(answers))")
    given = _in_parts(given, 14, **{f"_v{i}": Q.held_answer(q["question_id"]) for i, q in enumerate(flat)})
    return (given
            .select(*submissions.columns, _held([f"_v{i}" for i in range(len(flat))]).alias("_raw"))
            .withColumn("_items", _held(items))
            .withColumns({"_shown": _held(shown), "_lists": _held(lists), "_flags": _held(flags)}))


def _response_columns(rows: DataFrame, keep: list[str], catalogue) -> tuple[DataFrame, list[str]]:
    """``keep`` and one struct column per question, and the names of those columns.

    As columns of their own the structs are generated as many small methods;
    together in one expression they would outgrow the size of a Java method.
    """
    flat = dims.flat_questions(catalogue)
    names = [f"_r{i}" for i in range(len(flat))]
    parts = [F.expr(Q.response(q, f"_raw[{i}]", _listed(q, "_items", i), f"_shown[{i}]",
                               _listed(q, "_lists", i), f"_flags[{i}]")).alias(name)
             for (i, q), name in zip(enumerate(flat), names)]
    return rows.select(*keep, *parts), names


def with_responses(submissions: DataFrame, catalogue=None) -> DataFrame:
    """Adds ``responses``, one struct per catalogue question, row by row."""
    rows, names = _response_columns(_stage(submissions, catalogue), submissions.columns, catalogue)
    return _fenced(rows, submissions.columns, responses=f"array({', '.join(names)})")


def question_responses(submissions: DataFrame, catalogue=None) -> DataFrame:
    """J3, long form: submission x question without a join.

    The submissions are exploded first, and one rule reads its question from the
    catalogue as a literal; a struct per question would be built and copied
    42 times a row. The array is never empty; the outer form only keeps the
    optimizer from evaluating it twice for a non-empty check.
    """
    keep = [c for c in submissions.columns if c != "answers"]
    rows = _stage(submissions, catalogue).select(
        *keep, "_items", "_shown", "_lists", F.posexplode_outer("_raw").alias("_at", "_given"))
    rows = rows.select(*keep, "_given", F.expr(f"get({Q.catalogue_rows(dims.flat_questions(catalogue))}, _at)").alias("_q"),
                       *(F.expr(f"{name}[_at]").alias(name) for name in ("_items", "_shown", "_lists")))
    return rows.select(*keep, *(F.expr(rule).alias(name) for name, rule in Q.RESPONSE_ROW.items()))


def _raising(catalogue) -> list[int]:
    """Numbers of the questions that can raise an alert flag."""
    return [i for i, q in enumerate(dims.flat_questions(catalogue))
            if Q.alert_flag("", q, "x", _listed(q, "x", 0)) != "CAST(NULL AS STRING)"]


def enrich(submissions: DataFrame, catalogue=None, responses: bool = True, talk: bool = False) -> DataFrame:
    """Full enrichment of every submission: ``sections``, ``completion``, ``summary``.

    Works unchanged on a streaming DataFrame (stateless, no shuffle). Without
    ``responses`` the section results carry no response structs, which is all
    the summaries need; with them they are put in last, so that a query which
    reads none of them does not build them. ``talk`` adds the messages on the
    sections, from which ``messages.with_messages`` renders without the structs.
    Sections are known here, so what goes over them is written out for each:
    generated code, where functions with lambdas are interpreted.
    """
    rows, number = _stage(submissions, catalogue), _number(catalogue)
    sections, flat, raising = catalogue or dims.SECTIONS, dims.flat_questions(catalogue), set(_raising(catalogue))

    def source(qid):
        at = number[qid]
        return f"_raw[{at}]", f"_items[{at}]"

    severities, results, groups, lines, at = [], [], [], [], 0
    for pos, s in enumerate(sections):
        fallback = source(s["fallback_source"]) if s["fallback_source"] else None
        severities.append(Q.section_severity(s, source(s["severity_source"]), fallback))
        mine = range(at, at + len(s["questions"]))
        at = mine.stop
        results.append(Q.section_result(
            pos, s, f"_severity[{pos}]", [f"_flags[{i}]" for i in mine if i in raising],
            [f"CASE WHEN _shown[{i}] THEN _lists[{i}] END" for i in mine]))
        groups.append(f"array({', '.join(f'_r{i}' for i in mine)})")
        lines.append("concat_ws('\\n', " + ", ".join(Q.answer_line(
            flat[i], f"_raw[{i}]", f"_shown[{i}]", _listed(flat[i], "_lists", i)) for i in mine) + ")")
    rows, keep = rows.withColumn("_severity", _held(severities)), list(submissions.columns)
    staged = [*STAGED, "_severity"]
    if talk:
        rows = _in_parts(rows, 2, **{f"_lines{pos}": line for pos, line in enumerate(lines)})
        rows = _in_parts(rows, 3, **{f"_said{pos}": Q.said(s, f"_lines{pos}", f"_severity[{pos}]") for pos, s in enumerate(sections)})
        said = [f"_said{pos}" for pos in range(len(sections))]
        keep, staged = [*keep, *said], [*staged, *said]
    if responses:
        rows, _ = _response_columns(rows, [*submissions.columns, *staged], catalogue)
        rows, keep = rows.withColumn("_responses", F.expr(f"array({', '.join(groups)})")), [*keep, "_responses"]
    counts = ", ".join(f"'{name}', {expr}" for name, expr in _completion(catalogue).items())
    names = [f"_s{pos}" for pos in range(len(results))]
    rows = rows.select(*keep, F.expr(f"named_struct({counts})").alias("_completion"),
                       *(F.expr(result).alias(name) for result, name in zip(results, names)))
    rows = _fenced(rows, keep, **{name: name for name in names}, completion="_completion")
    rows = rows.withColumn("_worst", F.expr(Q.worst_severity(names)))
    if responses:
        made = [F.col(name).withField("responses", F.col("_responses")[pos]) for pos, name in enumerate(names)]
    else:
        made = [F.col(name) for name in names]
    summary = F.struct(*(F.expr(rule).alias(name) for name, rule in Q.summary(sections, names, "_worst").items()))
    spoken = [F.expr(Q.talk(sections, said)).alias("talk")] if talk else []
    return rows.select(*submissions.columns, F.array(*made).alias("sections"), "completion", summary.alias("summary"), *spoken)


def _completion(catalogue) -> dict[str, str]:
    """Totals over all questions of a submission."""
    flat = dims.flat_questions(catalogue)

    def count(tests):
        return " + ".join(f"CAST({t} AS INT)" for t in tests)
    return {"total_questions": str(len(flat)),
            "questions_shown": count(f"_shown[{i}]" for i in range(len(flat))),
            "questions_answered": count(Q.answered(f"_raw[{i}]", _listed(q, "_items", i), f"_shown[{i}]")
                                        for i, q in enumerate(flat))}


def section_results(enriched: DataFrame, *keys: str) -> DataFrame:
    """Long section rows of enriched submissions."""
    return enriched.select(*keys, F.inline_outer("sections")).drop("responses")


def completion_counts(submissions: DataFrame, catalogue=None) -> DataFrame:
    """A22 alone: counters straight from the answers, given fields passed on."""
    keep = [c for c in submissions.columns if c != "answers"]
    return _fenced(_stage(submissions, catalogue), keep, **_completion(catalogue))


def alert_flags(submissions: DataFrame, catalogue=None) -> DataFrame:
    """F8, long form: one row per alert text."""
    keep = [c for c in submissions.columns if c != "answers"]
    ids = F.expr("array(" + ", ".join(Q.text(q["question_id"]) for q in dims.flat_questions(catalogue)) + ")")
    rows = _stage(submissions, catalogue).select(*keep, F.posexplode_outer("_flags").alias("_at", "alert_flag"))
    return rows.where(F.col("alert_flag").isNotNull()).select(*keep, F.get(ids, F.col("_at")).alias("question_id"), "alert_flag")


def clinical_summary(enriched: DataFrame, *keys: str) -> DataFrame:
    """A23 columns of enriched submissions."""
    return enriched.select(*keys, "summary.*")
