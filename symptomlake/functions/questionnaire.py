"""Questionnaire rules as row-local SQL expressions.

A submission carries ``answers`` as ``map<string,string>`` of JSON fragments
(``4``, ``2.5``, ``dry``, ``["a","b"]``). The catalogue is known when the plan is
built, so every rule is specialised per question: a rating gets rating
arithmetic, a diagram gets region counting, and nothing is looked up by type at
run time. Enriching needs neither a join nor a shuffle and runs unchanged on a
stream.

The rules return expression text (use ``F.expr``): ``raw`` is the expression of
the raw answer, ``items`` that of its decoded list.
"""

from __future__ import annotations

from .. import dims

LIST_TYPES = ["multi-select", "color-chart", *dims.DIAGRAM_TYPES]


def text(value: str | None) -> str:
    """SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def answer(qid: str, answers: str = "answers") -> str:
    return f"{answers}[{text(qid)}]"


def held_answer(qid: str) -> str:
    """``answer`` from keys and values held as arrays."""
    return f"get(_values, CAST(array_position(_keys, {text(qid)}) - 1 AS INT))"


def as_list(raw: str) -> str:
    """Elements of a list answer, null for a scalar one.

    Where nothing but ``","`` parts the strings (no other quote, no escape, no
    control character), cutting there gives what the JSON parser would, at a
    fraction of its cost; every other text goes through the parser.
    """
    inner = f"substring({raw}, 3, length({raw}) - 4)"
    plain = (f"startswith({raw}, '[\"') AND endswith({raw}, '\"]') AND length({raw}) BETWEEN 4 AND 10000 "
             f"AND NOT contains(replace({inner}, '\",\"', ''), '\"') AND NOT {raw} RLIKE '[\\\\\\\\\\\\x00-\\\\x1f]'")
    return (f"CASE WHEN {raw} = '[]' THEN CAST(array() AS ARRAY<STRING>) WHEN {plain} THEN split({inner}, '\",\"', -1) "
            f"WHEN startswith({raw}, '[') THEN from_json({raw}, 'array<string>') END")


def some(parts: dict[str, str], kind: str) -> str:
    """Array of the values whose condition holds; ``parts`` maps value to condition.

    Unlike a filter on an array it is generated code throughout.
    """
    none = f"CAST(array() AS ARRAY<{kind}>)"
    if not parts:
        return none
    return "flatten(array(" + ", ".join(f"CASE WHEN {test} THEN array({v}) ELSE {none} END" for v, test in parts.items()) + "))"


def as_number(raw: str) -> str:
    return f"try_cast({raw} AS DOUBLE)"


def _values(items) -> str:
    return ", ".join(text(v) for v in items)


def labels(options: dict) -> str:
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in options.items()) + ")"


def label(options: dict, value: str) -> str:
    """Option label, or the answer itself when the catalogue does not know it."""
    return f"coalesce({labels(options)}[{value}], {value})" if options else value


def lookup(value: str, mapping: dict, default) -> str:
    def lit(v):
        return text(v) if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {value} {cases} ELSE {lit(default)} END"


def is_shown(q: dict, dep: str | None = None, items: str | None = None) -> str:
    """whether a question was shown, from its dependency's raw answer.

    Without a condition it is shown; without a dependency answer it is hidden;
    an unknown operator shows it. ``items`` is the dependency's decoded list,
    where there is one already.
    """
    if not q["op"]:
        return "true"
    dep = dep or answer(q["depends_on"])
    target, listed = q["targets"][0], f"startswith({dep}, '[')"
    scalar = f"NOT {listed}"
    if q["op"] == "gte":
        test = f"{scalar} AND {as_number(dep)} >= {float(target)}D"
    elif q["op"] == "not_eq":
        test = f"{listed} OR {dep} <> {text(target)}"
    elif q["op"] == "eq":
        test = f"{scalar} AND {dep} = {text(target)}"
    elif q["op"] == "in_list":
        test = f"{scalar} AND {dep} IN ({_values(q['targets'])})"
    elif q["op"] == "contains":
        test = f"{listed} AND array_contains({items or as_list(dep)}, {text(target)})"
    else:
        test = f"{dep} IS NOT NULL"
    return f"coalesce({test}, false)"


def display_list(q: dict, items: str) -> str:
    """F5 for list answers: labels element by element."""
    return f"transform({items}, v -> {label(q['options'], 'v')})"


def display_value(q: dict, raw: str, shown_list: str | None = None) -> str:
    """label, joined labels, slider value with unit, or the answer itself."""
    if q["type"] == "slider":
        return f"concat({raw}, {text(q['unit'] or '')})"
    if q["type"] == "text":
        return raw
    one = label(q["options"], raw)
    return f"coalesce(array_join({shown_list}, ', '), {one})" if shown_list else one


def severity_normalized(q: dict, raw: str) -> str:
    """0..1 severity of ratings and sliders, two digits; equal bounds give 0."""
    if q["type"] not in ("rating", "slider"):
        return "CAST(NULL AS DOUBLE)"
    lo, span = float(q["min"]), float(q["max"] - q["min"])
    if span == 0:
        return f"CASE WHEN {raw} IS NOT NULL THEN 0.0D END"
    value = as_number(raw)
    part = f"{float(q['max'])}D - {value}" if q["type"] == "rating" and q["descending"] \
        else f"{value} - {lo}D"
    return f"bround(({part}) / {span}D, 2)"


def region_severity(count: str) -> str:
    cases = " ".join(f"WHEN {count} >= {n} THEN {score}" for n, score in reversed(dims.REGION_SEVERITY))
    return f"CASE {cases} ELSE 0 END"


def _severity(method: str | None, raw: str, items: str, options: dict) -> str:
    if method == "frequency_map":
        names = {k: dims.FREQUENCY_LABELS[v] for k, v in dims.FREQUENCY_SEVERITY.items()}
        score, name = lookup(raw, dims.FREQUENCY_SEVERITY, 0), lookup(raw, names, dims.FREQUENCY_LABELS[0])
    elif method == "region_count":
        score = region_severity(f"coalesce(array_size({items}), 0)")
        name = lookup(score, dims.REGION_LABELS, "Unknown")
    else:
        score, name = f"coalesce({as_number(raw)}, 0)", label(options, raw)
    return f"named_struct('score', CAST({score} AS DOUBLE), 'label', {name})"


def section_severity(section: dict, source: tuple[str, str],
                     fallback: tuple[str, str] | None = None) -> str:
    """struct(score, label) from the source answer, else from the fallback's; a fractional rating stays one.

    Both come as (raw, items) expressions.
    """
    options = {}
    for q in section["questions"]:
        if q["question_id"] == section["severity_source"]:
            options = q["options"]
    own = f"WHEN {source[0]} IS NOT NULL THEN {_severity(section['severity_method'], *source, options)}"
    other = "" if fallback is None else \
        f" WHEN {fallback[0]} IS NOT NULL THEN {_severity(section['fallback_method'], *fallback, {})}"
    return f"CASE {own}{other} END"


def alert_flag(title: str, q: dict, raw: str, items: str | None = None) -> str:
    """F8: the alert text an answer raises, or null; visibility is not considered."""
    kind = q["type"]
    if kind == "rating":
        lead = f"{title}: {q['text'].split('?')[0]} rated "
        return (f"CASE WHEN {as_number(raw)} >= 4 THEN concat({text(lead)}, {label(q['options'], raw)}, "
                f"' (', {raw}, '/5)') END")
    if kind == "single-select":
        return f"CASE WHEN {raw} = '6+' THEN {text(title + ': frequency 6+ times')} END"
    if kind == "color-chart":
        picked = f"coalesce({items}, array({raw}))" if items else f"array({raw})"
        alarming = f"filter({picked}, v -> v IN ({_values(q['alert_values'])}))"
        return (f"CASE WHEN {raw} IS NOT NULL AND arrays_overlap({picked}, array({_values(q['alert_values'])})) THEN concat("
                f"{text(title + ': alarming color reported (')}, "
                f"array_join({display_list(q, alarming)}, ', '), ')') END")
    if kind in dims.DIAGRAM_TYPES and items:
        n = f"array_size({items})"
        return f"CASE WHEN {n} >= 3 THEN concat({text(title + ': ')}, {n}, ' body regions affected') END"
    if kind == "slider" and q["low_limit"] is not None:
        return (f"CASE WHEN {as_number(raw)} <= {float(q['low_limit'])}D THEN concat("
                f"{text(title + ': ')}, {raw}, {text((q['unit'] or '') + ' (critically low)')}) END")
    return "CAST(NULL AS STRING)"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def response(q: dict, raw: str, items: str | None, shown: str, shown_list: str | None,
             flag: str) -> str:
    """F4-F6, F8 and F9 of one question as a struct.

    ``items``, ``shown_list`` and ``flag`` refer to the decoded list, its labels
    and the alert text.
    """
    def seen(value):
        return f"CASE WHEN {shown} THEN {value} END"

    regions = f"array_size({items})" if items and q["type"] in dims.DIAGRAM_TYPES else "CAST(NULL AS INT)"
    return _struct(
        section_pos=str(q["section_pos"]), question_pos=str(q["question_pos"]),
        section_id=text(q["section_id"]), question_id=text(q["question_id"]),
        question_text=text(q["text"]), type=text(q["type"]),
        was_required=str(q["required"]).lower(), was_shown=shown, raw_value=seen(raw),
        display_value=seen(display_value(q, raw, shown_list)),
        display_list=seen(shown_list or "CAST(NULL AS ARRAY<STRING>)"),
        severity_normalized=seen(severity_normalized(q, raw)), region_count=seen(regions),
        skip_reason=f"CASE WHEN NOT {shown} THEN 'conditional_not_met' END",
        answered=answered(raw, items, shown), alert_flag=flag)


def catalogue_rows(questions: list[dict]) -> str:
    """The catalogue as an array of structs, for ``RESPONSE_ROW``."""
    def number(q, value):
        return f"{float(value)}D" if q["type"] in ("rating", "slider") else "CAST(NULL AS DOUBLE)"

    return "array(" + ", ".join(_struct(
        section_pos=str(q["section_pos"]), question_pos=str(q["question_pos"]),
        section_id=text(q["section_id"]), question_id=text(q["question_id"]),
        question_text=text(q["text"]), type=text(q["type"]), was_required=str(q["required"]).lower(),
        unit=text(q["unit"] or ""), options=labels(q["options"]) if q["options"] else "CAST(map() AS MAP<STRING, STRING>)",
        lo=number(q, q["min"]), hi=number(q, q["max"]),
        span="CAST(NULL AS DOUBLE)" if q["type"] not in ("rating", "slider") else f"{float(q['max'] - q['min'])}D",
        falling=str(bool(q["type"] == "rating" and q["descending"])).lower(),
        diagram=str(q["type"] in dims.DIAGRAM_TYPES).lower()) for q in questions) + ")"


def _seen(value: str) -> str:
    return f"CASE WHEN _shown THEN {value} END"


#: ``response`` for exploded rows, where ``_q`` is the question's row of the
#: catalogue, ``_given`` the raw answer and ``_items``, ``_lists``, ``_shown`` its own.
RESPONSE_ROW = {
    **{name: f"_q.{name}" for name in ("section_pos", "question_pos", "section_id", "question_id",
                                       "question_text", "type", "was_required")},
    "was_shown": "_shown", "raw_value": _seen("_given"),
    "display_value": _seen("CASE _q.type WHEN 'slider' THEN concat(_given, _q.unit) WHEN 'text' THEN _given "
                           "ELSE coalesce(array_join(_lists, ', '), _q.options[_given], _given) END"),
    "display_list": _seen("_lists"),
    "severity_normalized": _seen(
        "CASE WHEN _q.span = 0 THEN CASE WHEN _given IS NOT NULL THEN 0.0D END WHEN _q.span IS NOT NULL THEN "
        f"bround(CASE WHEN _q.falling THEN _q.hi - {as_number('_given')} ELSE {as_number('_given')} - _q.lo END "
        "/ nullif(_q.span, 0.0D), 2) END"),
    "region_count": _seen("CASE WHEN _q.diagram THEN array_size(_items) END"),
    "skip_reason": "CASE WHEN NOT _shown THEN 'conditional_not_met' END",
    "answered": "(_shown AND _given IS NOT NULL AND coalesce(array_size(_items) > 0, true))",
}


def answered(raw: str, items: str | None, shown: str) -> str:
    """Shown, given, and not an empty list."""
    filled = f" AND coalesce(array_size({items}) > 0, true)" if items else ""
    return f"({shown} AND {raw} IS NOT NULL{filled})"


def section_result(section_pos: int, section: dict, severity: str, flags: list[str],
                   lists: list[str]) -> str:
    """F7, F8 and F10 of one section.

    ``flags`` are the alert texts of the questions that can raise one, ``lists``
    the visible label lists of all.
    """
    alerts = some({f: f"{f} IS NOT NULL" for f in flags}, "STRING")
    concern = "(" + " OR ".join([f"coalesce({severity}.score > 0, false)", *(f"{f} IS NOT NULL" for f in flags)]) + ")"
    listed = [v for v, q in zip(lists, section["questions"])
              if q["type"] in ("multi-select", "body-diagram", "muscle-diagram")]
    none = "CAST(array() AS ARRAY<STRING>)"
    details = "flatten(array(" + ", ".join(f"coalesce({v}, {none})" for v in listed) + "))" if listed else None
    return _struct(
        section_pos=str(section_pos), section_id=text(section["section_id"]),
        title=text(section["title"]), clinical_area=text(section["clinical_area"]),
        severity_score=f"{severity}.score", severity_label=f"{severity}.label",
        alert_flags=alerts, is_concern=concern,
        details=f"CASE WHEN {concern} AND array_size({details}) > 0 THEN {details} END" if details
        else "CAST(NULL AS ARRAY<STRING>)")


def summary(sections: list[dict], result: list[str], worst: str) -> dict[str, str]:
    """A23 from the section results: concerns, their worst severity, areas affected and all flags in order."""
    area = ("section_id STRING, area STRING, clinical_area STRING, severity_score DOUBLE, severity_label STRING, "
            "details ARRAY<STRING>")
    concerns = {_struct(section_id=f"{r}.section_id", area=f"{r}.title", clinical_area=f"{r}.clinical_area",
                        severity_score=f"{r}.severity_score", severity_label=f"{r}.severity_label",
                        details=f"{r}.details"): f"{r}.is_concern" for r in result}
    fields = ", ".join(f.replace(" ", ": ", 1) for f in area.split(", "))
    affected = {}
    for s, r in zip(sections, result):
        affected.setdefault(s["clinical_area"], []).append(f"{r}.is_concern")
    known = sorted(affected, key=lambda a: (a is None, a or ""))
    return {
        "areas_of_concern": some(concerns, f"STRUCT<{fields}>"),
        "symptom_count": "(" + " + ".join(f"CAST({r}.is_concern AS INT)" for r in result) + ")",
        "max_severity": worst,
        "max_severity_area": "CASE " + " ".join(
            f"WHEN {r}.is_concern AND {r}.severity_score = {worst} THEN {r}.title" for r in result) + " END",
        "clinical_areas_affected": some({text(a): "(" + " OR ".join(affected[a]) + ")" for a in known}, "STRING"),
        "alert_flags": "flatten(array(" + ", ".join(f"{r}.alert_flags" for r in result) + "))"}


def worst_severity(result: list[str]) -> str:
    return "array_max(array(" + ", ".join(f"CASE WHEN {r}.is_concern THEN {r}.severity_score END" for r in result) + "))"


def answer_line(q: dict, raw: str, shown: str, shown_list: str | None) -> str:
    """one line for a shown question with an answer, else null."""
    return f"CASE WHEN {shown} THEN concat({text('- ' + q['text'] + ': ')}, {display_value(q, raw, shown_list)}) END"


def said(section: dict, lines: str, severity: str) -> str:
    """the patient's message on a section, from its joined answer lines; null without any."""
    score, name = f"{severity}.score", f"{severity}.label"
    number = f"CASE WHEN {score} = floor({score}) THEN CAST(CAST({score} AS BIGINT) AS STRING) ELSE CAST({score} AS STRING) END"
    note = (f"CASE WHEN {score} IS NOT NULL AND {name} <> '' THEN concat('\nOverall severity: ', {name}, ' (', {number}, ')') "
            f"ELSE '' END")
    return f"CASE WHEN {lines} <> '' THEN concat({text('Regarding ' + section['title'] + ':')}, '\n', {lines}, {note}) END"


def talk(sections: list[dict], said: list[str]) -> str:
    """a question and an answer message for each section with answers."""
    kind = "STRUCT<role: STRING, content: STRING>"
    pairs = [f"CASE WHEN {own} IS NOT NULL THEN array(" + ", ".join(
        (_struct(role="'assistant'", content=text(f"Let me ask about {s['title']}.")), _struct(role="'user'", content=own)))
        + f") ELSE CAST(array() AS ARRAY<{kind}>) END" for s, own in zip(sections, said)]
    return f"flatten(array({', '.join(pairs)}))"
