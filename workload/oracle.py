"""DuckDB SQL with the same meaning as the registered queries.

Shared relations are written once as CTE texts and prefixed on demand.
"""

from __future__ import annotations

from symptomlake import dims

D = "strftime({}, '%Y-%m-%d')".format
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')".format


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]" if not v else \
                "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def mean_scaled(s: str, n: str, digits: int = 1, ties: str = "even") -> str:
    """The mean times 10**digits as it prints: decimal output rounds the exact binary value, halves to even.

    A mean that is exactly halfway is an odd number of quarters (one digit) or eighths (two); ``ties="up"`` lifts it.
    """
    mean = f"(CAST({s} AS DOUBLE) / CAST({n} AS DOUBLE))"
    shown = f"CAST(round(CAST(printf('%.{digits}f', {mean}) AS DOUBLE) * {10**digits}) AS BIGINT)"
    if ties == "up":
        parts = f"({mean} * {2 ** (digits + 1)})"
        shown = f"CASE WHEN {parts} = floor({parts}) AND CAST({parts} AS BIGINT) % 2 = 1 " \
            f"THEN CAST(ceil({mean} * {10**digits}) AS BIGINT) ELSE {shown} END"
    return f"CASE WHEN {n} > 0 THEN {shown} END"


def mean_rounded(s: str, n: str, digits: int = 1, ties: str = "even") -> str:
    return f"(({mean_scaled(s, n, digits, ties)}) / {float(10**digits)})"


# ---------------------------------------------------------------------------
# shared relations
# ---------------------------------------------------------------------------
_CHARTED = ["fatigue", "pain", "cough", "nausea", "lack_of_appetite"]
CTE: dict[str, str] = {}
ORDER: list[str] = []


def cte(name: str, sql: str) -> None:
    CTE[name] = sql
    ORDER.append(name)


def with_(names: str, body: str) -> str:
    """Prefix ``body`` with the named relations and what they need."""
    need = set()

    def visit(n):
        for other in ORDER:
            if other != n and other not in need and f"{{{other}}}" in CTE[n]:
                visit(other)
        need.add(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({_plain(CTE[n])})" for n in ORDER if n in need]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _plain(sql: str) -> str:
    for n in ORDER:
        sql = sql.replace(f"{{{n}}}", n)
    return sql


cte("sym", "SELECT * FROM (VALUES " + _values(enumerate(dims.TARGET_SYMPTOMS)) + ") t(i, symptom)")
cte("ev", """SELECT event_id, user_id, ts AS created_at, event_type, value,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
    CASE WHEN user_id % 10 = 9 THEN 'unknown' WHEN user_id % 3 = 0 THEN 'in_remission'
         ELSE 'undergoing_treatment' END AS treatment_status,
    CASE WHEN event_type IN ('error', 'purchase', 'click') THEN
         CASE WHEN value < 20 THEN 'GREEN' WHEN value < 60 THEN 'YELLOW'
              WHEN value < 120 THEN 'ORANGE' ELSE 'RED' END END AS triage_level,
    event_type IN ('error', 'purchase', 'click') AS has_triage
    FROM events""")
cte("raw_reports", """SELECT event_id AS assessment_id, user_id, created_at, treatment_status, has_triage, i, symptom,
    (event_id + i) % 11 = 0 AS worded,
    CASE WHEN (event_id + i) % 11 <> 0 THEN CAST((k // (i + 1) + event_id + i) % 6 AS INTEGER) END AS severity,
    CASE WHEN (event_id + i) % 11 <> 0 THEN CAST((k + 2 * event_id + i) % 5 + 1 AS INTEGER) END AS frequency
    FROM {ev}, {sym} WHERE (k + i) % 4 <> 0""")
cte("reports", "SELECT * FROM {raw_reports} WHERE assessment_id % 13 <> 0")
cte("detail", """SELECT *, CASE symptom WHEN 'fatigue' THEN 'Energy Level' WHEN 'lack_of_appetite' THEN 'Appetite' WHEN 'nausea' THEN 'Nausea'
      WHEN 'cough' THEN 'Cough' WHEN 'pain' THEN 'Pain' END AS name,
    CASE symptom WHEN 'fatigue' THEN '⚡' WHEN 'lack_of_appetite' THEN '🍽️' WHEN 'nausea' THEN '🤢' WHEN 'cough' THEN '💨' WHEN 'pain' THEN '💊' END AS icon,
    coalesce(frequency, 1) AS f, coalesce(severity, 1) AS s,
    CASE WHEN worded OR (assessment_id + i) % 3 = 0 THEN '' WHEN assessment_id % 2 = 0 THEN 'sign ' || (i + 1)
      ELSE 'sign ' || (i + 1) || ',sign ' || (i + 2) END AS keys,
    CASE WHEN NOT worded AND (assessment_id + i) % 5 = 0 THEN 'note ' || assessment_id ELSE '' END AS notes FROM {reports}""")
cte("hits", """SELECT assessment_id, symptom, coalesce(frequency, 1) AS f, coalesce(severity, 1) AS s, treatment_status,
    row_number() OVER (PARTITION BY assessment_id ORDER BY i) AS rn
    FROM {reports} WHERE (treatment_status = 'undergoing_treatment' AND (coalesce(frequency, 1) >= 5 OR coalesce(severity, 1) >= 3))
       OR (treatment_status = 'in_remission' AND (coalesce(frequency, 1) >= 4 OR coalesce(severity, 1) >= 4))""")
cte("structured", """SELECT e.event_id AS assessment_id, h.assessment_id IS NOT NULL AS flag,
    CASE WHEN h.assessment_id IS NOT NULL THEN 'amber' ELSE 'none' END AS level,
    CASE WHEN h.assessment_id IS NULL THEN '' ELSE 'Severe ' || h.symptom ||
      CASE WHEN h.treatment_status = 'in_remission' THEN ' in remission patient' ELSE '' END ||
      ' - high frequency (' || h.f || ') or severity (' || h.s || ')' END AS reason
    FROM {ev} e LEFT JOIN {hits} h ON h.assessment_id = e.event_id AND h.rn = 1""")
cte("a", """SELECT e.event_id AS assessment_id, 's' || e.event_id AS session_id, e.user_id, e.created_at, e.k, e.value,
    e.treatment_status, e.has_triage, e.triage_level, coalesce(e.triage_level, 'UNKNOWN') AS alert_level,
    (s.flag OR coalesce(e.triage_level IN ('RED', 'ORANGE'), FALSE)) AS flag,
    CASE WHEN e.triage_level = 'RED' THEN 'red' WHEN e.triage_level = 'ORANGE' THEN 'amber'
         WHEN e.triage_level = 'YELLOW' AND s.level = 'none' THEN 'amber' ELSE s.level END AS level,
    CASE e.k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence,
    CASE WHEN e.event_id % 2 = 0 THEN 'en' ELSE 'zh-HK' END AS language
    FROM {ev} e JOIN {structured} s ON s.assessment_id = e.event_id""")
cte("whole", """SELECT a.assessment_id, a.user_id, 'conversation' AS type, 'AI Chat' AS title, a.session_id, a.created_at,
    a.created_at + INTERVAL '12 minutes' AS completed_at, a.assessment_id % 5 <> 0 AS ai_powered, coalesce(n, 0) AS symptoms_tracked,
    coalesce(names, '') AS symptoms_assessed, coalesce(n, 0) AS symptoms_known, coalesce(said, '') AS symptoms_data,
    coalesce(total, 0) / greatest(coalesce(n, 0), 1) AS avg_severity, CASE WHEN flag THEN CAST(1 AS BIGINT) ELSE 0 END AS alerts_today,
    treatment_status, level AS oncologist_notification_level, flag AS flag_for_oncologist
    FROM {a} a LEFT JOIN (SELECT assessment_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS total, string_agg(symptom, '|' ORDER BY i) AS names,
      string_agg(concat_ws(':', symptom, name, icon, f, s, keys, notes, 'true'), '|' ORDER BY i) AS said FROM {detail} GROUP BY 1) r USING (assessment_id)""")
cte("users_v", """SELECT c_custkey AS user_id, c_name AS username,
    lower(c_mktsegment) || '.' || c_custkey || '@example.org' AS email,
    'Patient ' || c_mktsegment AS full_name, c_custkey % 10 AS doctor_id, c_nationkey, c_mktsegment FROM customer""")

# ---------------------------------------------------------------------------
# weekly
# ---------------------------------------------------------------------------
WEEK0 = "created_at >= TIMESTAMP '2024-01-22' AND created_at < TIMESTAMP '2024-01-29'"
WEEK1 = "created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22'"
cte("wk", f"SELECT * FROM {{a}} WHERE {WEEK0}")
cte("wr", f"SELECT * FROM {{reports}} WHERE {WEEK0} AND severity > 0")
cte("daily", f"""SELECT u.user_id, d.day, coalesce({mean_scaled('r.total', 'r.n')}, 0) AS tenths,
    coalesce(c.n, 0) AS assessment_count, c.n IS NOT NULL AS has_data, d.i
    FROM (SELECT DISTINCT user_id FROM {{wk}}) u
    CROSS JOIN (SELECT i, CAST(DATE '2024-01-22' + CAST(i AS INTEGER) AS DATE) AS day FROM range(7) t(i)) d
    LEFT JOIN (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM {{wk}} GROUP BY 1, 2) c
      ON c.user_id = u.user_id AND c.day = d.day
    LEFT JOIN (SELECT user_id, CAST(created_at AS DATE) AS day, CAST(sum(severity) AS BIGINT) AS total, count(*) AS n
               FROM {{wr}} GROUP BY 1, 2) r ON r.user_id = u.user_id AND r.day = d.day""")
cte("trend", """SELECT user_id, CASE WHEN n1 = 0 OR n2 = 0 THEN 'Insufficient Data'
      WHEN s2 * n1 - s1 * n2 < -5 * n1 * n2 THEN 'Improving'
      WHEN s2 * n1 - s1 * n2 > 5 * n1 * n2 THEN 'Concerning' ELSE 'Stable' END AS overall_trend
    FROM (SELECT user_id,
      CAST(coalesce(sum(tenths) FILTER (i < 3 AND has_data AND tenths > 0), 0) AS BIGINT) AS s1,
      count(*) FILTER (i < 3 AND has_data AND tenths > 0) AS n1,
      CAST(coalesce(sum(tenths) FILTER (i > 3 AND has_data AND tenths > 0), 0) AS BIGINT) AS s2,
      count(*) FILTER (i > 3 AND has_data AND tenths > 0) AS n2
      FROM {daily} GROUP BY user_id)""")
cte("persym", """SELECT user_id, symptom, CAST(sum(severity) AS BIGINT) AS total, count(*) AS n,
    min(struct_pack(c := created_at, a := assessment_id, i := i)) AS seen FROM {wr} GROUP BY 1, 2""")
cte("top_sym", f"""SELECT user_id, array_to_string(list_transform(string_split(symptom, '_'), lambda x: upper(x[1]) || substr(x, 2)), ' ') AS symptom_name,
    {mean_rounded('total', 'n')} AS avg_severity
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total / n DESC, seen) AS rn FROM {{persym}})
    WHERE rn = 1""")


def _joined(parts: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(parts) + ")"


def weekly_cards(offset: int) -> str:
    ctx = {0: "this week", 1: "last week"}[offset]
    now = offset == 0

    def tail(t):
        return t if now else ""
    cards = [
        f"CASE WHEN n = 0 THEN 'no_data (info, fa-info-circle, No Data Available): No assessments found for {ctx}. Complete some assessments to see analytics.' END",
        f"CASE WHEN alerts > 3 THEN 'high_alerts (critical, fa-exclamation-triangle, High Alert Activity): You had ' || alerts || ' oncologist alerts {ctx}."
        f"{tail(' Consider reaching out to your care team.')}' END",
        f"CASE WHEN top_avg > 3.5 THEN 'concerning_symptom (warning, fa-heartbeat, Monitor ' || top_name || '): Your ' || lower(top_name) || ' averaged ' || top_avg || '/5 {ctx}.' END",
        f"CASE WHEN trend = 'Improving' THEN 'improving_trend (positive, fa-chart-line, Positive Trend): Your symptoms showed an improving trend {ctx}."
        f"{tail(' Keep up the good work!')}' END",
        f"CASE WHEN n >= 5 THEN 'consistent_tracking (positive, fa-check-circle, Consistent Tracking): You completed ' || n || ' assessments {ctx}.{tail(' Great job!')}' END",
    ]
    if now:
        cards.append("CASE WHEN n > 0 AND n < 3 THEN 'low_engagement (info, fa-calendar-check, More Check-ins Recommended): Try to complete daily check-ins for better health insights.' END")
    return _joined(cards)


cte("week_head", """SELECT u.user_id, coalesce(w.n, 0) AS n, coalesce(w.alerts, 0) AS alerts,
    coalesce(w.a0, 0) AS alerts_none, coalesce(w.a1, 0) AS alerts_amber, coalesce(w.a2, 0) AS alerts_red,
    t.symptom_name AS top_name, t.avg_severity AS top_avg, coalesce(d.overall_trend, 'No Data') AS trend
    FROM {users_v} u
    LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (flag) AS alerts,
        count(*) FILTER (level = 'none') AS a0, count(*) FILTER (level = 'amber') AS a1,
        count(*) FILTER (level = 'red') AS a2 FROM {wk} GROUP BY 1) w USING (user_id)
    LEFT JOIN {top_sym} t USING (user_id) LEFT JOIN {trend} d USING (user_id)""")

SQL: dict[str, str] = {
    "week_window": with_("a", f"""SELECT assessment_id, user_id, {TS('created_at')} AS created_at,
        {D("date_trunc('week', created_at)")} AS week_start FROM a WHERE {WEEK1}"""),
    "weekly_daily_series": with_("daily", f"""SELECT user_id, {D('day')} AS day, tenths / 10.0 AS avg_severity,
        assessment_count, has_data FROM daily"""),
    "weekly_severity_by_symptom": with_("persym", f"""SELECT user_id, symptom, n,
        {mean_rounded('total', 'n')} AS avg_severity FROM persym"""),
    "most_concerning_symptom": with_("top_sym", "SELECT * FROM top_sym"),
    "weekly_alerts": with_("wk", """SELECT user_id, count(*) FILTER (level = 'none') AS alerts_none,
        count(*) FILTER (level = 'amber') AS alerts_amber, count(*) FILTER (level = 'red') AS alerts_red,
        count(*) FILTER (flag) AS total_alerts FROM wk GROUP BY 1"""),
    "weekly_trend": with_("trend", "SELECT * FROM trend"),
    "symptom_trend_matrix": with_("wr", f"""SELECT user_id, symptom, {D('created_at::DATE')} AS day,
        CAST(severity AS BIGINT) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY user_id, symptom,
        created_at::DATE ORDER BY created_at DESC, assessment_id DESC) AS rn FROM wr) WHERE rn = 1"""),
    "weekly_report": with_("week_head daily", """SELECT user_id, 'This Week' AS week_label, CAST(0 AS BIGINT) AS week_offset,
        '2024-01-22' AS week_start, '2024-01-28' AS week_end, n AS total_assessments, alerts AS total_alerts,
        alerts_none, alerts_amber, alerts_red, top_name AS top_symptom, top_avg AS top_avg_severity,
        trend AS overall_trend, days.said AS daily_data FROM week_head
        LEFT JOIN (SELECT user_id, string_agg(strftime(day, '%Y-%m-%d') || ' ' || printf('%.1f', tenths / 10.0) || ' ' || assessment_count
            || ' ' || has_data, '; ' ORDER BY day) AS said FROM daily GROUP BY 1) days USING (user_id)"""),
    "weekly_insights": with_("week_head", f"""SELECT user_id, {weekly_cards(0)} AS insights FROM week_head"""),
}

# ---------------------------------------------------------------------------
# monthly
# ---------------------------------------------------------------------------
MONTH = "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01'"
cte("mon", f"SELECT *, CAST(day(created_at) AS BIGINT) AS dom FROM {{a}} WHERE {MONTH}")
cte("mrep", f"SELECT *, CAST(day(created_at) AS BIGINT) AS dom FROM {{reports}} WHERE {MONTH}")
SQL |= {
    "month_window": with_("a", f"""SELECT assessment_id, user_id, {TS('created_at')} AS created_at,
        CAST(month(created_at) AS BIGINT) AS month FROM a
        WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01'"""),
    "monthly_alerts_by_day": with_("mon", """SELECT user_id, dom AS day_of_month, count(*) AS alerts
        FROM mon WHERE flag GROUP BY 1, 2"""),
    "monthly_symptom_heatmap": with_("mrep", """SELECT user_id, symptom, dom AS day_of_month,
        CAST(max(severity) AS BIGINT) AS severity FROM mrep WHERE NOT worded GROUP BY 1, 2, 3"""),
    "monthly_severity_by_day": with_("mrep", """SELECT user_id, dom AS day_of_month, max(m) AS severity FROM (
        SELECT user_id, dom, assessment_id, CAST(sum(severity) AS BIGINT) / count(*) AS m FROM mrep WHERE NOT worded
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
    "available_symptoms": with_("mrep", "SELECT DISTINCT user_id, symptom FROM mrep"),
    "monthly_report": with_("mon users_v", """SELECT u.user_id, coalesce(m.n, 0) AS total_assessments,
        coalesce(m.alerts, 0) AS total_alerts, 'January 2024' AS month_label, CAST(0 AS BIGINT) AS month_offset,
        CAST(2024 AS BIGINT) AS year, CAST(1 AS BIGINT) AS month, '2024-01-01' AS month_start,
        '2024-01-31' AS month_end, CAST(31 AS BIGINT) AS days_in_month
        FROM users_v u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (flag) AS alerts FROM mon GROUP BY 1) m
        USING (user_id)"""),
}

# ---------------------------------------------------------------------------
# rules, triage, care team
# ---------------------------------------------------------------------------
TITLE = "array_to_string(list_transform(string_split({}, '_'), lambda x: upper(x[1]) || substr(x, 2)), ' ')".format


def _case(column: str, mapping: dict, default: str = "NULL") -> str:
    def q(v):
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {column} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


cte("tri", """SELECT a.*, CASE WHEN triage_level = 'RED' THEN 'immediate' ELSE 'within 24 hours' END AS timeline,
    'rationale ' || assessment_id AS rationale, coalesce(ks.keys, '') AS key_symptoms
    FROM {a} a LEFT JOIN (SELECT assessment_id, string_agg(symptom, '|' ORDER BY i) AS keys FROM {reports}
      WHERE severity >= 3 GROUP BY 1) ks USING (assessment_id) WHERE has_triage""")
cte("tri_rank", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, assessment_id DESC) AS newest_rank
    FROM {tri}""")
cte("assign", """SELECT DISTINCT o_custkey % 10 AS doctor_id,
    CASE WHEN o_custkey % 50 = 49 THEN -o_custkey ELSE o_custkey END AS user_id FROM orders""")
_TRI = f"""user_id, session_id, {TS('created_at')} AS created_at, triage_level AS alert_level, rationale AS alert_rationale,
    timeline AS recommended_timeline, confidence AS confidence_level, treatment_status, key_symptoms,
    'review:low:' || (1 + k % 5) || ':' AS diagnosis_predictions, CASE WHEN k % 3 <> 0 THEN 'because of ' || k END AS clinical_reasoning,
    strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS triage_timestamp"""
SQL |= {
    "flatten_symptoms": with_("raw_reports", """SELECT assessment_id, user_id,
        row_number() OVER (PARTITION BY assessment_id ORDER BY i) - 1 AS pos, symptom,
        CASE WHEN assessment_id % 17 = 0 THEN 'listed' WHEN worded THEN 'text' ELSE 'rated' END AS shape,
        CASE WHEN assessment_id % 17 <> 0 THEN CAST(severity AS BIGINT) END AS severity_rating,
        CASE WHEN assessment_id % 17 <> 0 THEN CAST(frequency AS BIGINT) END AS frequency_rating,
        CASE WHEN assessment_id % 17 = 0 THEN CASE WHEN (k // (i + 1) + assessment_id + i) % 6 >= 4
             THEN 'severe' ELSE 'mild' END END AS severity_text
        FROM (SELECT r.*, e.k FROM raw_reports r JOIN (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
              FROM events) e ON e.event_id = r.assessment_id)"""),
    "escalate": with_("structured", "SELECT assessment_id, flag, level, reason FROM structured"),
    "merge_notification": with_("a", """SELECT assessment_id, alert_level, level AS oncologist_notification_level,
        flag AS flag_for_oncologist FROM a"""),
    "assemble_assessments": with_("a", f"""SELECT session_id, user_id, alert_level, level AS oncologist_notification_level,
        flag AS flag_for_oncologist, 'en' AS language, 'keyboard' AS input_mode, 'completed' AS state,
        FALSE AS ai_powered, 'conversation_with_triage' AS assessment_type FROM a"""),
    "flagged": with_("a", "SELECT assessment_id, user_id, level FROM a WHERE flag OR level IN ('amber', 'red')"),
    "with_triage": with_("a", "SELECT assessment_id, triage_level FROM a WHERE has_triage"),
    "describe_alerts": with_("a", "SELECT assessment_id, CASE WHEN language = 'zh-HK' THEN "
        + _case("alert_level", dims.ALERT_DESCRIPTIONS["zh-HK"], "'Unknown alert level: ' || alert_level") + " ELSE "
        + _case("alert_level", dims.ALERT_DESCRIPTIONS["en"], "'Unknown alert level: ' || alert_level")
        + " END AS alert_description FROM a"),
    "severity_level": with_("reports", "SELECT assessment_id, symptom, "
        + _case("severity", {1: "Minimal", 2: "Mild", 3: "Moderate", 4: "Severe", 5: "Extreme"}, "''") + " AS level_name, "
        + _case("severity", {1: "#4caf50", 2: "#8bc34a", 3: "#ffc107", 4: "#ff9800", 5: "#f44336"}, "'#999'")
        + " AS level_color FROM reports"),
    "latest_triage": with_("tri_rank", f"SELECT {_TRI} FROM tri_rank WHERE newest_rank = 1"),
    "triage_history": with_("tri_rank", f"SELECT {_TRI}, newest_rank FROM tri_rank WHERE newest_rank <= 10"),
    "triage_levels": with_("tri", "SELECT user_id, triage_level AS alert_level, count(*) AS n FROM tri GROUP BY 1, 2"),
    "triage_stats": with_("tri users_v", f"""SELECT u.user_id, coalesce(n, 0) AS total_assessments,
        coalesce(g, 0) AS n_green, coalesce(y, 0) AS n_yellow, coalesce(o, 0) AS n_orange, coalesce(r, 0) AS n_red,
        CAST(0 AS BIGINT) AS n_unknown, coalesce({mean_rounded('c', 'n', 2)}, 0.0) AS average_confidence
        FROM users_v u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (triage_level = 'GREEN') AS g,
          count(*) FILTER (triage_level = 'YELLOW') AS y, count(*) FILTER (triage_level = 'ORANGE') AS o,
          count(*) FILTER (triage_level = 'RED') AS r,
          CAST(sum(CASE confidence WHEN 'low' THEN 1 WHEN 'high' THEN 3 ELSE 2 END) AS BIGINT) AS c
          FROM tri GROUP BY 1) s USING (user_id)"""),
    "top_key_symptoms": with_("reports", """SELECT user_id, rank, symptom, n FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS rank FROM (
          SELECT user_id, symptom, count(*) AS n, min(struct_pack(c := created_at, a := assessment_id, i := i)) AS seen
          FROM reports WHERE has_triage AND severity >= 3 GROUP BY 1, 2)) WHERE rank <= 5"""),
    "care_panel": with_("assign users_v tri_rank", f"""SELECT doctor_id, u.user_id, username, email,
        t.triage_level AS latest_alert_level, {TS('t.created_at')} AS last_assessment_date
        FROM assign JOIN (SELECT user_id, username, email FROM users_v) u USING (user_id)
        LEFT JOIN (SELECT * FROM tri_rank WHERE newest_rank = 1) t USING (user_id)"""),
    "doctor_alerts": with_("assign a tri", f"""SELECT doctor_id, rank, session_id, user_id, alert_level, alert_rationale,
        key_symptoms, recommended_timeline, confidence_level, oncologist_notification_level, assessment_type, created_at
        FROM (SELECT doctor_id, row_number() OVER (PARTITION BY doctor_id ORDER BY a.created_at DESC, a.assessment_id DESC) AS rank,
          a.session_id, a.user_id, a.alert_level, t.rationale AS alert_rationale, coalesce(t.key_symptoms, '') AS key_symptoms,
          t.timeline AS recommended_timeline, t.confidence AS confidence_level, a.level AS oncologist_notification_level,
          'conversation_with_triage' AS assessment_type, {TS('a.created_at')} AS created_at
          FROM assign s JOIN a ON a.user_id = s.user_id LEFT JOIN tri t ON t.assessment_id = a.assessment_id
          WHERE a.flag OR a.level IN ('amber', 'red')) WHERE rank <= 50"""),
    "accessible_rows": with_("assign a users_v", """SELECT DISTINCT v.viewer_id, a.user_id, a.assessment_id FROM (
          SELECT 'p' || user_id AS viewer_id, user_id FROM users_v
          UNION SELECT 'd' || s_suppkey, g.user_id FROM supplier JOIN assign g ON g.doctor_id = s_suppkey) v
        JOIN a ON a.user_id = v.user_id"""),
}

# smart insights: cards of the newest triaged assessment (records of every shape)
cte("shaped", """SELECT r.assessment_id, r.symptom, r.assessment_id % 17 = 0 AS listed,
    (e.k // (r.i + 1) + r.assessment_id + r.i) % 6 >= 4 AS severe
    FROM {raw_reports} r JOIN {ev} e ON e.event_id = r.assessment_id""")
cte("facts", """SELECT t.user_id, t.triage_level, t.k, coalesce(s.n, 0) AS n, coalesce(s.severe, 0) AS severe, coalesce(s.mild, 0) AS mild
    FROM {tri_rank} t LEFT JOIN (SELECT assessment_id, count(*) AS n, count(*) FILTER (listed AND severe) AS severe,
      count(*) FILTER (listed AND NOT severe) AS mild FROM {shaped} GROUP BY 1) s USING (assessment_id)
    WHERE t.newest_rank = 1""")
SQL["smart_insights"] = with_("facts", """SELECT user_id, array_to_string(list_slice(CASE WHEN len(c) < 2
      THEN list_concat(c, ['general_health_tip:info:info:general_health_tip_description', 'wellness_reminder:success:favorite:wellness_reminder_description']) ELSE c END, 1, 4), '|') AS insights
    FROM (SELECT user_id, list_filter([
      CASE triage_level WHEN 'GREEN' THEN 'all_good:success:check_circle:all_good_description' WHEN 'YELLOW' THEN 'monitor_closely:warning:warning:monitor_closely_description' ELSE 'attention_needed:error:error:attention_needed_description' END,
      CASE WHEN severe > 0 THEN 'high_severity_symptoms:warning:warning:high_severity_symptoms_description' END,
      CASE WHEN n > 0 AND mild * 10 >= n * 7 THEN 'symptoms_improving:success:trending_up:symptoms_improving_description' END,
      CASE WHEN 1 + k % 5 >= 4 THEN 'high_priority_conditions:error:medical_services:high_priority_conditions_description' END], lambda x: x IS NOT NULL) AS c FROM facts)""")

# ---------------------------------------------------------------------------
# timeline, listings, accounts
# ---------------------------------------------------------------------------
cte("tl", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS user_id, 'daily_checkin' AS type, o_orderdate AS date,
      'Daily Check-in' AS title, 'Completed questionnaire with ' || (o_orderkey % 4 + 1) || ' responses' AS summary,
      o_orderkey % 4 + 1 AS questions_answered, NULL AS total_messages, NULL AS user_messages, NULL AS symptoms_assessed,
      NULL AS oncologist_notification_level, NULL AS flag_for_oncologist FROM orders
    UNION ALL SELECT CAST(a.assessment_id AS VARCHAR), a.user_id, 'conversation', a.created_at, 'AI Chat', 'AI conversation completed',
      NULL, 0, 0, coalesce(n, 0), level, flag
      FROM {a} a LEFT JOIN (SELECT assessment_id, count(*) AS n FROM {reports} GROUP BY 1) r USING (assessment_id)""")
SQL |= {
    "timeline": with_("tl", f"SELECT * REPLACE ({TS('date')} AS date) FROM tl"),
    "timeline_counts": with_("tl", """SELECT user_id, count(*) AS total_assessments,
        count(*) FILTER (type = 'daily_checkin') AS daily_checkins, count(*) FILTER (type = 'conversation') AS conversations
        FROM tl GROUP BY 1"""),
    "lookup_records": with_("whole", f"""SELECT CAST(assessment_id AS VARCHAR) AS id, user_id, type, title, session_id,
        {TS('created_at')} AS date, {TS('completed_at')} AS completed_at, ai_powered, symptoms_tracked, symptoms_assessed, symptoms_known,
        symptoms_data, avg_severity, alerts_today, treatment_status, oncologist_notification_level, flag_for_oncologist,
        'AI conversation completed' AS summary, NULL AS answers, NULL AS questions_answered, NULL AS completion_time FROM whole
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_custkey, 'daily_checkin', 'Daily Check-in', NULL, {TS('o_orderdate')}, NULL, NULL, NULL,
          NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          'Completed questionnaire with ' || (o_orderkey % 4 + 1) || ' responses', array_to_string(list_transform(range(o_orderkey % 4 + 1), lambda x: CAST(x AS VARCHAR)), ','),
          o_orderkey % 4 + 1, {TS('o_orderdate')} FROM orders
          WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.assessment_id = o_orderkey AND w.user_id = o_custkey)"""),
    "assessment_detail": with_("whole", f"SELECT * REPLACE ({TS('created_at')} AS created_at, {TS('completed_at')} AS completed_at) FROM whole"),
    "symptom_detail": with_("detail", """SELECT assessment_id, user_id, symptom, name, icon, CAST(f AS BIGINT) AS frequency,
        CAST(s AS BIGINT) AS intensity, keys AS key_indicators, notes AS additional_notes, TRUE AS discussed FROM detail"""),
    "patient_reports": with_("a reports", f"""SELECT a.user_id, {TS('a.created_at')} AS created_at, a.assessment_id, a.session_id, a.language,
        CASE WHEN a.assessment_id % 5 <> 0 THEN 'Yes' ELSE 'No' END AS ai_powered,
        CASE WHEN a.flag THEN 'Yes' ELSE 'No' END AS flagged, upper(a.level) AS notification_level, r.pos,
        {TITLE('r.symptom')} AS symptom, coalesce(CAST(r.frequency AS VARCHAR), CASE WHEN r.symptom IS NOT NULL THEN 'N/A' END) || '/5' AS frequency,
        coalesce(CAST(r.severity AS VARCHAR), CASE WHEN r.symptom IS NOT NULL THEN 'N/A' END) || '/5' AS severity
        FROM a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY i) - 1 AS pos FROM reports) r
        USING (assessment_id)"""),
    "newest_overall": with_("a", f"""SELECT assessment_id, user_id, {TS('created_at')} AS created_at FROM a
        ORDER BY a.created_at DESC, assessment_id DESC LIMIT 50"""),
    "newest_first": f"""SELECT event_id, nullif({TS('ts')}, CASE WHEN event_id % 9 = 0 THEN {TS('ts')} ELSE '' END) AS ts FROM events""",
    "summary_text": """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS summary FROM documents""",
    "title_symptom": with_("reports", f"SELECT assessment_id, {TITLE('symptom')} AS title FROM reports"),
    "show_timestamps": f"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""",
    "live_sessions": """SELECT CASE WHEN event_id % 4 = 3 OR date_trunc('second', ts) < TIMESTAMP '2024-01-15 11:30:00' THEN 'expired'
        ELSE 'live' END AS state, event_id FROM events""",
    "past_codes": """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 7 = 0
        OR ts + INTERVAL '10 minutes' < TIMESTAMP '2024-01-15 12:00:00' AS past FROM events""",
    "sample_row": """SELECT left('{"user_id":' || c_custkey || ',"username":"' || c_name || '","email":"' || lower(c_mktsegment) || '.'
        || c_custkey || '@example.org"}', 500) || '...' AS sample FROM customer ORDER BY c_custkey LIMIT 1""",
    "expire_sessions": """SELECT event_id, event_id % 4 = 3 OR date_trunc('second', ts) < TIMESTAMP '2024-01-15 11:30:00' AS expired FROM events""",
    "drop_sensitive": with_("users_v", "SELECT * FROM users_v"),
    "search_users": with_("users_v", """SELECT user_id, username, email, full_name FROM users_v
        WHERE contains(lower(username), 'mach') OR contains(lower(email), 'mach') OR contains(lower(full_name), 'mach')"""),
}
cte("pend", """SELECT c_custkey AS pending_id, CASE c_custkey % 5 WHEN 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
      WHEN 1 THEN c_name ELSE 'new' || c_custkey END AS username,
    CASE c_custkey % 3 WHEN 0 THEN 'D' || (c_custkey % 200) WHEN 1 THEN 'H' || c_nationkey ELSE 'X000' END AS code FROM customer""")
cte("known_names", "SELECT c_name AS username FROM customer UNION SELECT s_name FROM supplier")
cte("junk", """SELECT o_orderkey AS account_id, CASE WHEN o_orderkey % 3 = 0 THEN '  ' WHEN o_custkey % 7 = 0 THEN 'ab'
    ELSE 'user' || o_custkey END AS username FROM orders""")
SQL |= {
    "taken_usernames": with_("pend known_names", """SELECT pending_id, username FROM pend
        WHERE username IN (SELECT username FROM known_names)
          OR EXISTS (SELECT 1 FROM pend p WHERE p.username = pend.username AND p.pending_id < pend.pending_id)"""),
    "resolve_access_codes": with_("pend known_names", """SELECT pending_id, username, code, status,
        CASE WHEN status = 'patient' THEN s_name END AS doctor, CASE WHEN status = 'doctor' THEN n_name END AS hospital FROM (
          SELECT *, CASE WHEN k.u IS NOT NULL OR first_id < pending_id THEN 'duplicate' WHEN s_name IS NOT NULL THEN 'patient'
            WHEN n_name IS NOT NULL THEN 'doctor' ELSE 'invalid' END AS status
          FROM (SELECT *, min(pending_id) OVER (PARTITION BY username) AS first_id FROM pend) pend LEFT JOIN supplier ON code = 'D' || s_suppkey
          LEFT JOIN nation ON code = CASE WHEN n_nationkey % 5 = 0 THEN 'D' ELSE 'H' END || n_nationkey
          LEFT JOIN (SELECT username AS u FROM known_names) k ON k.u = pend.username)"""),
    "account_audit": with_("junk", """SELECT account_id, username, concat_ws(', ',
        CASE WHEN trim(username) = '' THEN 'EMPTY' WHEN length(username) <= 3 THEN 'SHORT' END,
        CASE WHEN rn > 1 THEN 'DUPE' END) AS flags
        FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY account_id) AS rn FROM junk)"""),
    "duplicate_usernames": with_("junk", """SELECT username, count(*) AS n, min(account_id) AS first_id FROM junk
        GROUP BY 1 HAVING count(*) > 1"""),
}

# ---------------------------------------------------------------------------
# streaks and achievements
# ---------------------------------------------------------------------------
cte("cdays", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
cte("qdays", "SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders")
for _name, _src in (("isl", "cdays"), ("qisl", "qdays")):
    cte(_name, f"""SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM (
        SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run
        FROM {{{_src}}}) GROUP BY user_id, run""")
cte("streaks", """SELECT u.user_id, CASE WHEN i.last_day BETWEEN DATE '2024-01-29' AND DATE '2024-01-30' THEN i.length ELSE 0 END AS streak,
    coalesce(m.longest, 0) AS longest_streak, i.last_day FROM {users_v} u
    LEFT JOIN (SELECT user_id, max(length) AS longest, max(last_day) AS ld FROM {isl} GROUP BY 1) m USING (user_id)
    LEFT JOIN {isl} i ON i.user_id = u.user_id AND i.last_day = m.ld""")
cte("ach", "SELECT * FROM (VALUES " + _values([(a[0], a[1], a[2], a[3], a[4], a[5], a[6]) for a in dims.ACHIEVEMENTS])
    + ") t(achievement_id, type, title, title_zh, description, description_zh, threshold)")
cte("unl", """SELECT user_id, achievement_id, min(first_day + CAST(threshold - 1 AS INTEGER)) AS unlocked_on
    FROM {isl} JOIN {ach} ON threshold <= length GROUP BY 1, 2""")
cte("stored", "SELECT user_id, achievement_id, unlocked_on FROM {unl} WHERE unlocked_on <= DATE '2024-01-12'")
SQL |= {
    "streak_islands": with_("isl", f"SELECT user_id, {D('first_day')} AS first_day, {D('last_day')} AS last_day, length FROM isl"),
    "questionnaire_streaks": with_("qisl", f"SELECT user_id, {D('first_day')} AS first_day, {D('last_day')} AS last_day, length FROM qisl"),
    "latest_island": with_("qisl", f"""SELECT user_id, {D('first_day')} AS first_day, {D('last_day')} AS last_day, length FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_day DESC) AS rn FROM qisl) WHERE rn = 1"""),
    "active_streak": with_("streaks", f"SELECT user_id, streak, longest_streak, {D('last_day')} AS last_completion FROM streaks"),
    "overall_longest": with_("isl qisl", """SELECT user_id, max(length) AS longest_streak FROM
        (SELECT user_id, length FROM isl UNION ALL SELECT user_id, length FROM qisl) GROUP BY 1"""),
    "achievements_reached": with_("streaks ach", """SELECT user_id, achievement_id, CAST(threshold AS BIGINT) AS threshold
        FROM streaks JOIN ach ON threshold <= longest_streak"""),
    "unlock_dates": with_("unl", f"SELECT user_id, achievement_id, {D('unlocked_on')} AS unlocked_on FROM unl"),
    "newly_unlocked": with_("streaks ach stored", """SELECT user_id, achievement_id, CAST(threshold AS BIGINT) AS threshold
        FROM streaks JOIN ach ON threshold <= longest_streak ANTI JOIN stored USING (user_id, achievement_id)"""),
    "achievement_status": with_("streaks ach stored", f"""SELECT s.user_id, a.achievement_id, type, title, title_zh, description, description_zh,
        d.unlocked_on IS NOT NULL AS unlocked, {D('d.unlocked_on')} AS unlocked_at, least(streak, threshold) AS progress,
        CAST(threshold AS BIGINT) AS total, CAST(threshold AS BIGINT) AS threshold, a.achievement_id AS badge_image FROM streaks s CROSS JOIN ach a
        LEFT JOIN stored d ON d.user_id = s.user_id AND d.achievement_id = a.achievement_id"""),
}

# ---------------------------------------------------------------------------
# scheduling, calendar views, rates
# ---------------------------------------------------------------------------
cte("cal", """SELECT event_id, user_id AS doctor_id, CASE WHEN event_type <> 'signup' THEN ts END AS s,
    CASE WHEN event_type <> 'signup' THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS e, CAST(ts AS DATE) AS day,
    CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'view' THEN NULL ELSE 'confirmed' END AS status,
    CASE WHEN event_id % 3 <> 0 THEN 'Visit ' || event_id END AS summary,
    coalesce((SELECT string_agg(CASE WHEN (i + event_id) % 5 <> 0 THEN 'guest' || i || '@example.org' ELSE '' END, '; ' ORDER BY i)
              FROM range(1, 4) t(i) WHERE i <= event_id % 4), '') AS attendees FROM events""")
cte("slot", """SELECT doctor_id, day, h, day + to_hours(CAST(h AS BIGINT)) AS s, day + to_hours(CAST(h + 1 AS BIGINT)) AS e FROM
    (SELECT DISTINCT user_id AS doctor_id, CAST(ts AS DATE) AS day FROM events), range(9, 17) t(h)""")
cte("calmon", f"""SELECT a.user_id, CAST(a.created_at AS DATE) AS day, coalesce(max(r.severity), 0) AS sev, count(DISTINCT a.assessment_id) AS n
    FROM {{a}} a LEFT JOIN {{reports}} r USING (assessment_id) WHERE a.{MONTH.replace('created_at <', 'a.created_at <')} GROUP BY 1, 2""")
SQL |= {
    "parse_slots": with_("slot", f"""SELECT doctor_id, {D('day')} AS date, CAST(h * 60 AS BIGINT) AS start_minute,
        CAST(h * 60 + 60 AS BIGINT) AS end_minute, CAST(60 AS BIGINT) AS duration_minutes FROM slot"""),
    "free_slots": with_("slot cal", f"""SELECT doctor_id, {TS('s')} AS start, {TS('e')} AS "end", CAST(60 AS BIGINT) AS duration_minutes
        FROM slot WHERE NOT EXISTS (SELECT 1 FROM cal c WHERE c.doctor_id = slot.doctor_id AND c.s < slot.e AND c.e > slot.s
          AND coalesce(c.status, '') <> 'cancelled')"""),
    "normalize_events": with_("cal", f"""SELECT event_id, doctor_id, coalesce(summary, 'No Title') AS summary,
        {TS('coalesce(s, CAST(day AS TIMESTAMP))')} AS start,
        {TS("coalesce(e, CAST(day AS TIMESTAMP) + INTERVAL '86399 seconds')")} AS "end", coalesce(status, 'confirmed') AS status, attendees
        FROM cal WHERE coalesce(s, CAST(day AS TIMESTAMP)) < TIMESTAMP '2024-02-09'
          AND coalesce(e, CAST(day AS TIMESTAMP) + INTERVAL '86399 seconds') > TIMESTAMP '2024-01-10'"""),
    "severity_calendar": with_("calmon", f"""SELECT u.user_id, {D('c.cell')} AS cell,
        c.cell BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AS in_month, CAST(m.sev AS BIGINT) AS max_severity, coalesce(m.n, 0) AS assessments
        FROM (SELECT DISTINCT user_id FROM calmon) u
        CROSS JOIN (SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS cell FROM range(42) t(i)) c
        LEFT JOIN calmon m ON m.user_id = u.user_id AND m.day = c.cell"""),
    "day_severity": with_("a reports", f"""SELECT a.user_id, {D('a.created_at::DATE')} AS day, CAST(coalesce(max(severity), 0) AS BIGINT) AS max_severity
        FROM a LEFT JOIN reports r USING (assessment_id)
        WHERE CAST(a.created_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1, 2"""),
    "monthly_symptom_averages": with_("mrep", f"""SELECT user_id, symptom, n, total / n AS mean_severity, {mean_rounded('total', 'n', 1, 'up')} AS shown
        FROM (SELECT user_id, symptom, CAST(sum(severity) AS BIGINT) AS total, count(*) AS n FROM mrep WHERE NOT worded GROUP BY 1, 2)"""),
    "yearly_summary": with_("a reports", """SELECT u.user_id, m.month, coalesce(c.n, 0) AS assessments, r.fatigue, r.pain, r.cough, r.nausea, r.lack_of_appetite
        FROM (SELECT DISTINCT user_id FROM a) u CROSS JOIN (SELECT i AS month FROM range(1, 13) t(i)) m
        LEFT JOIN (SELECT user_id, month(created_at) AS month, count(*) AS n FROM a WHERE year(created_at) = 2024 GROUP BY 1, 2) c
          ON c.user_id = u.user_id AND c.month = m.month
        LEFT JOIN (SELECT user_id, month(created_at) AS month, """ + ", ".join(
            f"avg(severity) FILTER (symptom = '{s}') AS {s}" for s in _CHARTED) + """
          FROM reports WHERE year(created_at) = 2024 GROUP BY 1, 2) r ON r.user_id = u.user_id AND r.month = m.month"""),
    "alert_days_by_month": with_("a", """SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS assessments,
        count(*) FILTER (flag) AS alerts, count(DISTINCT CASE WHEN flag THEN CAST(created_at AS DATE) END) AS alert_days FROM a GROUP BY 1, 2"""),
    "weekly_rollup": with_("a reports", """SELECT user_id, weeks_back, CASE weeks_back WHEN 0 THEN 'Current Week' WHEN 1 THEN 'Last Week'
          ELSE weeks_back || ' Weeks Ago' END AS week, count(*) AS assessments, count(*) FILTER (flag) AS alerts,
          coalesce(CAST(sum(m) AS DOUBLE) / count(m), 0.0) AS mean_severity FROM (
        SELECT a.user_id, a.flag, datediff('day', CAST(date_trunc('week', a.created_at) AS DATE), DATE '2024-01-22') // 7 AS weeks_back,
          CAST(r.total / r.n AS DECIMAL(18, 12)) AS m FROM a LEFT JOIN (SELECT assessment_id, CAST(sum(severity) AS BIGINT) AS total, count(*) AS n
            FROM reports WHERE NOT worded GROUP BY 1) r USING (assessment_id)) GROUP BY 1, 2"""),
    "severity_series": with_("a reports", f"""SELECT a.user_id, {TS('a.created_at')} AS created_at, a.assessment_id, """ + ", ".join(
        f"CAST(max(severity) FILTER (symptom = '{s}') AS BIGINT) AS {s}" for s in _CHARTED)
        + """ FROM a LEFT JOIN reports r USING (assessment_id) WHERE CAST(a.created_at AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'
        GROUP BY a.user_id, a.created_at, a.assessment_id"""),
    "charted_symptoms": with_("a reports", "SELECT a.user_id, " + ", ".join(
        f"coalesce(bool_or(symptom = '{s}' AND severity IS NOT NULL), FALSE) AS {s}" for s in _CHARTED)
        + """ FROM a LEFT JOIN reports r USING (assessment_id) WHERE CAST(a.created_at AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'
        GROUP BY 1"""),
}


def _rates(keys: str, test: str, limit: int, where: str = "TRUE") -> str:
    """Every single request against every earlier one of its key, then added up per microsecond."""
    same = " AND ".join(f"p.{k} = r.{k}" for k in keys.split(", "))
    return f"""WITH log AS (SELECT user_id, event_type AS purpose, epoch_us(ts) AS at_us FROM events WHERE {where}),
        r AS (SELECT {keys}, at_us, count(*) AS requests FROM log GROUP BY ALL),
        n AS (SELECT {", ".join("r." + k for k in keys.split(", "))}, r.at_us, r.requests, count(p.at_us) AS prior
              FROM r LEFT JOIN log p ON {same} AND p.at_us < r.at_us AND r.at_us - p.at_us {test} GROUP BY ALL)
        SELECT {keys}, at_us, requests, prior, requests - least(requests, greatest({limit} - prior, 0)) AS over_limit FROM n"""


SQL |= {"rate_issues": _rates("user_id", "<= 3600000000", 3),
        "rate_attempts": _rates("user_id", "< 60000000", 5, "event_type <> 'purchase'"),
        "rate_reissues": _rates("user_id, purpose", "<= 30000000", 1)}

# ---------------------------------------------------------------------------
# questionnaire, stated relationally: submission x question rows
# ---------------------------------------------------------------------------
_FLAT = dims.flat_questions()
_NUM = {q["question_id"]: i for i, q in enumerate(_FLAT)}
cte("cat", "SELECT * FROM (VALUES " + _values([(
    i, q["section_pos"], q["question_pos"], q["section_id"], q["title"], q["clinical_area"], q["question_id"], q["type"],
    q["text"], list(q["options"]), list(q["options"].values()), q["required"], q["min"], q["max"], q["step"], q["unit"],
    q["low_limit"], q["alert_values"], _NUM.get(q["depends_on"]), q["op"], q["targets"]) for i, q in enumerate(_FLAT)])
    + """) t(idx, section_pos, question_pos, section_id, title, clinical_area, question_id, type, text, keys, labels, required,
    mn, mx, step, unit, low_limit, alert_values, dep, op, targets)""")
cte("ans", """SELECT o_orderkey AS id, idx, CASE
      WHEN type = 'rating' THEN CAST(CAST(mn AS BIGINT) + (o_orderkey * 7 + idx * 3) % (CAST(mx - mn AS BIGINT) + 1) AS VARCHAR)
      WHEN type = 'slider' THEN CASE WHEN sv = floor(sv) THEN CAST(CAST(sv AS BIGINT) AS VARCHAR) ELSE CAST(sv AS VARCHAR) END
      WHEN type = 'text' THEN 'note ' || o_orderkey
      WHEN type = 'single-select' OR (type = 'color-chart' AND o_orderkey % 2 = 0) THEN keys[(o_orderkey + idx) % len(keys) + 1] END AS scalar,
    CASE WHEN type = 'color-chart' AND o_orderkey % 2 = 1 THEN [keys[(o_orderkey + idx) % len(keys) + 1]]
      WHEN type = 'multi-select' OR type LIKE '%diagram' THEN list_slice(keys, 1, (o_orderkey + idx) % (least(len(keys), 12) + 1)) END AS items
    FROM (SELECT o_orderkey, c.*, mn + step * ((o_orderkey + idx) % (CAST(round((mx - mn) / step) AS BIGINT) + 1)) AS sv FROM orders, {cat} c)
    WHERE (o_orderkey + idx) % 7 <> 0""")
cte("resp", """SELECT o.o_orderkey AS id, c.*, a.scalar, a.items, a.id IS NOT NULL AS given,
    CASE WHEN a.items IS NOT NULL THEN CASE WHEN len(a.items) = 0 THEN '[]' ELSE '["' || array_to_string(a.items, '","') || '"]' END
      ELSE a.scalar END AS raw,
    CASE WHEN c.op IS NULL THEN TRUE WHEN d.id IS NULL THEN FALSE
      WHEN c.op = 'gte' THEN CAST(d.scalar AS DOUBLE) >= CAST(c.targets[1] AS DOUBLE)
      WHEN c.op = 'not_eq' THEN d.scalar <> c.targets[1] WHEN c.op = 'eq' THEN d.scalar = c.targets[1]
      WHEN c.op = 'in_list' THEN list_contains(c.targets, d.scalar)
      WHEN c.op = 'contains' THEN d.items IS NOT NULL AND list_contains(d.items, c.targets[1]) END AS shown
    FROM orders o CROSS JOIN {cat} c LEFT JOIN {ans} a ON a.id = o.o_orderkey AND a.idx = c.idx
    LEFT JOIN {ans} d ON d.id = o.o_orderkey AND d.idx = c.dep""")
cte("resp2", """SELECT *, CASE WHEN items IS NOT NULL THEN array_to_string(list_transform(items, lambda v: labels[list_position(keys, v)]), ', ')
      WHEN type = 'slider' THEN scalar || unit WHEN type = 'text' THEN scalar
      ELSE labels[list_position(keys, scalar)] END AS shown_text,
    list_filter(coalesce(items, CASE WHEN scalar IS NOT NULL THEN [scalar] ELSE [] END), lambda v: list_contains(alert_values, v)) AS alarming
    FROM {resp}""")
cte("resp3", """SELECT *, CASE
      WHEN type = 'rating' AND CAST(scalar AS DOUBLE) >= 4 THEN title || ': ' || string_split(text, '?')[1] || ' rated ' || shown_text || ' (' || scalar || '/5)'
      WHEN type = 'single-select' AND scalar = '6+' THEN title || ': frequency 6+ times'
      WHEN type = 'color-chart' AND len(alarming) > 0 THEN title || ': alarming color reported ('
        || array_to_string(list_transform(alarming, lambda v: labels[list_position(keys, v)]), ', ') || ')'
      WHEN type LIKE '%diagram' AND len(items) >= 3 THEN title || ': ' || len(items) || ' body regions affected'
      WHEN type = 'slider' AND CAST(scalar AS DOUBLE) <= low_limit THEN title || ': ' || scalar || unit || ' (critically low)' END AS alert
    FROM {resp2}""")
_SEC = [(pos, s["section_id"], s["title"], s["clinical_area"], _NUM[s["severity_source"]], s["severity_method"],
         _NUM.get(s["fallback_source"]), s["fallback_method"]) for pos, s in enumerate(dims.SECTIONS)]
cte("secdef", "SELECT * FROM (VALUES " + _values(_SEC) + ") t(section_pos, section_id, title, clinical_area, src, method, fb, fb_method)")
cte("sev", """SELECT o.o_orderkey AS id, s.section_pos, s.section_id, s.title, s.clinical_area,
    CASE WHEN p.id IS NOT NULL THEN p.scalar ELSE f.scalar END AS scalar, CASE WHEN p.id IS NOT NULL THEN p.items ELSE f.items END AS items,
    CASE WHEN p.id IS NOT NULL THEN s.method WHEN f.id IS NOT NULL THEN s.fb_method END AS method, c.keys, c.labels
    FROM orders o CROSS JOIN {secdef} s JOIN {cat} c ON c.idx = s.src
    LEFT JOIN {ans} p ON p.id = o.o_orderkey AND p.idx = s.src LEFT JOIN {ans} f ON f.id = o.o_orderkey AND f.idx = s.fb""")
cte("sec0", "SELECT *, CASE method WHEN 'frequency_map' THEN " + _case("scalar", {"none": 0, "1-2": 1, "3-4": 2, "5-6": 3, "6+": 4}, "0")
    + """ WHEN 'region_count' THEN CASE WHEN len(items) >= 10 THEN 4 WHEN len(items) >= 6 THEN 3 WHEN len(items) >= 3 THEN 2
      WHEN len(items) >= 1 THEN 1 ELSE 0 END WHEN 'rating' THEN CAST(scalar AS DOUBLE) END AS score FROM {sev}""")
cte("sec", "SELECT s.id, s.section_pos, s.section_id, s.title, s.clinical_area, CAST(s.score AS DOUBLE) AS severity_score, CASE method WHEN 'frequency_map' THEN "
    + _case("score", {0: "None", 1: "Mild", 2: "Moderate", 3: "Frequent", 4: "Very frequent"}) + " WHEN 'region_count' THEN " + _case("score", {0: "None", 1: "Mild", 2: "Moderate", 3: "Significant", 4: "Severe"})
    + """ WHEN 'rating' THEN labels[list_position(keys, scalar)] END AS severity_label, coalesce(r.flags, '') AS alert_flags,
    coalesce(score > 0, FALSE) OR r.flags IS NOT NULL AS is_concern,
    CASE WHEN (coalesce(score > 0, FALSE) OR r.flags IS NOT NULL) AND r.details <> '' THEN r.details END AS details
    FROM {sec0} s JOIN (SELECT id, section_pos, string_agg(alert, ' | ' ORDER BY question_pos) AS flags,
      string_agg(shown_text, ', ' ORDER BY question_pos) FILTER (shown AND items IS NOT NULL AND shown_text <> ''
        AND type IN ('multi-select', 'body-diagram', 'muscle-diagram')) AS details
      FROM {resp3} GROUP BY 1, 2) r ON r.id = s.id AND r.section_pos = s.section_pos""")
cte("msgs", """SELECT id, 0 AS block, 0 AS part, 'assistant' AS role,
      'Hello! I''m going to review your symptom questionnaire responses to assess how you''re feeling today.' AS content
      FROM (SELECT DISTINCT id FROM {sec})
    UNION ALL SELECT s.id, s.section_pos + 1, p.part, CASE p.part WHEN 0 THEN 'assistant' ELSE 'user' END,
      CASE p.part WHEN 0 THEN 'Let me ask about ' || s.title || '.' ELSE 'Regarding ' || s.title || chr(58) || chr(10) || r.lines
        || CASE WHEN s.severity_score IS NOT NULL THEN chr(10) || 'Overall severity: ' || s.severity_label || ' (' || CASE WHEN s.severity_score = floor(s.severity_score) THEN CAST(CAST(s.severity_score AS BIGINT) AS VARCHAR) ELSE CAST(s.severity_score AS VARCHAR) END || ')' ELSE '' END END
      FROM {sec} s JOIN (SELECT id, section_pos, string_agg('- ' || text || ': ' || shown_text, chr(10) ORDER BY question_pos) AS lines
        FROM {resp2} WHERE shown AND given GROUP BY 1, 2) r ON r.id = s.id AND r.section_pos = s.section_pos
      CROSS JOIN (SELECT i AS part FROM range(2) t(i)) p
    UNION ALL SELECT id, 99, 0, 'user', 'Additional concerns I want to flag:' || chr(10) || string_agg('- ' || alert, chr(10) ORDER BY idx)
      FROM {resp3} WHERE alert IS NOT NULL GROUP BY 1""")
SQL |= {
    "question_responses": with_("resp2", """SELECT id AS submission_id, question_id, shown AS was_shown, required AS was_required,
        CASE WHEN shown THEN raw END AS raw_value, CASE WHEN shown AND given THEN shown_text END AS display_value,
        CASE WHEN shown AND given AND type IN ('rating', 'slider') THEN round((CAST(scalar AS DOUBLE) - mn) / (mx - mn), 2) END AS severity_normalized,
        CASE WHEN shown AND type LIKE '%diagram' THEN len(items) END AS region_count,
        CASE WHEN NOT shown THEN 'conditional_not_met' END AS skip_reason, section_id, text AS question_text, type,
        shown AND given AND coalesce(len(items) > 0, TRUE) AS answered,
        CASE WHEN shown AND items IS NOT NULL THEN shown_text END AS display_list FROM resp2"""),
    "section_results": with_("sec", """SELECT id AS submission_id, section_id, title, clinical_area, severity_score, severity_label,
        alert_flags, is_concern, details FROM sec"""),
    "alert_flags": with_("resp3", "SELECT id AS submission_id, question_id, alert AS alert_flag FROM resp3 WHERE alert IS NOT NULL"),
    "completion_counts": with_("resp", """SELECT id AS submission_id, count(*) AS total_questions, count(*) FILTER (shown) AS questions_shown,
        count(*) FILTER (shown AND given AND coalesce(len(items) > 0, TRUE)) AS questions_answered FROM resp GROUP BY 1"""),
    "clinical_summary": with_("sec", """SELECT s.id AS submission_id, count(*) FILTER (is_concern) AS symptom_count,
        max(severity_score) FILTER (is_concern) AS max_severity, arg_min(title, section_pos) FILTER (is_concern AND severity_score = m.top) AS max_severity_area,
        coalesce(array_to_string(list_sort(list_distinct(list(clinical_area) FILTER (is_concern))), ', '), '') AS clinical_areas_affected,
        coalesce(string_agg(alert_flags, ' | ' ORDER BY section_pos) FILTER (alert_flags <> ''), '') AS alert_flags,
        coalesce(string_agg(section_id || ': ' || title || ': ' || clinical_area || ': ' || coalesce(printf('%.1f', severity_score), '-') || ': '
          || coalesce(severity_label, '-') || ': ' || coalesce(details, '-'), ' | ' ORDER BY section_pos) FILTER (is_concern), '') AS areas_of_concern
        FROM sec s JOIN (SELECT id, max(severity_score) FILTER (is_concern) AS top FROM sec GROUP BY 1) m ON m.id = s.id GROUP BY s.id"""),
    "submission_messages": with_("msgs", """SELECT id AS submission_id, row_number() OVER (PARTITION BY id ORDER BY block, part) AS pos,
        role, content FROM msgs"""),
    "triage_status": with_("msgs", """SELECT o_orderkey AS submission_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE n END AS n_messages,
        CASE WHEN o_orderkey % 5 = 0 OR n < 3 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'generating' END AS triage_status,
        CASE WHEN o_orderkey % 5 <> 0 AND n >= 3 AND o_orderstatus = 'F' THEN 'YELLOW' END AS alert_level
        FROM orders JOIN (SELECT id, count(*) AS n FROM msgs GROUP BY 1) m ON m.id = o_orderkey"""),
    "pending_questionnaires": "SELECT o_orderkey AS submission_id, o_custkey AS user_id FROM orders WHERE o_orderstatus <> 'F'",
    "shape_messages": """SELECT conv_id, turn, role, text AS content FROM conversations WHERE role <> 'system'
        UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Be brief.' FROM conversations""",
    "turn_counts": """SELECT conv_id, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages
        FROM conversations GROUP BY 1""",
}
cte("prereq", "SELECT * FROM (VALUES " + _values([(
    i, _NUM.get(q["depends_on"]),
    [] if not q["op"] else [o for o in _FLAT[_NUM[q["depends_on"]]]["options"] if int(o) >= int(q["targets"][0])] if q["op"] == "gte" else
    [o for o in _FLAT[_NUM[q["depends_on"]]]["options"] if o != q["targets"][0]] if q["op"] == "not_eq" else q["targets"])
    for i, q in enumerate(_FLAT)]) + ") t(idx, dep, allowed)")
SQL["next_question"] = with_("prereq ans cat", """SELECT o.o_orderkey AS submission_id, coalesce(n.idx + 1, a.n) AS question_number,
    c.text AS next_question, CAST(42 AS BIGINT) AS total_questions, n.idx IS NULL AS completed
    FROM orders o LEFT JOIN (SELECT id, count(*) AS n FROM ans GROUP BY 1) a ON a.id = o.o_orderkey
    LEFT JOIN (SELECT o_orderkey AS id, min(p.idx) AS idx FROM orders CROSS JOIN prereq p
      LEFT JOIN ans a ON a.id = o_orderkey AND a.idx = p.idx LEFT JOIN ans d ON d.id = o_orderkey AND d.idx = p.dep
      WHERE a.id IS NULL AND (p.dep IS NULL OR (d.id IS NOT NULL AND list_has_any(coalesce(d.items, [d.scalar]), p.allowed)))
      GROUP BY 1) n ON n.id = o.o_orderkey LEFT JOIN cat c ON c.idx = n.idx""")

# ---------------------------------------------------------------------------
# maintenance, quality, streams
# ---------------------------------------------------------------------------
_DOOMED = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"
SQL |= {
    "footer_overview": " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS documents, CAST(min({k}) AS VARCHAR) AS first, CAST(max({k}) AS VARCHAR) AS last FROM {t}"
        for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"))),
    "delete_stored": """SELECT o_custkey AS user_id, o_orderkey AS checkin_id FROM orders WHERE o_custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0)""",
    "upsert_stored": """SELECT c_custkey AS user_id, c_name AS username,
        CASE WHEN u.o_orderkey IS NULL THEN c_mktsegment WHEN u.o_orderstatus <> 'F' THEN u.o_orderpriority END AS checkups,
        coalesce(u.o_orderkey % 50 + 150, 0) AS height FROM customer LEFT JOIN (SELECT *, row_number() OVER
          (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 5 = 0) u ON u.o_custkey = c_custkey AND u.rn = 1""",
    "quarantine_signups": with_("pend", """SELECT CASE WHEN violations = '' THEN 'valid' ELSE 'quarantine' END AS part, pending_id, violations FROM (
          SELECT pending_id, concat_ws('|', CASE WHEN length(username) < 4 THEN 'username' END,
            CASE WHEN length(code) <> 4 THEN 'access_code' END, CASE WHEN pending_id % 4 = 0 THEN 'email' END) AS violations FROM pend)
        UNION ALL SELECT 'broken', count(*) FILTER (length(username) < 4), 'username' FROM pend
        UNION ALL SELECT 'broken', count(*) FILTER (length(code) <> 4), 'access_code' FROM pend
        UNION ALL SELECT 'broken', 0, 'password' UNION ALL SELECT 'broken', count(*) FILTER (pending_id % 4 = 0), 'email' FROM pend"""),
    "assessment_files": with_("raw_reports", """SELECT 'p' || user_id AS file_patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'note ' || event_id AS conversation_notes,
        coalesce(n, 0) AS n_symptoms FROM events LEFT JOIN (SELECT assessment_id, count(*) AS n FROM raw_reports GROUP BY 1) r ON r.assessment_id = event_id
        WHERE event_id % 50 = 0 AND event_id % 350 <> 0"""),
    "patient_ids": """SELECT DISTINCT 'p' || user_id AS patient_id FROM events WHERE event_id % 50 = 0""",
    "table_overview": " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS documents FROM {t}" for t in
                                         ["customer", "orders", "events", "supplier", "nation", "conversations"]),
    "latest_row": f"SELECT event_id AS assessment_id, user_id, {TS('ts')} AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "cascade_delete_counts": f"""SELECT * FROM (SELECT 'users' AS collection, count(*) AS removed FROM customer WHERE c_mktsegment = 'MACHINERY'
        UNION ALL SELECT 'answers', count(*) FROM orders WHERE o_custkey IN ({_DOOMED})
        UNION ALL SELECT 'assessments', count(*) FROM events WHERE user_id IN ({_DOOMED})) WHERE removed > 0 OR collection = 'users'""",
    "cascade_delete_survivors": f"""SELECT 'users' AS collection, CAST(NULL AS BIGINT) AS user_id, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN ({_DOOMED})
        UNION ALL SELECT 'answers', o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN ({_DOOMED})
        UNION ALL SELECT 'assessments', user_id, CAST(event_id AS VARCHAR) FROM events WHERE user_id NOT IN ({_DOOMED})
        UNION ALL SELECT 'questionnaire_drafts', -1 - conv_id, CAST(-1 - conv_id AS VARCHAR) FROM conversations""",
    "insert_if_absent": """SELECT o_custkey AS user_id, o_orderpriority AS achievement_id, min(o_orderkey) AS at FROM orders
        WHERE NOT (o_orderpriority = '5-LOW' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) GROUP BY 1, 2""",
    "latest_draft": f"""SELECT user_id, event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 13 AS current_section,
        {TS('ts')} AS last_updated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1 AND user_id NOT IN ({_DOOMED})""",
    "write_append": with_("a", f"SELECT assessment_id, user_id, flag AS flag_for_oncologist, {D('created_at')} AS date FROM a"),
    "apply_profile_updates": """SELECT c_custkey AS user_id, c_name AS username,
        CASE WHEN u.o_orderkey IS NULL THEN c_mktsegment WHEN u.o_orderstatus <> 'F' THEN u.o_orderpriority END AS checkups,
        coalesce(u.o_orderkey % 50 + 150, 0) AS height FROM customer LEFT JOIN (SELECT *, row_number() OVER
          (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) u ON u.o_custkey = c_custkey AND u.rn = 1""",
    "conformance_assessments": with_("a reports", """SELECT assessment_id, concat_ws('|',
        CASE WHEN coalesce(n, 0) < 5 THEN 'symptom_missing' END, CASE WHEN coalesce(bad_s, FALSE) THEN 'severity_range' END,
        CASE WHEN coalesce(bad_f, FALSE) THEN 'frequency_range' END, CASE WHEN a.treatment_status = 'unknown' THEN 'treatment_status' END) AS violations
        FROM a LEFT JOIN (SELECT assessment_id, count(*) AS n, bool_or(severity IS NULL OR severity NOT BETWEEN 1 AND 5) AS bad_s,
          bool_or(frequency IS NULL OR frequency NOT BETWEEN 1 AND 5) AS bad_f FROM reports GROUP BY 1) r USING (assessment_id)"""),
    "conformance_triage": with_("a", """SELECT assessment_id, CASE WHEN NOT has_triage THEN 'triage_missing|required_field|alert_level|confidence_level'
        WHEN confidence IS NULL THEN 'confidence_level' ELSE '' END AS violations FROM a"""),
    "conformance_submissions": """SELECT o_orderkey AS submission_id, concat_ws('|', CASE WHEN o_orderkey % 16 > 13 THEN 'sections_completed' END,
        CASE WHEN o_orderkey % 15 NOT BETWEEN 1 AND 13 THEN 'total_sections' END,
        CASE WHEN o_orderkey % 120 > 100 THEN 'completion_percentage' END) AS violations FROM orders""",
    "conformance_signups": with_("pend", """SELECT pending_id, concat_ws('|', CASE WHEN length(username) < 4 THEN 'username' END,
        CASE WHEN length(code) <> 4 THEN 'access_code' END, CASE WHEN pending_id % 4 = 0 THEN 'email' END) AS violations FROM pend"""),
    "default_records": with_("a reports", """SELECT a.assessment_id, CASE WHEN a.assessment_id % 13 = 0 THEN 5 ELSE coalesce(n, 0) END AS n_symptoms,
        CASE WHEN a.assessment_id % 13 = 0 THEN 'Conversation with ' || (a.assessment_id % 9) || ' messages completed.' END AS conversation_notes,
        coalesce(triage_level, 'YELLOW') AS triage_alert_level, CASE WHEN has_triage THEN 'rationale ' || a.assessment_id ELSE
          'Unable to complete automated triage assessment - recommend clinical review as precaution' END AS triage_rationale,
        CASE WHEN triage_level = 'RED' THEN 'immediate' ELSE 'within 24 hours' END AS triage_timeline,
        CASE WHEN has_triage THEN '' ELSE 'Automated triage failed for conversation with ' || (a.assessment_id % 9)
          || ' messages. Manual clinical assessment recommended.' END AS triage_notes,
        CASE WHEN has_triage THEN coalesce(ks.keys, '') ELSE 'System unable to analyze conversation' END AS triage_key_symptoms
        FROM a LEFT JOIN (SELECT assessment_id, string_agg(symptom, '|' ORDER BY i) AS keys FROM reports WHERE severity >= 3 GROUP BY 1) ks
          USING (assessment_id) LEFT JOIN (SELECT assessment_id, count(*) AS n FROM reports GROUP BY 1) r USING (assessment_id)"""),
    "stream_streaks": with_("isl", f"""SELECT i.user_id, {D('i.last_day')} AS last_day, length AS streak, longest AS longest_streak
        FROM isl i JOIN (SELECT user_id, max(last_day) AS ld, max(length) AS longest FROM isl GROUP BY 1) m
        ON m.user_id = i.user_id AND m.ld = i.last_day"""),
    "stream_streaks_resumed": with_("isl", f"""SELECT i.user_id, {D('i.last_day')} AS last_day, length AS streak, longest AS longest_streak
        FROM isl i JOIN (SELECT user_id, max(last_day) AS ld, max(length) AS longest FROM isl GROUP BY 1) m
        ON m.user_id = i.user_id AND m.ld = i.last_day WHERE i.last_day >= DATE '2024-01-16'"""),
    "stream_codes": with_("ev", """SELECT e.user_id, e.event_id AS use_id, coalesce(e.k % 3 = i.code, FALSE) AS accepted FROM ev e
        LEFT JOIN (SELECT user_id, arg_max(k % 3, struct_pack(a := created_at, c := CAST(k % 3 AS VARCHAR))) AS code FROM ev
                   WHERE event_type = 'signup' GROUP BY 1) i ON i.user_id = e.user_id WHERE e.event_type = 'click'"""),
    "stream_doctor_alerts": with_("assign a", f"""SELECT doctor_id, CAST(rank AS BIGINT) AS rank, session_id, user_id, alert_level, oncologist_notification_level, created_at
        FROM (SELECT doctor_id, row_number() OVER (PARTITION BY doctor_id ORDER BY a.created_at DESC, a.assessment_id DESC) AS rank,
          a.session_id, a.user_id, a.alert_level, a.level AS oncologist_notification_level, {TS('a.created_at')} AS created_at
          FROM assign s JOIN a ON a.user_id = s.user_id WHERE a.flag OR a.level IN ('amber', 'red')) WHERE rank <= 50"""),
    "stream_sessions": """SELECT conv_id AS session_id, turn AS message_id,
        turn <= 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) AS accepted FROM conversations""",
    "stream_alerts": with_("a assign", """SELECT doctor_id, assessment_id, user_id, level AS oncologist_notification_level
        FROM a JOIN assign USING (user_id) WHERE flag OR level IN ('amber', 'red')"""),
    "stream_enrich": with_("sec resp", """SELECT s.id AS submission_id, r.shown AS questions_shown, r.answered AS questions_answered,
        s.n AS symptom_count, s.top AS max_severity, s.area AS max_severity_area FROM (
          SELECT id, count(*) FILTER (is_concern) AS n, max(severity_score) FILTER (is_concern) AS top,
            arg_max(title, severity_score * 100 - section_pos) FILTER (is_concern AND severity_score IS NOT NULL) AS area FROM sec GROUP BY 1) s
        JOIN (SELECT id, count(*) FILTER (shown) AS shown, count(*) FILTER (shown AND given AND coalesce(len(items) > 0, TRUE)) AS answered
          FROM resp GROUP BY 1) r ON r.id = s.id"""),
    "stream_insert_if_absent": """SELECT o_custkey AS user_id, o_orderpriority AS achievement_id, min(o_orderkey) AS at FROM orders GROUP BY 1, 2""",
}
SQL |= {
    "questionnaire_history": with_("ans", f"""SELECT user_id, submission_id, submitted_at, answered, newest_rank FROM (
        SELECT o_custkey AS user_id, o_orderkey AS submission_id, {TS('o_orderdate')} AS submitted_at, coalesce(n, 0) AS answered,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest_rank
        FROM orders LEFT JOIN (SELECT id, count(*) AS n FROM ans GROUP BY 1) a ON a.id = o_orderkey) WHERE newest_rank <= 10"""),
    "patient_assessments": with_("tri_rank reports", f"""SELECT t.user_id, t.assessment_id, {TS('t.created_at')} AS created_at, t.alert_level,
        CASE WHEN t.assessment_id % 13 = 0 THEN NULL ELSE coalesce(n, 0) END AS n_symptoms, t.newest_rank
        FROM tri_rank t LEFT JOIN (SELECT assessment_id, count(*) AS n FROM reports GROUP BY 1) r USING (assessment_id)
        WHERE newest_rank <= 20"""),
    "upcoming_events": "SELECT * FROM (" + SQL["normalize_events"] + ") ORDER BY start, event_id LIMIT 10",
}
SQL["scored_submissions"] = with_("msgs sec", """SELECT o_orderkey AS submission_id, 'questionnaire_' || o_orderkey AS session_id,
    m.n AS n_messages, s.n AS symptom_count FROM orders JOIN (SELECT id, count(*) AS n FROM msgs GROUP BY 1) m ON m.id = o_orderkey
    JOIN (SELECT id, count(*) FILTER (is_concern) AS n FROM sec GROUP BY 1) s ON s.id = o_orderkey
    WHERE o_orderstatus <> 'F' AND m.n >= 3""")
