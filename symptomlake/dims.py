"""Dimension data: the clinical catalogues every rule is evaluated against.

They are small, code-owned and versioned with the rules, so they travel inside
the plan as literals instead of being joined.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# symptoms
# ---------------------------------------------------------------------------
TARGET_SYMPTOMS = ["fatigue", "lack_of_appetite", "nausea", "cough", "pain"]

SYMPTOM_DISPLAY = {
    "fatigue": "Energy Level",
    "lack_of_appetite": "Appetite",
    "nausea": "Nausea",
    "cough": "Cough",
    "pain": "Pain",
}

SYMPTOM_ICONS = {
    "fatigue": "⚡",
    "lack_of_appetite": "🍽️",
    "nausea": "🤢",
    "cough": "💨",
    "pain": "💊",
}

# order in which the viewer draws its series
CHART_SYMPTOMS = ["fatigue", "pain", "cough", "nausea", "lack_of_appetite"]

SEVERITY_LEVELS = {
    1: ("Minimal", "#4caf50"),
    2: ("Mild", "#8bc34a"),
    3: ("Moderate", "#ffc107"),
    4: ("Severe", "#ff9800"),
    5: ("Extreme", "#f44336"),
}
SEVERITY_DEFAULT = ("", "#999")

# ---------------------------------------------------------------------------
# Levels, statuses, notification rules
# ---------------------------------------------------------------------------
NOTIFICATION_LEVELS = ["none", "amber", "red"]
ALERT_LEVELS = ["GREEN", "YELLOW", "ORANGE", "RED"]
CONFIDENCE_LEVELS = ["low", "medium", "high"]
TREATMENT_STATUSES = ["undergoing_treatment", "in_remission"]

# treatment status -> (frequency limit, severity limit), inclusive
ESCALATION_LIMITS = {
    "undergoing_treatment": (5, 3),
    "in_remission": (4, 4),
}

CONFIDENCE_SCORE = {"low": 1, "medium": 2, "high": 3}
CONFIDENCE_DEFAULT = 2

ALERT_DESCRIPTIONS = {
    "en": {
        "GREEN": "Routine symptoms, stable condition - normal follow-up appropriate",
        "YELLOW": "Moderate symptoms requiring monitoring - consider consultation",
        "ORANGE": "Concerning symptoms - same-day medical review recommended",
        "RED": "Severe symptoms - urgent medical attention required",
    },
    "zh-HK": {
        "GREEN": "常規症狀，病情穩定 - 適合正常隨訪",
        "YELLOW": "中度症狀需要監察 - 考慮諮詢",
        "ORANGE": "令人擔憂的症狀 - 建議當日醫療檢查",
        "RED": "嚴重症狀 - 需要緊急醫療關注",
    },
}

# ---------------------------------------------------------------------------
# Achievements (id, type, title, title_zh, description, description_zh, days); the badge image of an
# achievement is named by its id
# ---------------------------------------------------------------------------
ACHIEVEMENTS = [
    ("7daystreak", "streak", "7-Day Streak", "7天連續",
     "Logged symptoms daily for 7 days", "連續7天每日記錄症狀", 7),
    ("day10", "streak", "10-Day Streak", "10天連續",
     "Logged symptoms daily for 10 days", "連續10天每日記錄症狀", 10),
    ("14daystreak", "streak", "14-Day Streak", "14天連續",
     "Logged symptoms daily for 14 days", "連續14天每日記錄症狀", 14),
    ("day20", "streak", "20-Day Streak", "20天連續",
     "Logged symptoms daily for 20 days", "連續20天每日記錄症狀", 20),
    ("21daystreak", "streak", "21-Day Streak", "21天連續",
     "Logged symptoms daily for 21 days", "連續21天每日記錄症狀", 21),
    ("25logs", "milestone", "25 Day Club", "25天俱樂部",
     "Logged symptoms for 25 days", "記錄症狀25天", 25),
    ("30daystreak", "streak", "30-Day Streak", "30天連續",
     "A full month of daily logging", "整整一個月的每日記錄", 30),
    ("50logs", "milestone", "50 Day Legend", "50天傳奇",
     "Logged symptoms for 50 days", "記錄症狀50天", 50),
]

# ---------------------------------------------------------------------------
# Weekly insights (id, type, icon, title, description, what the current week adds), in display order;
# names in braces are filled in
# ---------------------------------------------------------------------------
WEEKLY_INSIGHTS = [
    ("no_data", "info", "fa-info-circle", "No Data Available",
     "No assessments found for {context}. Complete some assessments to see analytics.", ""),
    ("high_alerts", "critical", "fa-exclamation-triangle", "High Alert Activity",
     "You had {alerts} oncologist alerts {context}.", " Consider reaching out to your care team."),
    ("concerning_symptom", "warning", "fa-heartbeat", "Monitor {name}",
     "Your {lower_name} averaged {avg}/5 {context}.", ""),
    ("improving_trend", "positive", "fa-chart-line", "Positive Trend",
     "Your symptoms showed an improving trend {context}.", " Keep up the good work!"),
    ("consistent_tracking", "positive", "fa-check-circle", "Consistent Tracking",
     "You completed {n} assessments {context}.", " Great job!"),
    ("low_engagement", "info", "fa-calendar-check", "More Check-ins Recommended",
     "Try to complete daily check-ins for better health insights.", ""),
]

# ---------------------------------------------------------------------------
# Triage insights, title -> (icon, kind); the description key is the title and this ending
# ---------------------------------------------------------------------------
SMART_INSIGHTS = {
    "all_good": ("check_circle", "success"),
    "monitor_closely": ("warning", "warning"),
    "attention_needed": ("error", "error"),
    "mood_sleep_correlation": ("psychology", "info"),
    "high_severity_symptoms": ("warning", "warning"),
    "symptoms_improving": ("trending_up", "success"),
    "high_priority_conditions": ("medical_services", "error"),
    "general_health_tip": ("info", "info"),
    "wellness_reminder": ("favorite", "success"),
}
SMART_DESCRIPTION = "_description"
MOOD_WORDS = ["mood", "depression", "anxiety"]
SLEEP_WORDS = ["sleep", "insomnia", "restless"]

# ---------------------------------------------------------------------------
# Answer scales of the questionnaire
# ---------------------------------------------------------------------------
FREQUENCY = {
    "none": "None",
    "1-2": "1-2 times",
    "3-4": "3-4 times",
    "5-6": "5-6 times",
    "6+": "6+ times",
}
FREQUENCY_SEVERITY = {"none": 0, "1-2": 1, "3-4": 2, "5-6": 3, "6+": 4}
FREQUENCY_LABELS = {0: "None", 1: "Mild", 2: "Moderate", 3: "Frequent", 4: "Very frequent"}

# (at least this many regions, severity)
REGION_SEVERITY = [(0, 0), (1, 1), (3, 2), (6, 3), (10, 4)]
REGION_LABELS = {0: "None", 1: "Mild", 2: "Moderate", 3: "Significant", 4: "Severe"}

QUALITY_1_5 = {"1": "Very good", "2": "Good", "3": "Normal", "4": "Poor", "5": "Very poor"}
BURDEN_1_5 = {"1": "Very mild", "2": "Mild", "3": "Moderate", "4": "Bad", "5": "Very bad"}
BURDEN_0_5 = {"0": "None", **BURDEN_1_5}

OTHER = {"others_specify": "Other – please specify"}
OFTEN = ["3-4", "5-6", "6+"]


JOINT_REGIONS = {
    "left_shoulder": "Left shoulder girdle",
    "right_shoulder": "Right shoulder girdle",
    "left_elbow": "Left elbow",
    "right_elbow": "Right elbow",
    "left_wrist": "Left wrist",
    "right_wrist": "Right wrist",
    "left_fingers": "Fingers on left hand",
    "right_fingers": "Fingers on right hand",
    "upper_back": "Upper back",
    "lower_back": "Lower back",
    "left_hip": "Left hip",
    "right_hip": "Right hip",
    "left_knee": "Left knee",
    "right_knee": "Right knee",
    "left_ankle": "Left ankle",
    "right_ankle": "Right ankle",
    "left_toes": "Toes on left foot",
    "right_toes": "Toes on right foot",
}

MUSCLE_REGIONS = {
    "left_jaw": "Left jaw",
    "right_jaw": "Right jaw",
    "left_neck": "Left neck",
    "right_neck": "Right neck",
    "left_chest": "Left chest",
    "right_chest": "Right chest",
    "left_abdomen": "Left abdomen",
    "right_abdomen": "Right abdomen",
    "left_shoulder": "Left shoulder",
    "right_shoulder": "Right shoulder",
    "left_bicep": "Left bicep",
    "right_bicep": "Right bicep",
    "left_lower_arm": "Left forearm",
    "right_lower_arm": "Right forearm",
    "left_hand": "Left hand",
    "right_hand": "Right hand",
    "left_oblique": "Left oblique",
    "right_oblique": "Right oblique",
    "left_adductor": "Left adductor",
    "right_adductor": "Right adductor",
    "left_quadriceps": "Left quadriceps",
    "right_quadriceps": "Right quadriceps",
    "left_lower_leg": "Left lower leg",
    "right_lower_leg": "Right lower leg",
    "left_foot": "Left foot",
    "right_foot": "Right foot",
    "left_trapezius": "Left trapezius",
    "right_trapezius": "Right trapezius",
    "left_upper_back": "Left upper back",
    "right_upper_back": "Right upper back",
    "left_lower_back": "Left lower back",
    "right_lower_back": "Right lower back",
    "left_buttock": "Left buttock",
    "right_buttock": "Right buttock",
    "left_tricep": "Left tricep",
    "right_tricep": "Right tricep",
    "left_hamstrings": "Left hamstrings",
    "right_hamstrings": "Right hamstrings",
    "left_calf": "Left calf",
    "right_calf": "Right calf",
}

DIAGRAM_TYPES = ["body-diagram", "muscle-diagram", "joint-diagram"]


def _question(kind, qid, text, options=None, when=None, required=False, **extra):
    q = {"question_id": qid, "type": kind, "text": text, "options": options or {},
         "required": required, "min": None, "max": None, "descending": False,
         "unit": None, "low_limit": None, "alert_values": [],
         "depends_on": None, "op": None, "targets": [], "step": None}
    if when:
        dep, op, target = when
        q.update(depends_on=dep, op=op,
                 targets=[str(t) for t in (target if isinstance(target, list) else [target])])
    q.update(extra)
    return q


def rating(qid, text, scale, when=None, required=True):
    points = [float(p) for p in scale]
    return _question("rating", qid, text, scale, when, required, min=min(points), max=max(points))


def single(qid, text, options, when=None, required=True):
    return _question("single-select", qid, text, options, when, required)


def multi(qid, text, options, when):
    return _question("multi-select", qid, text, options, when)


def color(qid, text, options, alert_values, when):
    return _question("color-chart", qid, text, options, when, alert_values=alert_values)


def slider(qid, text, lo, hi, step, unit, when, low_limit=None):
    return _question("slider", qid, text, None, when, min=float(lo), max=float(hi),
                     step=float(step), unit=unit, low_limit=low_limit)


def free_text(qid, when):
    return _question("text", qid, "Please specify:", None, when)


def diagram(kind, qid, text, regions, when=None, required=False):
    return _question(kind, qid, text, regions, when, required)


def section(section_id, title, area, source, questions, method="rating", fallback=None):
    """fallback: (question id, method) used when the source has no answer."""
    return {"section_id": section_id, "title": title, "clinical_area": area,
            "severity_source": source, "severity_method": method,
            "fallback_source": fallback[0] if fallback else None,
            "fallback_method": fallback[1] if fallback else None,
            "questions": questions}


def _other_text(parent):
    return free_text(f"{parent}_other_text", (parent, "contains", "others_specify"))


# ---------------------------------------------------------------------------
# The symptom questionnaire, 13 sections / 42 questions
# ---------------------------------------------------------------------------
SECTIONS = [
    section("SN001", "Appetite Loss", "nutrition", "appetite_rating", [
        rating("appetite_rating", "How is your appetite on a scale of one to five?", QUALITY_1_5),
        multi("appetite_causes", "What led to your poor appetite? (Choose all that apply)", {
            "nausea": "Nausea and vomiting",
            "mouth_sores": "Mouth sores",
            "swallowing": "Swallowing difficulties",
            "taste": "Taste changes",
            "fullness": "Feeling of fullness",
            "mood": "Low mood / Lost interest in taking food and drinks",
            **OTHER}, ("appetite_rating", "gte", 4)),
        _other_text("appetite_causes"),
    ]),
    section("SN002", "Constipation/Diarrhoea", "gastrointestinal", "bowel_frequency", [
        single("bowel_frequency",
               "How many times have you had bowel opening since the last record?", FREQUENCY),
        multi("bowel_description", "How would you describe it/them? (Choose all that apply)", {
            "constipation": "Constipation", "diarrhoea": "Diarrhoea", "normal": "Normal",
        }, ("bowel_frequency", "not_eq", "none")),
        color("stool_appearance",
              "Which of the following has the closest resemblance to the shape of your faeces?", {
                  "small_pebbles": "Small pebbles",
                  "black_tarry": "Black and tarry",
                  "mushy_ragged": "Mushy with ragged edges",
                  "lumpy_sausage": "Lumpy and sausage-like",
                  "sausage_cracks": "Sausage-shape with cracks on surface",
                  "smooth_sausage": "Smooth, soft sausage-shape",
                  "soft_blobs": "Soft blobs with clear cut edges",
                  "liquid": "Liquid consistency with no solid pieces",
                  **OTHER}, ["black_tarry"], ("bowel_frequency", "in_list", OFTEN)),
        _other_text("stool_appearance"),
    ], method="frequency_map"),
    section("SN003", "Cough", "respiratory", "cough_pain", [
        single("cough_frequency", "How frequent is the coughing?", FREQUENCY),
        rating("cough_pain", "How would you describe the pain in your chest when you cough? "
               "Rate it on a scale of one to five.", BURDEN_0_5,
               ("cough_frequency", "not_eq", "none"), required=False),
        single("cough_type", "Is your cough mostly dry or wet cough?",
               {"dry": "Dry", "wet": "Wet"}, ("cough_frequency", "in_list", OFTEN), required=False),
        color("phlegm_color", "What is the colour of your phlegm?", {
            "transparent": "Transparent", "white": "White", "yellow": "Yellow", "green": "Green",
            "red": "Red", "brown": "Brown", "black": "Black",
        }, ["red", "black"], ("cough_type", "eq", "wet")),
    ], fallback=("cough_frequency", "frequency_map")),
    section("SN004", "Dyspnea", "respiratory", "dyspnea_pain", [
        single("dyspnea_frequency", "How often did you experience shortness of breath?", FREQUENCY),
        rating("dyspnea_pain", "How would you describe the pain when you are short of breath? "
               "Rate it on a scale of one to five.", BURDEN_0_5),
        multi("dyspnea_activities",
              "What activities usually cause shortness of breath? (Choose all that apply)", {
                  "talking": "Talking", "standing": "Standing", "running": "Running",
                  "getting_up": "Getting out of bed", "stairs": "Walking up the stairs",
                  "walking": "Walking short distances",
                  **OTHER}, ("dyspnea_frequency", "in_list", OFTEN)),
        _other_text("dyspnea_activities"),
    ]),
    section("SN005", "Dysuria", "urological", "dysuria_severity", [
        single("dysuria_frequency",
               "How often did you have difficulty urinating since the last record?", FREQUENCY),
        rating("dysuria_severity",
               "To what extent does it affect you? Rate it on a scale of one to five.", BURDEN_1_5),
        multi("dysuria_location", "Where do you feel pain/a burning sensation when you urinate? "
              "(Choose all that apply)", {
                  "bladder": "Bladder", "prostate": "Prostate", "urethra": "Urethra",
                  **OTHER}, ("dysuria_frequency", "in_list", OFTEN)),
        _other_text("dysuria_location"),
        color("urine_color",
              "Which of the following has the closest resemblance to the colour of your urine?", {
                  "transparent": "Transparent", "yellow": "Yellow", "orange": "Orange",
                  "red": "Red", "brown": "Brown", "blue_green": "Blue green",
              }, ["red", "brown"], ("dysuria_frequency", "in_list", OFTEN)),
    ]),
    section("SN006", "Insomnia", "sleep", "sleep_quality", [
        rating("sleep_quality", "How would you rate the quality of sleep last night? "
               "Rate it on a scale of one to five.", QUALITY_1_5),
        slider("sleep_hours", "Around how many hours have you slept last night in total?",
               0.5, 9.5, 0.5, " hours", ("sleep_quality", "gte", 4), low_limit=3.0),
        multi("sleep_symptoms",
              "Have these symptoms affected your quality of sleep? (Choose all that apply)", {
                  "not_applicable": "Not applicable",
                  "muscle_pain": "Muscle pain",
                  "joint_pain": "Joint pain",
                  "sore_throat": "Sore throat",
                  "headaches": "Headaches",
                  "anxiety": "Feeling anxious and/or depressed",
                  "memory": "Memory or concentration problems",
                  "exhausted": "Exhausted by everyday tasks",
                  **OTHER}, ("sleep_quality", "gte", 4)),
        _other_text("sleep_symptoms"),
    ]),
    section("SN007", "Fatigue", "energy", "fatigue_level", [
        rating("fatigue_level", "How is the general level of fatigue during the past 24 hours? "
               "Rate it on a scale of one to five.", BURDEN_0_5),
        rating("fatigue_interference", "How has fatigue interfered with your general activity? "
               "Rate it on a scale of one to five.", BURDEN_0_5,
               ("fatigue_level", "gte", 2), required=False),
    ]),
    section("SN008", "Nausea/Vomiting", "gastrointestinal", "nausea_level", [
        rating("nausea_level",
               "How would you describe your nausea? Rate it on a scale of one to five.", BURDEN_0_5),
        single("vomiting_episodes",
               "How many episodes of vomiting occurred since the last record?", FREQUENCY),
        color("vomit_color", "What was the colour of the vomit?", {
            "white": "White", "foamy": "Foamy", "green": "Green", "yellow": "Yellow",
            "orange": "Orange", "pink": "Pink", "red": "Red", "bloody": "Bloody",
            "brown": "Brown", "black": "Black",
        }, ["red", "bloody", "black"], ("vomiting_episodes", "not_eq", "none")),
    ]),
    section("SN009", "Hot Flashes", "thermoregulation", "hot_flash_intensity", [
        single("hot_flash_frequency",
               "How many times have you experienced hot flashes since the last record?", FREQUENCY),
        rating("hot_flash_intensity",
               "How intense are your hot flashes? Rate it on a scale of one to five.", BURDEN_1_5),
        slider("hot_flash_duration", "How long do they last?", 0, 15, 1, " minutes",
               ("hot_flash_frequency", "in_list", OFTEN)),
        multi("hot_flash_symptoms",
              "Do they come with the following symptoms? (Choose all that apply)", {
                  "not_applicable": "Not applicable",
                  "palpitations": "Palpitations (Rapid heartbeat)",
                  "sweating": "Sweating", "nausea": "Nausea", "dizziness": "Dizziness",
                  "anxiety": "Anxiety", "headache": "Headache", "weakness": "Weakness",
                  "suffocation": "Feeling of suffocation", "chills": "Followed by chills",
                  **OTHER}, ("hot_flash_frequency", "in_list", OFTEN)),
        _other_text("hot_flash_symptoms"),
    ]),
    section("SN010", "Vaginal Condition", "gynecological", "vaginal_discomfort", [
        single("vaginal_discharge",
               "Did you notice any vaginal discharge since the last record?",
               {"yes": "Yes", "no": "No", "dry": "No and it feels dry"}),
        rating("vaginal_discomfort", "How would you describe your vaginal discomfort? "
               "Rate it on a scale of one to five.", BURDEN_0_5),
        color("discharge_color", "How would you describe the colour of the discharge(s)?", {
            "clear": "Clear", "white": "White", "opaque": "Opaque in Colour",
            "yellowish": "Yellowish", "cottage_cheese": "Cottage-cheese like", "bloody": "Bloody",
        }, ["bloody"], ("vaginal_discharge", "in_list", ["yes", "dry"])),
    ]),
    section("SN011", "Headaches", "neurological", "headache_severity", [
        single("headache_frequency",
               "How many headaches did you experience since the last record?", FREQUENCY),
        rating("headache_severity",
               "How would you rate your headaches? Rate it on a scale of one to five.", BURDEN_1_5),
        diagram("body-diagram", "headache_location", "Where were your headaches located?", {
            "right_head": "Right side of head",
            "left_head": "Left side of head",
            "back_head": "Back of head",
            "left_temple": "Left temple",
            "right_temple": "Right temple",
            "behind_eyes": "Between eyes",
            "forehead": "Forehead",
            "top_head": "Top of head",
        }, ("headache_frequency", "in_list", OFTEN)),
    ]),
    section("SN012", "Joint Pain", "musculoskeletal", "joint_pain_areas", [
        diagram("joint-diagram", "joint_pain_areas", "Please choose all the areas where you have "
                "experienced joint pain since the last record.", JOINT_REGIONS, required=True),
    ], method="region_count"),
    section("SN013", "Musculoskeletal Pain", "musculoskeletal", "muscle_pain_areas", [
        diagram("muscle-diagram", "muscle_pain_areas", "Please choose all the areas where you have "
                "experienced muscle pain since the last record.", MUSCLE_REGIONS, required=True),
    ], method="region_count"),
]


def flat_questions(sections=None):
    """Questions in catalogue order, each carrying its section's identity."""
    out = []
    for s_pos, s in enumerate(sections or SECTIONS):
        for q_pos, q in enumerate(s["questions"]):
            out.append({"section_pos": s_pos, "question_pos": q_pos, "section_id": s["section_id"],
                        "title": s["title"], "clinical_area": s["clinical_area"], **q})
    return out
