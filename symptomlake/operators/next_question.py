"""Branching questionnaires: the next eligible question per respondent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

CATALOGUE_DDL = ("array<struct<question_number:int,text:string,"
                 "prerequisites:array<struct<question_number:int,allowed_answers:array<string>>>>>")


def next_question(respondents: DataFrame, catalogue: list[dict]) -> DataFrame:
    """First question in order that is unanswered and whose prerequisites hold.

    ``answers`` is ``map<string, array<string>>`` keyed by question number; one
    matching answer satisfies a prerequisite. The catalogue is a literal, so the
    whole operator is a projection.
    """
    questions = F.from_json(F.lit(json.dumps(catalogue)), CATALOGUE_DDL)

    def met(p):
        given = F.col("answers")[p["question_number"].cast("string")]
        return F.coalesce(F.arrays_overlap(given, p["allowed_answers"]), F.lit(False))

    def eligible(q):
        open_ = ~F.map_contains_key(F.col("answers"), q["question_number"].cast("string"))
        return open_ & F.forall(F.coalesce(q["prerequisites"], F.array()), met)

    rows = respondents.withColumn("q", F.get(F.filter(questions, eligible), F.lit(0)))
    keep = [c for c in respondents.columns if c != "answers"]
    return rows.select(
        *keep, F.coalesce(F.col("q.question_number"), F.size("answers")).alias("question_number"),
        F.col("q.text").alias("next_question"), F.lit(len(catalogue)).alias("total_questions"),
        F.col("q").isNull().alias("completed"))
