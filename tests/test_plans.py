"""The composed answers run end to end on the smallest tables."""

from symptomlake.plans import reports
from workload import adapter as A

SF = "/root/testdata/sf0.001"


def test_weekly_answer_parts_agree(spark):
    parts = reports.weekly_answer(A.users(spark, SF), A.assessments(spark, SF), A.AS_OF)
    active = parts["report"].where("total_assessments > 0")
    assert parts["daily"].count() == active.count() * 7
    assert parts["by_symptom"].select("user_id").distinct().count() == active.where("top_symptom is not null").count()
    assert parts["trends"].count() >= parts["by_symptom"].count()


def test_doctor_day_parts(spark):
    parts = reports.doctor_day(A.assignments(spark, SF), A.users(spark, SF), A.assessments(spark, SF),
                               A.slot_requests(spark, SF), A.calendar_events(spark, SF), 5)
    assert parts["alerts"].groupBy("doctor_id").count().where("count > 5").count() == 0
    assert parts["panel"].count() > 0 and parts["free"].count() > 0
    assert parts["history"].where("newest_rank > 10").count() == 0
