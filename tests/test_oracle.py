"""Every registered query against its DuckDB text, and the shape of its plan."""

import pytest

from symptomlake.operators import careteam, monthly, weekly
from workload import adapter as A, compare, oracle, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    ok, note = compare.compare(spark, con, name, SF)
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(oracle.SQL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("stream_")))
def test_no_cross_product_and_no_python_in_batch_plans(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


def test_week_filter_and_columns_reach_the_scan(spark):
    text = plan(weekly.weekly_alerts(A.assessments(spark, SF), A.AS_OF))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text
    assert "symptoms" not in text.split("ReadSchema:")[1]
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_daily_series_needs_one_shuffle(spark):
    assert plan(weekly.weekly_daily_series(A.assessments(spark, SF), A.AS_OF)).count("Exchange") == 1
    assert plan(monthly.monthly_severity_by_day(A.assessments(spark, SF), A.AS_OF)).count("Exchange") == 1


def test_newest_rows_are_cut_before_the_shuffle(spark):
    text = plan(careteam.doctor_alerts(A.assignments(spark, SF), A.assessments(spark, SF)))
    assert text.count("WindowGroupLimit") == 4


def test_single_patient_filter_is_pushed_down(spark):
    rows = A.assessments(spark, SF).where("user_id = 7")
    assert "EqualTo(user_id,7)" in plan(weekly.weekly_alerts(rows, A.AS_OF))


def test_weekly_report_scans_its_week_once(spark):
    """Days and symptoms are grouping sets of one aggregation; one exchange by user, reduced before it."""
    text = plan(weekly.weekly_report(A.users(spark, SF), A.assessments(spark, SF), A.AS_OF))
    week = text[text.index("HashAggregate") if "HashAggregate" in text else 0:]
    assert text.count("FileScan parquet") == 2  # the users and the week
    assert text.count("symptoms#") and text.count("PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at") == 1
    by_user = [line for line in text.splitlines() if "Exchange hashpartitioning(user_id" in line]
    assert len([x for x in by_user if "symptom#" in x]) == 1  # by (user, day, symptom), reduced on the map side
    assert len([x for x in by_user if "symptom#" not in x and ", day#" not in x]) <= 2  # the patients' rows, and the users'
    assert week.count("Generate inline") == 1


def test_weekly_report_with_exact_bounds(spark):
    rows = A.assessments(spark, SF)
    report = weekly.weekly_report(A.users(spark, SF), rows, "2024-01-28 12:00:00", exact_bounds=True)
    days = weekly.weekly_daily_series(rows, "2024-01-28 12:00:00", exact_bounds=True)
    top = weekly.most_concerning_symptom(rows, "2024-01-28 12:00:00", exact_bounds=True)
    trend = weekly.weekly_trend(rows, "2024-01-28 12:00:00", exact_bounds=True)
    one = report.where("total_assessments > 0").select("user_id", "top_symptom", "overall_trend")
    assert sorted(one.collect(), key=str) == sorted(trend.join(top, "user_id", "left").select("user_id", "symptom_name", "overall_trend").collect(), key=str)
    assert report.agg({"total_assessments": "sum"}).first()[0] == days.agg({"assessment_count": "sum"}).first()[0]
    assert report.agg({"total_assessments": "sum"}).first()[0] != weekly.weekly_report(
        A.users(spark, SF), rows, "2024-01-28").agg({"total_assessments": "sum"}).first()[0]
