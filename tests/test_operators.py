from datetime import datetime

import pytest
from helpers import AS_OF, book, rows
from pyspark.sql import functions as F

from duebook.functions.columns import with_prev_bucket
from duebook.operators import alerts, branches, kpis, migration, priority, report, scorecard
from duebook.plans.queries import contextual_rankings, rows_behind


def table(df):
    return {r["kpi"]: (r["value"], r["mom_pct"]) for r in df.collect()}


def test_kpis(spark):
    curr = book(spark, [{"collection": 7500.0, "arrears_emi": 3.0}, {"collection": 7500.0, "arrears_emi": 7.0, "strike": "N"}, {"collection": 7500.0, "strike": None}])
    prev = book(spark, [{"collection": 6000.0}])
    t = table(kpis.kpi_table(curr, prev))
    assert len(t) == 10 and t["collection_pct"] == (75.0, 25.0) and t["npa_pct"][0] == 66.67 and t["strike_pct"][0] == 50.0 and t["hard_bucket_pct"][0] == 33.33 and t["count"][0] == 3


def test_kpis_of_nothing(spark):
    t = table(kpis.kpi_table(book(spark, [{"demand": 0.0}]), book(spark, [])))
    assert t["collection_pct"] == (0.0, 0.0) and t["count"] == (1.0, 0.0)
    assert all(v == 0 for v, _ in table(kpis.kpi_table(book(spark, []), book(spark, []))).values())


def test_health_lights(spark):
    found = {r["kpi"]: r["light"] for r in kpis.portfolio_health(book(spark, [{"collection": 8000.0}]), book(spark, [])).collect()}
    assert found["collection_pct"] == "amber" and found["npa_pct"] == "green" and found["soh"] is None


@pytest.mark.parametrize("row,expected", [
    ({"non_starter": "y"}, {"non_starter"}), ({"closing_arrears": 500.0}, {"easy_settlement"}), ({"closing_arrears": 999.0}, {"easy_settlement"}), ({"closing_arrears": 1000.0}, set()),
    ({"colending": "Y", "arrears_emi": 1.0}, {"colending"}), ({"colending": "Y"}, set()), ({"arr_exp": 8000.0, "arrears_emi": 0.5}, {"insurance"}),
    ({"arr_exp": 3000.0, "arrears_emi": 0.5}, set()), ({"arr_exp": 8000.0, "arr_inst": 5000.0, "arrears_emi": 0.5}, set()), ({"arr_exp": 8000.0}, set()),
    ({"arr_inst": 110000.0}, {"high_arrears"}), ({"arr_inst": 80000.0}, set()), ({"arr_inst": 40000.0, "arr_exp": 40000.0, "arr_bc": 40000.0}, {"high_arrears"}),
    ({"arr_inst": 110000.0, "loan_amount": 0.0}, set()), ({"ag_date": datetime(2023, 6, 1), "arrears_emi": 0.5}, {"recent_advances"}), ({"ag_date": datetime(2023, 5, 31), "arrears_emi": 0.5}, set()), ({}, set()),
])
def test_alert_rules(spark, row, expected):
    found = alerts.summary(book(spark, [row]), AS_OF).collect()
    assert len(found) == 6 and {r["alert_id"] for r in found if r["count"]} == expected


def test_one_scan_equals_six_filters(spark):
    df = book(spark, [{"non_starter": "Y", "closing_arrears": 10.0, "arrears_emi": 4.0, "colending": "Y"}, {"arr_inst": 150000.0, "loan_no": "L001"}])
    found = {r["alert_id"]: (r["count"], r["soh"]) for r in alerts.summary(df, AS_OF).collect()}
    for name, rule in alerts.rules(AS_OF).items():
        one = df.where(rule).agg(F.count_distinct("loan_no"), F.coalesce(F.sum("soh"), F.lit(0.0))).first()
        assert found[name] == tuple(one)
    assert alerts.risk_flags(alerts.summary(df, AS_OF)).count() == 3
    assert rows(alerts.drilldown(df, AS_OF, alert="high_arrears"), "loan_no", "arrears_ratio_pct") == [("L001", 75.0)]


def test_priority_takes_the_best_rule_of_any_row(spark):
    df = book(spark, [{"loan_no": "A", "arrears_emi": 5.0}, {"loan_no": "A", "non_starter": "Y"}, {"loan_no": "B", "no_coll_3m": "Y", "colending": "Y", "arrears_emi": 1.0}, {"loan_no": "C"}])
    found = rows(priority.ranked(df, AS_OF), "loan_no", "rank")
    assert found == [("A", 1), ("B", 5)]
    listed = priority.priority_list(df, AS_OF)
    assert listed.first()["priority"] == "P1: Non Starters" and listed.columns[0] == "priority"


def test_quota(spark):
    df = book(spark, [{"non_starter": "Y"} for _ in range(5)] + [{"arrears_emi": 4.0} for _ in range(1)] + [{"no_coll_3m": "Y"} for _ in range(5)])
    found = priority.quota(priority.ranked(df, AS_OF), 7).groupBy("rank").count()
    assert dict(rows(found)) == {1: 3, 6: 2, 7: 1}  # three groups: 3, 2, 2; the last has one row only


def test_scorecard_tiers_and_least(spark):
    made = [{"unit": f"U{u}", "collection": 1000.0 * u, "arrears_emi": 4.0 if k == 0 else 0.0} for u in range(1, 6) for k in range(5)] + [{"unit": "SMALL"}]
    curr = book(spark, made)
    card = scorecard.scorecard(with_prev_bucket(curr, book(spark, [{"arrears_emi": 0.0} for _ in made])))
    found = {r["unit"]: (r["collection_pct"], r["tier"], r["npa_pct"], r["roll_fwd_pct"]) for r in card.collect()}
    assert found == {"U1": (10.0, "bottom", 20.0, 20.0), "U2": (20.0, "bottom", 20.0, 20.0), "U3": (30.0, "mid", 20.0, 20.0), "U4": (40.0, "top", 20.0, 20.0), "U5": (50.0, "top", 20.0, 20.0)}
    assert scorecard.summary(card).first()["executives"] == 5
    assert [r["unit"] for r in scorecard.bottom(card).collect()] == ["U1", "U2"] and scorecard.top(card).first()["unit"] == "U5"


def test_branches(spark):
    df = book(spark, [{"unit": "A", "collection": 5000.0}, {"unit": "B"}, {"unit": "C", "demand": 0.0}, {"unit": None}])
    assert [r["branch"] for r in branches.top_branches(df, 2).collect()] == ["B", "A"]
    assert [r["branch"] for r in branches.bottom_branches(df, 2).collect()] == ["C", "A"]
    assert [r["branch"] for r in branches.best_branches(df, 2).collect()] == ["A", "B"]
    assert [r["loans"] for r in branches.loans_by_bucket(df).collect()] == [4, 0, 0, 0, 0, 0]
    assert len(branches.arrears_by_bucket(book(spark, [])).collect()) == 6


def test_migration(spark):
    prev = book(spark, [{"loan_no": "A"}, {"loan_no": "B", "arrears_emi": 4.0}, {"loan_no": "C", "arrears_emi": None}, {"loan_no": "X"}])
    curr = book(spark, [{"loan_no": "A", "arrears_emi": 4.0}, {"loan_no": "B"}, {"loan_no": "C"}, {"loan_no": "N"}])
    k = migration.migration_kpis(curr, prev).first()
    assert (k["matched"], k["roll_forward_pct"], k["roll_backward_pct"], k["npa_formation_pct"], k["new_entries"], k["exits"]) == (2, 50.0, 50.0, 100.0, 1, 1)
    m = migration.matrix(curr, prev)
    assert m.count() == 5 and sum(sum(r[2:]) for r in m.collect()) == 2
    assert rows(migration.intensity(curr, prev), "prev_bucket", "intensity") == [("NPA", -200.0), ("STD", 200.0)]


def test_migration_of_nothing(spark):
    k = migration.migration_kpis(book(spark, [{}]), book(spark, [])).first()
    assert tuple(k) == (0, 0.0, 0.0, 0.0, 0, 0)  # no month to compare with: no new loans either


def test_report_needs_only_its_columns(spark):
    curr, prev = book(spark, [{"arrears_emi": 2.5}, {"arrears_emi": 0.0}]), book(spark, [{"arrears_emi": 1.5}])
    curr = with_prev_bucket(curr, prev)
    assert len(report.CURR) < len(curr.columns) and len(report.PREV) < len(prev.columns)
    some = report.figures(report.sections(curr.select(*report.CURR), prev.select(*report.PREV), AS_OF))
    assert rows(some) == rows(report.figures(report.sections(curr, prev, AS_OF)))


def test_report(spark, tmp_path):
    curr, prev = book(spark, [{} for _ in range(6)]), book(spark, [{}])
    sections = report.sections(with_prev_bucket(curr, prev), prev, AS_OF)
    report.write({"health": sections["portfolio_health"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/health").count() == 10 and len(sections) == 8


def test_lights(spark):
    card = spark.createDataFrame([(100.0, 20.0, 4.9), (100.1, 10.0, 5.0), (89.9, 9.9, 10.0), (None, None, None)], "collection_pct double, roll_fwd_pct double, roll_bwd_pct double")
    got = [tuple(r)[3:] for r in scorecard.banded(card).collect()]
    assert got == [("amber", "red", "grey"), ("green", "amber", "amber"), ("red", "green", "green"), (None, None, None)]


def test_first_month_has_no_new_loans(spark):
    k = migration.migration_kpis(book(spark, [{}, {}]), book(spark, [])).first()
    assert k["new_entries"] == 0 and k["exits"] == 0 and k["matched"] == 0
    assert migration.migration_kpis(book(spark, []), book(spark, [{}, {}])).first()["exits"] == 2


def test_rankings_of_a_result_without_columns(spark):
    df = book(spark, [{"unit": "A"}, {"unit": "B"}, {"unit": "B"}, {"unit": None, "region_name": None}])
    shown = df.where("loan_no <> 'L003'").select("loan_no")
    got = rows(contextual_rankings(rows_behind(df, shown)))
    assert ("branches", 1, "A", 1.0) in got and ("branches", 2, "B", 1.0) in got and ("regions", 1, "WEST", 2.0) in got
    assert [r for r in got if r[0] == "bucket_share"] == [("bucket_share", 1, "STD", 100.0)] and len([r for r in got if r[0] == "branch_exposure"]) == 2
