from datetime import datetime

import pytest
from helpers import AS_OF, book, rows
from pyspark.sql import functions as F

from duebook.functions import predicates as p
from duebook.plans.queries import filter_rows, run_filter


def ids(df, *conditions):
    return [r["loan_no"] for r in filter_rows(df, {"conditions": list(conditions)}).orderBy("loan_no").collect()]


def cond(column, op, value=None):
    return {"column": column, "op": op, "value": value}


def test_text_compares_without_case_and_edges(spark):
    df = book(spark, [{"unit": " alpha"}, {"unit": "BETA"}, {"unit": None}])
    assert ids(df, cond("Unit", "==", "Alpha ")) == ["L001"]
    assert ids(df, cond("unit", "!=", "alpha")) == ["L002", "L003"]
    assert ids(df, cond("unit", "in", ["ALPHA", "beta"])) == ["L001", "L002"]
    assert ids(df, cond("unit", "contains", "^b.t")) == ["L002"]
    assert ids(df, cond("unit", "==", "nan")) == []


def test_numbers_and_nulls(spark):
    df = book(spark, [{"arrears_emi": 1.0}, {"arrears_emi": 2.0}, {"arrears_emi": None}])
    assert ids(df, cond("Arrears / EMI", "!=", 1)) == ["L002", "L003"]
    assert ids(df, cond("arrears_emi", ">=", "2")) == ["L002"]
    assert ids(df, cond("arrears_emi", "in", [1, 2, 3])) == ["L001", "L002"]


def test_dates(spark):
    df = book(spark, [{"ag_date": datetime(2024, 1, 1)}, {"ag_date": datetime(2023, 1, 1)}, {"ag_date": None}])
    assert ids(df, cond("Ag_Date", ">=", "2024-01-01")) == ["L001"]
    assert ids(df, cond("Ag_Date", "!=", "2024-01-01")) == ["L002", "L003"]


def test_bucket_moves(spark):
    df = book(spark, [{"arrears_emi": 4.0}, {"arrears_emi": 0.0}, {"arrears_emi": None}]).withColumn("prev_bucket", F.lit("SMA-1"))
    assert ids(df, cond("curr_bucket", "bucket_worse_than", "prev_bucket")) == ["L001"]
    assert ids(df, cond("curr_bucket", "bucket_better_than", "prev_bucket")) == ["L002"]
    assert ids(df, cond("curr_bucket", "bucket_stable", "prev_bucket")) == []


def test_column_against_column(spark):
    df = book(spark, [{"collection": 5.0, "demand": 10.0}, {"collection": 10.0, "demand": 10.0}])
    assert ids(df, cond("collection", "<", {"col": "demand"})) == ["L001"]


@pytest.mark.parametrize("bad", [cond("nope", "==", 1), cond("unit", ">", "a"), cond("arrears_emi", "==", "many"), cond("unit", "like", "x"), cond("ag_date", ">", "soon")])
def test_what_cannot_apply_raises(spark, bad):
    with pytest.raises(p.SpecError):
        ids(book(spark, [{}]), bad)


def test_sort_display_and_empty(spark):
    df = book(spark, [{"arrears_emi": 1.0}, {"arrears_emi": 3.0}, {"arrears_emi": None}])
    out = run_filter(df, {"conditions": [], "sort_by": "arrears_emi"})
    assert [r["loan_no"] for r in out.collect()] == ["L002", "L001", "L003"] and dict(out.dtypes)["ag_date"] == "date"
    assert run_filter(df, {"conditions": [cond("unit", "==", "x")], "display_columns": ["Loan No"]}).collect() == []


def test_slicers(spark):
    df = book(spark, [{}, {"region_name": "EAST", "unit": "BETA"}, {"unit": "BETA", "loan_status": "Closed"}])
    n = lambda **k: p.sliced(df, **k).count()
    assert (n(), n(region="WEST"), n(branch="ALPHA"), n(status="Closed"), n(region="WEST", branch="BETA"), n(region="NORTH")) == (3, 2, 1, 1, 1, 0)
    assert [r[0] for r in p.slicer_values(df, "unit", "WEST").collect()] == ["ALPHA", "BETA"]


def test_segments_apply(spark):
    df = book(spark, [{"colending": "y", "arrears_emi": 7.0}]).withColumns({"nach_status": F.lit("N"), "lgl_flag": F.lit("N"), "customer_status": F.lit("dead")})
    flags = df.select(*[v.alias(k) for k, v in p.segments(AS_OF).items()]).first().asDict()
    assert {k for k, v in flags.items() if v} == {"colending", "colending_at_risk", "deceased", "delinquent", "hard_bucket", "nach_inactive", "overdue", "at_risk", "three_emi_arrears", "strike_yes"}
    assert rows(df, "loan_no") == [("L001",)]
