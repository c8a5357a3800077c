import pytest
from helpers import book, rows
from pyspark.sql import functions as F

from duebook.functions import columns as c
from duebook.functions.expression import arithmetic
from duebook.functions.predicates import SpecError


@pytest.mark.parametrize("x,expected", [
    (None, "NA"), (-1.0, "STD"), (0.0, "STD"), (0.001, "1-30 DPD"), (0.999, "1-30 DPD"), (1.0, "SMA-1"), (1.999, "SMA-1"), (2.0, "SMA-2"),
    (2.999, "SMA-2"), (3.0, "NPA"), (10.0, "NPA"), (float("nan"), "NA"),
])
def test_bucket_boundaries(spark, x, expected):
    assert c.with_buckets(spark.createDataFrame([(x,)], "arrears_emi double")).first()["curr_bucket"] == expected


def test_score_of_na(spark):
    assert rows(book(spark, [{"arrears_emi": None}, {"arrears_emi": 5.0}]), "curr_score") == [(-1,), (4,)]


def test_exposure_counts_missing_as_zero(spark):
    assert rows(book(spark, [{"pos": 80000.0, "closing_arrears": 20000.0}, {"pos": None, "closing_arrears": 5.0}]), "soh") == [(5.0,), (100000.0,)]


def test_previous_bucket_is_attached_once(spark):
    curr, prev = book(spark, [{"loan_no": "A"}, {"loan_no": "B"}, {"loan_no": None}]), book(spark, [{"loan_no": "A", "arrears_emi": 4.0}, {"loan_no": "A", "arrears_emi": 4.0}, {"loan_no": None}])
    found = c.with_prev_bucket(curr, prev).select("loan_no", "prev_bucket").collect()
    assert len(found) == 3 and {r["loan_no"]: r["prev_bucket"] for r in found} == {"A": "NPA", "B": None, None: None}


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(c.rounded(F.lit(0.125)), c.rounded(F.lit(0.375))).first()[:] == (0.12, 0.38)


def test_ratio_and_movement(spark):
    r = spark.range(1).select(c.ratio_pct(F.lit(7500.0), F.lit(10000.0)), c.ratio_pct(F.lit(1.0), F.lit(0.0)), c.mom_pct(F.lit(100.0), F.lit(80.0)), c.mom_pct(F.lit(1.0), F.lit(0.0))).first()
    assert r[:] == (75.0, 0.0, 25.0, 0.0)


@pytest.mark.parametrize("x,kind,expected", [(1e7, "money", "₹1.00Cr"), (1e5, "money", "₹1.00L"), (999.0, "money", "₹999"), (2.5e7, "count", "2.50Cr"), (12345.0, "count", "12,345"), (12.345, "pct", "12.35")])
def test_money_text(spark, x, kind, expected):
    assert spark.range(1).select(c.money_text(F.lit(x), kind)).first()[0] in (expected, "12.34" if kind == "pct" else expected)


def test_money_text_rounds_the_exact_value(spark):
    values = [135500.0, 100500.0, 112500.0, 137500.0, 199999.99, 99999.6, 9999999.99, 1e7, 10050000.0, 9.99995e12, -135500.0, 123456789.125]
    values += [k * 500.0 for k in range(200, 1200)]
    shares = [0.005, 0.015, 0.125, 0.375, 0.995, 1.005, 2.675, 99.995, 12.345, 0.0049, 1e-300, 0.0, -0.125, -0.001, 1e18]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "x double")
    text = lambda v: f"₹{v / 1e7:.2f}Cr" if abs(v) >= 1e7 else f"₹{v / 1e5:.2f}L" if abs(v) >= 1e5 else f"₹{v:,.0f}"
    assert [r[0] for r in df(values).select(c.money_text(F.col("x"))).collect()] == [text(v) for v in values]
    assert [r[0] for r in df(shares).select(c.money_text(F.col("x"), "pct")).collect()] == [f"{v:.2f}" for v in shares]
    assert df([float("nan")]).select(c.money_text(F.col("x"), "pct")).first()[0] == "NaN"


def test_dates_text_and_names(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 10:00:00' AS t, 1 AS n, CAST(NULL AS string) AS s")
    assert str(c.dated(df).first()["t"]) == "2024-01-02"
    assert c.as_text(df).first()[:] == ("2024-01-02 10:00:00", "1", "")
    assert c.distinct_names(spark.sql("SELECT 1 AS a, 2 AS a, 3 AS b")).columns == ["a", "b"]


@pytest.mark.parametrize("parts", [1, 7])
def test_preview_and_total_come_from_one_job(spark, parts):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("preview"))
    df = spark.range(0, 5000, 1, parts)
    before = jobs()
    spark.sparkContext.setJobGroup("preview", "")
    try:
        shown, n = c.preview(df, 3)
        assert [r["id"] for r in shown] == [0, 1, 2] and n == 5000 and jobs() - before == 1
        shown, n = c.preview(df.select((-F.col("id")).alias("id")), 2, ("id",))
        assert [r["id"] for r in shown] == [-4999, -4998] and n == 5000
        assert c.preview(df.limit(0), 3) == ([], 0)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_preview_counts_all_rows_that_come_sorted(spark):
    left, right = spark.range(5000), spark.range(0, 5000, 1).withColumnRenamed("id", "k")
    joined = left.hint("merge").join(right, F.col("id") == F.col("k")).select("id")
    shown, n = c.preview(joined, 3, ("id",))
    assert [r["id"] for r in shown] == [0, 1, 2] and n == 5000


def test_arithmetic(spark):
    df = spark.createDataFrame([(3.0, 0.0)], "a double, b double")
    known = ["a", "b"]
    got = df.select(*[arithmetic(e, known) for e in ("a / b", "(a + 1) * 2 - -b", "a / 7")]).first()
    assert got[:] == (0.0, 8.0, 0.43)
    for bad in ("c + 1", "__import__('os')", "a ** 2", "a +"):
        with pytest.raises(SpecError):
            arithmetic(bad, known)
