import random

import pytest
from helpers import book
from pyspark.sql import functions as F

from duebook.functions.predicates import SpecError
from duebook.plans import checks
from duebook.plans.queries import contextual_rankings, run_aggregation, run_plan, single_answer


def npa(alias, column):
    return {"alias": alias, "column": column, "op": "==", "value": "NPA"}


@pytest.fixture
def moves(spark):
    data = [("Q", "NPA", "NPA")] * 3 + [("Q", "NPA", "STD"), ("R", "NPA", "SMA-1"), ("R", "NPA", "STD"), ("T", "NPA", "1-30 DPD"), ("S", "NPA", "SMA-2"), (None, "NPA", "NPA")] + [("S", "NPA", "NPA")] * 2
    return spark.createDataFrame(data, "unit string, prev_bucket string, curr_bucket string")


SPEC = {"group_by": "Unit", "counts": [npa("before", "prev_bucket"), npa("after", "curr_bucket")], "metrics": [{"label": "cut", "expr": "(before - after) / before * 100"}], "sort_asc": False}


def test_reduction_order_limit_having(moves):
    units = lambda **more: [r["unit"] for r in run_aggregation(moves, {**SPEC, **more}).collect()]
    assert [(r["rank"], r["unit"], r["cut"]) for r in run_aggregation(moves, SPEC).collect()] == [(1, "R", 100.0), (2, "T", 100.0), (3, "S", 33.33), (4, "Q", 25.0)]
    assert units(limit=3) == ["R", "T", "S"] and units(having=[{"alias": "before", "op": ">=", "value": 3}]) == ["S", "Q"]
    assert single_answer(moves, SPEC).first()["unit"] == "R"


def test_counts_of_every_kind(spark):
    df = book(spark, [{"unit": "A", "arrears_emi": 4.0}, {"unit": "A", "arrears_emi": None}, {"unit": "B", "arrears_emi": 2.0}])
    got = run_aggregation(df, {"group_by": "unit", "counts": [
        {"alias": "total", "column": "__total__"}, {"alias": "high", "column": "arrears_emi", "op": ">", "value": 3}, {"alias": "other", "column": "arrears_emi", "op": "!=", "value": 4},
        {"alias": "sma", "column": "curr_bucket", "op": "in", "value": ["SMA-2"]}, {"alias": "zero", "column": "arr_inst", "value": 0},
    ], "sums": [{"alias": "soh", "column": "SOH"}]})
    assert [tuple(r) for r in got.collect()] == [(1, "A", 2, 1, 1, 0, 2, 200000.0), (2, "B", 1, 0, 1, 1, 1, 100000.0)]


def test_two_keys(spark):
    df = book(spark, [{"mnt_name": "X", "unit": "A"}, {"mnt_name": None, "unit": "A"}])
    assert [tuple(r) for r in run_aggregation(df, {"group_by": ["MNT NAME", "Unit"], "counts": [{"alias": "n", "column": "__total__"}]}).collect()] == [(1, "X (A)", 1)]


def test_plan_levels_where_and_derive(spark):
    df = book(spark, [{"unit": "A", "cust_mob_no": "1"}, {"unit": "A", "cust_mob_no": "1"}, {"unit": "A", "cust_mob_no": "2", "arrears_emi": 4.0}, {"unit": "B", "cust_mob_no": "3"}])
    plan = [
        {"op": "group_aggregate", "group_by": ["unit", "cust_mob_no"], "aggregations": [{"alias": "loans", "func": "nunique", "column": "loan_no"}, {"alias": "npa", "func": "count", "where": [{"column": "curr_bucket", "op": "==", "value": "NPA"}]}]},
        {"op": "group_aggregate", "group_by": "unit", "aggregations": [{"alias": "customers", "func": "count"}, {"alias": "loans", "func": "sum", "column": "loans"}, {"alias": "npa", "func": "sum", "column": "npa"}]},
        {"op": "derive", "column": "per", "expr": "loans / npa"}, {"op": "sort", "by": "customers"},
    ]
    assert [tuple(r) for r in run_plan(df, plan).collect()] == [(1, "A", 2, 3, 1, 3.0), (2, "B", 1, 1, 0, 0.0)]
    assert run_plan(df, [*plan, {"op": "limit", "n": 1}]).count() == 1


def test_mean_where_nothing_matches_is_zero(spark):
    df = book(spark, [{"arrears_emi": 1.0}, {"arrears_emi": 2.0}])
    got = run_plan(df, [{"op": "group_aggregate", "group_by": ["unit"], "aggregations": [
        {"alias": "all", "func": "mean", "column": "arrears_emi"}, {"alias": "none", "func": "mean", "column": "arrears_emi", "where": [{"column": "arrears_emi", "op": ">", "value": 9}]}]}]).first()
    assert (got["all"], got["none"]) == (1.5, 0.0)


def test_rows_of_a_plan_without_aggregation(spark):
    df = book(spark, [{"arrears_emi": x} for x in (1.0, 3.0, 2.0)])
    assert [r["loan_no"] for r in run_plan(df, [{"op": "sort", "by": "arrears_emi"}, {"op": "limit", "n": 2}]).select("rank", "loan_no").collect()] == ["L002", "L003"]
    assert run_plan(df, [{"op": "filter", "conditions": []}]).count() == 3


def test_checks_list_every_problem():
    columns = ["unit", "loan_no"]
    found = checks.plan_problems(columns, [
        {"op": "group_aggregate", "group_by": ["unit"], "aggregations": [{"alias": "n", "func": "count"}, {"alias": "m", "func": "median", "column": "x"}]},
        {"op": "filter", "conditions": [{"column": "loan_no", "op": "==", "value": 1}]}, {"op": "jump"},
    ])
    assert len(found) == 4 and any("step 2" in f for f in found)  # loan_no is gone after the aggregation
    assert checks.aggregation_problems(columns, {"group_by": "branch", "metrics": [{"expr": "a / b", "label": "r"}], "having": [{"alias": "q"}]})
    assert checks.filter_problems(columns, {"conditions": [{"column": "zone", "op": "=="}], "sort_by": "pos"}) == ["unknown column 'zone'", "unknown column 'pos'"]
    assert checks.filter_problems(columns, {"conditions": [{"column": "Loan No", "op": "==", "value": 1}]}) == []


def test_bad_specs_raise(spark):
    df = book(spark, [{}])
    for call in (lambda: run_plan(df, []), lambda: run_aggregation(df, {"group_by": "zone"}), lambda: run_plan(df, [{"op": "sort", "by": "zone"}])):
        with pytest.raises(SpecError):
            call()


def test_rankings(spark):
    got = contextual_rankings(book(spark, [{}, {"unit": "B", "region_name": "EAST"}, {"unit": "B", "arrears_emi": 4.0}])).collect()
    assert [(r["name"], r["value"]) for r in got if r["ranking"] == "branches"] == [("B", 2.0), ("ALPHA", 1.0)]
    assert [(r["name"], r["value"]) for r in got if r["ranking"] == "bucket_share"] == [("STD", 66.7), ("NPA", 33.3)]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("limit", [0, 7])
def test_ranks_in_buckets_follow_the_order(spark, ascending, limit):
    r = random.Random(6)
    made = [(f"{r.choice(['', 'a', 'ab', 'é', 'zz'])}{k:03}", r.choice([None, 0.0, 0.0, -3.5, 1e9, 12.25, r.uniform(-50, 50)])) for k in range(150)]
    df = spark.createDataFrame(made, "k string, v double").repartition(5)
    plan = [{"op": "group_aggregate", "group_by": ["k"], "aggregations": [{"alias": "v", "func": "max", "column": "v"}]}, {"op": "sort", "by": "v", "ascending": ascending}]
    got = [(x["rank"], x["k"]) for x in run_plan(df, plan + ([{"op": "limit", "n": limit}] if limit else [])).orderBy("rank").collect()]
    expected = sorted(made, key=lambda x: (x[1] is None, (x[1] or 0) * (1 if ascending else -1), x[0]))
    assert got == [(n, k) for n, (k, _) in enumerate(expected[: limit or None], 1)]


def test_problems_are_rows(spark):
    df = book(spark, [{}])
    found = checks.problems(spark, df, {"good": ("filter", {"conditions": []}), "bad": ("plan", [{"op": "sort", "by": "zone"}, {"op": "derive", "column": "x", "expr": "pos +"}]), "none": ("plan", [])})
    assert sorted((r["spec"], r["place"]) for r in found.collect()) == [("bad", 1), ("bad", 2), ("none", 1)]
    assert checks.problems(spark, df, {}).collect() == []


def test_many_groups_are_ranked_in_even_ranges_from_one_evaluation(spark):
    """Names that share their first characters, so no prefix tells them apart."""
    from duebook.functions import ranks

    n = 200_000
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(n).selectExpr("concat('Customer#', lpad(cast((id * 7919) % 200000 as string), 9, '0')) AS cust_name", "cast(id % 50 as double) AS v", "'A' AS unit")
    df = rows.mapInArrow(counted, rows.schema)
    spec = {"group_by": "cust_name", "counts": [{"alias": "n", "column": "__total__"}]}
    got = run_aggregation(df, spec)
    sample = got.where("rank IN (1, 2, 100000, 200000)").orderBy("rank").collect()
    assert [(r["rank"], r["cust_name"]) for r in sample] == [(k, f"Customer#{k - 1:09d}") for k in (1, 2, 100_000, 200_000)]
    assert seen.value == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranks.placed(rows, [F.asc("cust_name")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in placed.groupBy(F.shiftright("__at", ranks.PLACE_BITS)).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) <= 2 * n / len(sizes)


def test_sorted_plans_order_once(spark):
    df = book(spark, [{"unit": u, "arrears_emi": x} for u, x in (("A", 1.0), ("B", 3.0), ("C", 2.0), ("B", 9.0))])
    count = {"op": "group_aggregate", "group_by": ["unit"], "aggregations": [{"alias": "n", "func": "count"}, {"alias": "top", "func": "max", "column": "arrears_emi"}]}
    sort = {"op": "sort", "by": "top"}
    assert [(r["rank"], r["unit"]) for r in run_plan(df, [count, sort]).collect()] == [(1, "B"), (2, "C"), (3, "A")]
    assert [(r["rank"], r["unit"]) for r in run_plan(df, [count, sort, {"op": "limit", "n": 2}, {"op": "filter", "conditions": [{"column": "n", "op": "<", "value": 2}]}]).collect()] == [(1, "C")]
    assert [r["arrears_emi"] for r in run_plan(df, [{"op": "sort", "by": "arrears_emi"}, {"op": "filter", "conditions": [{"column": "arrears_emi", "op": "<", "value": 5}]}]).collect()] == [3.0, 2.0, 1.0]
    # a grouping after a sort starts anew
    assert [r["unit"] for r in run_plan(df, [{"op": "sort", "by": "arrears_emi"}, count]).collect()] == ["A", "B", "C"]
