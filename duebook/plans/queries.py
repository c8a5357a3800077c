"""Declarative queries over a snapshot: a filter spec, an aggregation spec, or a plan of steps, each as one DataFrame."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.functions import ranks
from duebook.functions.columns import dated, number, pair_label, rounded
from duebook.functions.expression import arithmetic
from duebook.functions.predicates import COMPARE, condition, conjunction, kind, resolve
from duebook.operators.kpis import total
from duebook.plans.checks import FUNCTIONS, _as_list, aggregation_problems, filter_problems, metrics_of, plan_problems, refuse
from duebook.schema import QUERY_COLUMNS


def _order(name: str, ascending: bool) -> Column:
    return F.asc_nulls_last(f"`{name}`") if ascending else F.desc_nulls_last(f"`{name}`")


def filter_rows(df: DataFrame, spec: dict) -> DataFrame:
    """The rows that satisfy every condition, sorted (descending by default), all columns."""
    refuse(filter_problems(df.columns, spec))
    rows = df.where(conjunction(df, spec.get("conditions") or []))
    if spec.get("sort_by"):
        ties = [F.asc_nulls_last("loan_no")] if "loan_no" in df.columns else []
        rows = rows.orderBy(_order(resolve(df.columns, spec["sort_by"]), bool(spec.get("sort_asc", False))), *ties)
    return rows


def run_filter(df: DataFrame, spec: dict) -> DataFrame:
    """``filter_rows`` with the display columns asked for, or the usual ones; timestamps as dates."""
    rows = filter_rows(df, spec)
    asked = [resolve(df.columns, c) for c in spec.get("display_columns") or []]
    return dated(rows.select(*(asked or [c for c in QUERY_COLUMNS if c in df.columns] or df.columns)))


def _counted(df: DataFrame, spec: dict) -> Column:
    if spec.get("column") == "__total__":
        return F.count(F.lit(1))
    spec = {**spec, "op": spec.get("op") or "=="}
    name = resolve(df.columns, spec["column"])
    if spec["op"] in COMPARE | {"!=": None} and spec["op"] != "==" and kind(df, name) == "text":
        # numeric comparison of a text column: what is no number differs from every number
        value = F.lit(float(spec["value"]))
        return F.count_if(~number(name).eqNullSafe(value) if spec["op"] == "!=" else COMPARE[spec["op"]](number(name), value))
    return F.count_if(condition(df, spec))


def _ranked(df: DataFrame, by: list[tuple[str, bool]], few: bool) -> DataFrame:
    """Rank 1..n in the order of (column, ascending), missing values last; columns of one row differ in the order's columns.

    ``few`` rows, after a limit, are ranked in one window; any number by ranges, and then the result is written once and read back.
    """
    order = [_order(c, up) for c, up in by]
    if few:
        return df.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("rank", *[f"`{c}`" for c in df.columns])
    return ranks.ranked(df, order)


def run_aggregation(df: DataFrame, spec: dict) -> DataFrame:
    """Groups with counts, sums and metrics, filtered by having, sorted (ascending by default), cut to a limit, ranked."""
    refuse(aggregation_problems(df.columns, spec))
    keys = [resolve(df.columns, k) for k in _as_list(spec["group_by"])][:2]
    rows = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    made = [_counted(df, c).alias(c["alias"]) for c in spec.get("counts") or []]
    made += [F.coalesce(F.sum(F.col(c)) if kind(df, c) == "number" else F.sum(number(c)), F.lit(0)).cast("double").alias(s["alias"]) for s in spec.get("sums") or [] for c in [resolve(df.columns, s["column"])]]
    out = rows.groupBy(*keys).agg(*made or [F.count(F.lit(1)).alias("__n")]).drop("__n")
    known = [c for c in out.columns if c not in keys]
    for m in metrics_of(spec):
        out = out.withColumn(m["label"], arithmetic(m["expr"], known))
        known.append(m["label"])
    for h in spec.get("having") or []:
        c, op, v = F.col(f"`{h['alias']}`"), h.get("op") or ">=", F.lit(h.get("value", 0))
        out = out.where(c != v if op == "!=" else COMPARE[op](c, v))
    label = f"{keys[0]} ({keys[1]})" if len(keys) == 2 else keys[0]
    shown = F.concat(F.trim(F.col(keys[0]).cast("string")), F.lit(" ("), F.trim(F.col(keys[1]).cast("string")), F.lit(")")) if len(keys) == 2 else F.col(keys[0])
    by = [(m["label"], spec.get("sort_asc") is not False) for m in metrics_of(spec)][:1] + [(k, True) for k in keys]
    try:
        limit = int(spec.get("limit") or 0)
    except (TypeError, ValueError):
        limit = 0
    if limit > 0:
        out = out.orderBy(*[_order(c, up) for c, up in by]).limit(limit)
    ranked = _ranked(out, by, limit > 0)
    return ranked.select("rank", shown.alias(label), *[f"`{c}`" for c in known])


def _aggregated(df: DataFrame, a: dict) -> Column:
    func, where = a["func"].lower(), conjunction(df, a.get("where") or [])
    given = bool(a.get("where"))
    if func == "count":
        return F.count_if(where) if given else F.count(F.lit(1))
    name = resolve(df.columns, a["column"])
    c = F.col(name)
    if func == "nunique":
        return F.count_distinct(F.when(where, c) if given else c)
    c = c if kind(df, name) == "number" else number(name)
    x = F.when(where, c) if given else c
    if func == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    value = {"mean": F.avg, "min": F.min, "max": F.max}[func](x)
    return F.when(F.count_if(where) == 0, F.lit(0)).otherwise(value) if given else value


def run_plan(df: DataFrame, plan: list[dict]) -> DataFrame:
    """The steps one after the other - group_aggregate, filter, derive, sort, limit - and ranks in the final order."""
    refuse(plan_problems(df.columns, plan))
    by: list[tuple[str, bool]] = []
    grouped = few = waiting = False  # waiting: sorted, but not yet put in order, as ranks or a limit do that
    for step in plan:
        op = step["op"].lower()
        if op == "group_aggregate":
            keys = [resolve(df.columns, k) for k in _as_list(step["group_by"])]
            made = [_aggregated(df, a).alias(a["alias"]) for a in step["aggregations"]]
            df = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*made)
            by, grouped, few, waiting = [(k, True) for k in keys], True, False, False
        elif op == "filter":
            df = df.where(conjunction(df, step.get("conditions") or []))
        elif op == "derive":
            df = df.withColumn(step["column"], arithmetic(step["expr"], df.columns))
        elif op == "sort":
            ties = by if grouped else [("loan_no", True)] if "loan_no" in df.columns else []
            first = resolve(df.columns, step["by"])
            by = [(first, bool(step.get("ascending", False))), *[t for t in ties if t[0] != first]]
            waiting = True
        elif op == "limit":
            try:
                n = int(step.get("n"))
            except (TypeError, ValueError):
                n = 0
            if n > 0:
                ordered = df.orderBy(*[_order(c, up) for c, up in by]) if waiting else df
                df, grouped, few, waiting = ordered.limit(n), True, True, False
    if "rank" in df.columns or not grouped:  # rows of the snapshot itself get no ranks before a limit
        return df.orderBy(*[_order(c, up) for c, up in by]) if waiting else df
    if not by:
        return df.withColumn("rank", F.row_number().over(W.orderBy(F.lit(1)))).select("rank", *df.columns)
    return _ranked(df, by, few)


def single_answer(df: DataFrame, spec: dict) -> DataFrame:
    """The first row of a ranked aggregation."""
    return run_aggregation(df, {**spec, "limit": 1})


def rows_behind(df: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``df`` whose loans a result shows, for results that lack the columns to rank by."""
    return df.join(result.select("loan_no"), "loan_no", "left_semi")


#: Ranking, its keys, how many places it has.
RANKINGS = (("regions", ("region_name",), 5), ("executives", ("mnt_name", "unit"), 8), ("branches", ("unit",), 5), ("bucket_share", ("curr_bucket",), None))


def contextual_rankings(df: DataFrame) -> DataFrame:
    """(ranking, place, name, value) of a query's rows: top regions, executives by branch, branches by loans and exposure, bucket shares.

    One scan: each row goes to one group per ranking, is combined per loan, then per group; the groups are few. Null keys are in no group.
    """
    groups = [
        F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.struct(
            F.lit(name).alias("ranking"), pair_label(*keys).alias("name") if len(keys) == 2 else F.col(keys[0]).cast("string").alias("name"),
            F.col(keys[0]).cast("string").alias("key"), F.col(keys[-1]).cast("string").alias("key2")))
        for name, keys, _ in RANKINGS
    ]
    rows = df.select("loan_no", "soh", F.explode(F.filter(F.array(*groups), lambda x: x.isNotNull())).alias("g")).select("g.*", "loan_no", "soh")
    keys = ("ranking", "name", "key", "key2")
    loans = rows.groupBy(*keys, "loan_no").agg(F.count(F.lit(1)).alias("n"), F.sum("soh").alias("soh"))
    found = loans.groupBy(*keys).agg(F.count("loan_no").cast("double").alias("loans"), F.sum("n").alias("n"), total("soh").alias("soh"))
    # a branch has a place by its loans and one by its exposure; the share of a bucket is that of all rows, also of those without one
    whole = df.agg(F.count(F.lit(1)).alias("whole"))
    found = found.crossJoin(whole)  # one row
    row = lambda name, by, value: F.struct(F.lit(name).alias("ranking") if isinstance(name, str) else name, by.alias("by"), value.alias("value"))
    loans_row, ranking = row(F.col("ranking").alias("ranking"), F.col("loans"), F.col("loans")), F.col("ranking")
    share = row("bucket_share", F.col("n").cast("double"), rounded(F.col("n") / F.col("whole") * 100, 1))
    made = F.when(ranking == "branches", F.array(loans_row, row("branch_exposure", F.col("soh"), F.col("soh")))).when(ranking == "bucket_share", F.array(share)).otherwise(F.array(loans_row))
    listed = found.select("name", "key", "key2", F.inline(made))
    listed = listed.withColumn("place", F.row_number().over(W.partitionBy("ranking").orderBy(F.desc("by"), "key", "key2")))
    most = F.lit(None).cast("int")
    for name, _, n in (*RANKINGS, ("branch_exposure", None, 5)):
        most = F.when(F.col("ranking") == name, F.lit(n).cast("int")).otherwise(most)
    return listed.where(F.coalesce(F.col("place") <= most, F.lit(True))).select("ranking", "place", "name", "value")


__all__ = ["FUNCTIONS", "contextual_rankings", "filter_rows", "rows_behind", "run_aggregation", "run_filter", "run_plan", "single_answer"]
