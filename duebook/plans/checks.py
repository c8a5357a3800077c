"""What is wrong with a spec, before anything runs: every problem found, against the columns each step leaves.

A check is a rule of the table ``RULES``: what it looks at in a spec, when that is wrong, and what it says. Rules know the columns that are there
(``there``) and the names made so far (``made``); they say nothing about the order in which steps are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from duebook.functions.expression import names
from duebook.functions.predicates import SpecError
from duebook.schema import canonical

CONDITION_OPS = {"==", "!=", ">", ">=", "<", "<=", "in", "contains", "bucket_worse_than", "bucket_better_than", "bucket_stable"}
HAVING_OPS = {"==", "!=", ">", ">=", "<", "<="}
FUNCTIONS = {"count", "sum", "nunique", "mean", "min", "max"}


def _as_list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def _lower(x) -> str:
    return (x or "").lower()


class Scope(NamedTuple):
    """The columns a part of a spec can use, and the names that the parts before it have made."""

    there: tuple[str, ...]
    made: tuple[str, ...] = ()

    def lacks(self, name: Any) -> bool:
        return not isinstance(name, str) or not name or (name not in self.there and canonical(name) not in self.there)


class Rule(NamedTuple):
    """``find`` gives what is wrong in a part of a spec; ``says`` words it."""

    find: Callable[[Any, Scope], Iterable[Any]]
    says: str


def _unknown(*keys: str) -> Rule:
    return Rule(lambda part, scope: [c for k in keys for c in _as_list(part.get(k)) if scope.lacks(c)], "unknown column {!r}")


def _needed(key: str, says: str) -> Rule:
    return Rule(lambda part, _: [] if _as_list(part.get(key)) else [key], says)


def _one_of(key: str, known: set[str], says: str, default: str | None = None, fold: bool = False) -> Rule:
    value = lambda part: _lower(part.get(key)) if fold else part.get(key) or default
    return Rule(lambda part, _: [value(part)] if value(part) not in known else [], says)


def _compared(part: dict, scope: Scope) -> list:
    """Columns that a condition's value names, as ``{"col": name}`` or by a comparison of buckets."""
    value = part.get("value")
    named = [value.get("col")] if isinstance(value, dict) else [value] if str(part.get("op")).startswith("bucket_") and value is not None else []
    return [c for c in named if scope.lacks(c)]


def _undefined(part: dict, scope: Scope) -> list:
    try:
        return sorted(names(part.get("expr") or "") - set(scope.made))
    except SpecError:
        return []


def _unreadable(part: dict, _: Scope) -> list:
    try:
        names(part.get("expr") or "")
        return []
    except SpecError as e:
        return [e]


CONDITION = (
    Rule(lambda part, scope: [part.get("column")] if scope.lacks(part.get("column")) else [], "unknown column {!r}"),
    _one_of("op", CONDITION_OPS, "unknown op {!r}"),
    Rule(_compared, "unknown column {!r}"),
)
EXPRESSION = (Rule(_undefined, "undefined name {!r}"), Rule(_unreadable, "{}"))
COUNTED = (Rule(lambda part, scope: [part.get("column")] if _lower(part.get("func")) != "count" and scope.lacks(part.get("column")) else [], "unknown column {!r}"),)
NAMED = (Rule(lambda part, _: [] if part.get("alias") else [part], "an aggregation has no alias"),)

#: The rules by the kind of part they are for.
RULES: dict[str, tuple[Rule, ...]] = {
    "condition": CONDITION,
    "filter": (_unknown("sort_by", "display_columns"),),
    "grouping": (_needed("group_by", "group_by is missing"), _unknown("group_by")),
    "count": (*NAMED, ),
    "sum": (*NAMED, Rule(lambda part, scope: [part.get("column")] if scope.lacks(part.get("column")) else [], "unknown column {!r}")),
    "metric": EXPRESSION,
    "having": (
        Rule(lambda part, scope: [part.get("alias")] if part.get("alias") not in scope.made else [], "having: undefined alias {!r}"),
        _one_of("op", HAVING_OPS, "having: unknown op {!r}", ">="),
    ),
    "aggregations": (_needed("aggregations", "aggregations are missing"),),
    "aggregation": (_one_of("func", FUNCTIONS, "unknown function {!r}", fold=True), *NAMED, *COUNTED),
    "derive": (*EXPRESSION, _needed("column", "derive has no column")),
    "sort": (Rule(lambda part, scope: [part.get("by")] if scope.lacks(part.get("by")) else [], "unknown column {!r}"),),
    "limit": (),
}


def _broken(kind: str, part: Any, scope: Scope) -> list[str]:
    return [rule.says.format(x) for rule in RULES[kind] for x in rule.find(part, scope)]


def metrics_of(spec: dict) -> list[dict]:
    """The metrics list, or the older single metric as a list."""
    if spec.get("metrics"):
        return spec["metrics"]
    return [{"expr": spec["metric"], "label": spec.get("metric_label") or "Metric"}] if spec.get("metric") else []


Part = tuple[str, Any, Scope]


def _conditions(found: list | None, scope: Scope) -> Iterator[Part]:
    return (("condition", c, scope) for c in found or [])


def _filter_parts(spec: dict, scope: Scope) -> Iterator[Part]:
    yield from _conditions(spec.get("conditions"), scope)
    yield "filter", spec, scope


def _aggregation_parts(spec: dict, scope: Scope) -> Iterator[Part]:
    yield "grouping", spec, scope
    for c in spec.get("counts") or []:
        yield "count", c, scope
        if c.get("column") != "__total__":
            yield "condition", {**c, "op": c.get("op") or "=="}, scope
    for s in spec.get("sums") or []:
        yield "sum", s, scope
    made = [x.get("alias") for x in [*(spec.get("counts") or []), *(spec.get("sums") or [])]]
    for m in metrics_of(spec):
        yield "metric", m, Scope(scope.there, tuple(made))
        made.append(m.get("label"))
    for h in spec.get("having") or []:
        yield "having", h, Scope(scope.there, tuple(made))


def _group_parts(step: dict, scope: Scope) -> Iterator[Part]:
    yield "grouping", step, scope
    yield "aggregations", step, scope
    for a in step.get("aggregations") or []:
        yield "aggregation", a, scope
        yield from _conditions(a.get("where"), scope)


def _after_grouping(step: dict, scope: Scope) -> tuple[str, ...]:
    keys = [c if c in scope.there else canonical(c) for c in _as_list(step.get("group_by")) if isinstance(c, str)]
    return (*keys, *(a.get("alias") for a in step.get("aggregations") or []))


def _same(step: dict, scope: Scope) -> tuple[str, ...]:
    return scope.there


#: By operation of a plan: the parts that rules look at, and the columns that the step leaves.
STEPS: dict[str, tuple[Callable[[dict, Scope], Iterable[Part]], Callable[[dict, Scope], tuple[str, ...]]]] = {
    "group_aggregate": (_group_parts, _after_grouping),
    "filter": (lambda step, scope: _conditions(step.get("conditions"), scope), _same),
    "derive": (lambda step, scope: [("derive", step, Scope(scope.there, scope.there))], lambda step, scope: (*scope.there, step.get("column"))),
    "sort": (lambda step, scope: [("sort", step, scope)], _same),
    "limit": (lambda step, scope: [("limit", step, scope)], _same),
}


def filter_problems(columns, spec: dict) -> list[str]:
    return [p for part in _filter_parts(spec, Scope(tuple(columns))) for p in _broken(*part)]


def aggregation_problems(columns, spec: dict) -> list[str]:
    return [p for part in _aggregation_parts(spec, Scope(tuple(columns))) for p in _broken(*part)]


def plan_problems(columns, plan: list[dict]) -> list[str]:
    found, scope = [] if plan else ["the plan is empty"], Scope(tuple(columns))
    for k, step in enumerate(plan or [], 1):
        op = _lower(step.get("op"))
        if op not in STEPS:
            found.append(f"step {k} ({op}): unknown operation {op!r}")
            continue
        parts, left = STEPS[op]
        found += [f"step {k} ({op}): {p}" for part in parts(step, scope) for p in _broken(*part)]
        scope = Scope(left(step, scope))
    return found


#: Problems of a spec by its kind.
KINDS = {"filter": filter_problems, "aggregation": aggregation_problems, "plan": plan_problems}


def problems(spark: SparkSession, df: DataFrame, specs: dict[str, tuple[str, Any]]) -> DataFrame:
    """(spec, place, problem) for everything wrong with the named specs (kind, spec) over the columns of ``df``; no rows if all can run."""
    rows = [(name, k, text) for name, (kind, spec) in specs.items() for k, text in enumerate(KINDS[kind](df.columns, spec), 1)]
    return spark.createDataFrame(rows, "spec string, place int, problem string")


def refuse(problems: list[str]) -> None:
    if problems:
        raise SpecError("; ".join(problems))
