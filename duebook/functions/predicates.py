"""Conditions ``{column, op, value}`` as columns, and the named segments.

A condition that cannot be applied raises: an unknown column, an op the column's type does not have, a value that is no number or date.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import and_, eq, ge, gt, le, lt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from duebook.functions.columns import number, score
from duebook.schema import canonical

COMPARE = {">": gt, ">=": ge, "<": lt, "<=": le, "==": eq}
MOVES = {"bucket_worse_than": gt, "bucket_better_than": lt, "bucket_stable": eq}


class SpecError(ValueError):
    """A spec that cannot run; the message lists every problem found."""


def resolve(columns, name: str) -> str:
    """The column of that name, given as it is or as a source header."""
    if name in columns:
        return name
    if canonical(name) in columns:
        return canonical(name)
    raise SpecError(f"unknown column {name!r}")


def kind(df: DataFrame, column: str) -> str:
    t = df.schema[column].dataType
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return "date"
    return "number" if isinstance(t, NumericType) else "text"


def text_key(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def _value(df: DataFrame, value, kind_: str):
    """A literal of the column's kind, or another column given as ``{"col": name}``."""
    if isinstance(value, dict):
        other = F.col(resolve(df.columns, value["col"]))
        return text_key(other) if kind_ == "text" else other
    try:
        if kind_ == "date":
            if not isinstance(value, (date, datetime)):
                value = datetime.fromisoformat(str(value))
            return F.lit(value).cast("timestamp")
        return F.lit(float(value)) if kind_ == "number" else F.lit(str(value).strip().upper())
    except ValueError:
        raise SpecError(f"{value!r} is no {kind_}") from None


def condition(df: DataFrame, spec: dict) -> Column:
    """The predicate of one condition; missing values satisfy ``!=`` and nothing else."""
    name, op, value = resolve(df.columns, spec["column"]), spec["op"], spec.get("value")
    c, k = F.col(name), kind(df, name)
    if op in MOVES:
        other = resolve(df.columns, value["col"] if isinstance(value, dict) else value)
        return F.coalesce(MOVES[op](score(c), score(F.col(other))), F.lit(False))
    if k == "text" and op in COMPARE and op != "==" and spec.get("numeric"):
        c, k = number(name), "number"
    left = {"date": c.cast("timestamp"), "number": c, "text": text_key(c)}[k]
    if op == "contains" and k == "text":
        return c.rlike("(?i)" + str(value))
    if op == "in":
        return left.isin([_value(df, v, k) for v in (value if isinstance(value, (list, tuple, set)) else [value])])
    if op == "!=":
        return ~left.eqNullSafe(_value(df, value, k))
    if op in COMPARE and (k != "text" or op == "=="):
        return COMPARE[op](left, _value(df, value, k))
    raise SpecError(f"op {op!r} does not apply to {name} ({k})")


def conjunction(df: DataFrame, specs: list[dict]) -> Column:
    """All conditions; true for none."""
    return reduce(and_, [condition(df, s) for s in specs], F.lit(True))


def sliced(df: DataFrame, region: str = "All", branch: str = "All", status: str = "All") -> DataFrame:
    """Rows of a region, branch and loan status, compared exactly; All filters nothing."""
    for column, value in (("region_name", region), ("unit", branch), ("loan_status", status)):
        if value != "All":
            df = df.where(F.col(column) == value)
    return df


def slicer_values(df: DataFrame, column: str, region: str = "All") -> DataFrame:
    """The values to choose from, sorted; branches depend on the region."""
    return sliced(df, region=region).where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def is_yes(column: str) -> Column:
    return text_key(F.col(column)) == "Y"


def segments(as_of: datetime) -> dict[str, Column]:
    """The named segments, as predicates over a snapshot."""
    arrears, collected, demand, b = F.col("arrears_emi"), F.col("collection"), F.col("demand"), F.col("curr_bucket")
    month = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    status = text_key(F.col("loan_status"))
    inst, exp = (F.coalesce(number(c), F.lit(0.0)) for c in ("arr_inst", "arr_exp"))
    closing = F.coalesce(number("closing_arrears"), F.lit(0.0))
    return {
        "matured": status == "MAT", "running": status == "RUN", "seized": status == "S&S",
        "no_collection_3m": is_yes("no_coll_3m"), "three_emi_arrears": arrears >= 3,
        "overdue": b.isin("SMA-1", "SMA-2", "NPA"), "at_risk": b.isin("SMA-2", "NPA"), "regular": b == "STD", "delinquent": arrears > 0,
        "advances_since": F.col("ag_date") >= F.add_months(F.lit(as_of.date()), -12).cast("timestamp"),
        "non_starter": is_yes("non_starter"), "nach_inactive": text_key(F.col("nach_status")) == "N", "legal": is_yes("lgl_flag"),
        "colending": is_yes("colending"), "colending_at_risk": is_yes("colending") & (arrears > 0),
        "deceased": text_key(F.col("customer_status")) == "DEAD", "strike_yes": is_yes("strike"), "strike_no": text_key(F.col("strike")) == "N",
        "insurance_driven": (inst <= 0) & (exp > 5000) & (arrears > 0), "easy_settlement": (closing > 0) & (closing < 1000),
        "no_collection": (collected == 0) & (demand > 0), "short_collection": (collected > 0) & (collected < demand),
        "under_collected": (collected < demand) & (demand > 0), "hard_bucket": arrears >= 6,
        "paid_this_month": F.col("last_receipt_date") >= F.lit(month).cast("timestamp"),
    }
