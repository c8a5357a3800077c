"""The report's sections as tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from duebook.operators import alerts, branches, kpis, migration, scorecard


#: The columns that the sections read of either snapshot.
PREV = ("loan_no", "curr_bucket", "arrears_emi", "strike", "demand", "collection", "soh", "total_cum_coll", "cum_coll_ie", "cum_due_inst", "cum_due_exp")
CURR = (*PREV, "prev_bucket", "mnt_name", "unit", "pos", "non_starter", "colending", "closing_arrears", "arr_inst", "arr_exp", "arr_bc", "loan_amount", "ag_date")


def sections(curr: DataFrame, prev: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """Health, flags, migration, executives and branches. ``curr`` has prev_bucket; every section reads it, so give a written table, of ``CURR`` and ``PREV`` at least."""
    card = scorecard.scorecard(curr)
    return {
        "portfolio_health": kpis.portfolio_health(curr, prev), "risk_flags": alerts.risk_flags(alerts.summary(curr, as_of)),
        "migration_matrix": migration.matrix(curr, prev), "migration_kpis": migration.migration_kpis(curr, prev),
        "executives_top": scorecard.top(card), "executives_bottom": scorecard.bottom(card),
        "branches_top": branches.top_branches(curr), "branches_bottom": branches.bottom_branches(curr),
    }


#: The column that names a section's rows, and the text that goes with a row.
NAMES = {
    "portfolio_health": ("kpi", "light"), "risk_flags": ("alert_id", "severity"), "migration_matrix": ("prev_bucket", None), "migration_kpis": (None, None),
    "executives_top": ("executive", "tier"), "executives_bottom": ("executive", "tier"), "branches_top": ("branch", None), "branches_bottom": ("branch", None),
}


def figures(tables: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, item, label, measure, value): a row per figure that is there."""
    parts = []
    for section, table in tables.items():
        item, label = NAMES[section]
        measures = [f.name for f in table.schema if isinstance(f.dataType, NumericType)]
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        text = lambda c: F.col(c) if c else F.lit(None).cast("string")
        parts.append(table.select(F.lit(section).alias("section"), text(item).alias("item"), text(label).alias("label"), F.inline(pairs)).where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def write(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder per section."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(kind).option("header", True).save(f"{folder}/{name}")
