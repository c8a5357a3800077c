"""Every query by name, with the same query in SQL over the raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions import columns as c
from duebook.functions import predicates as p
from duebook.operators import alerts, branches, kpis, migration, priority, report, scorecard
from duebook.plans import checks
from duebook.plans import queries as q
from duebook.schema import HEADERS, MANDATORY, canonical
from duebook.sources import ingest, shared
from duebook.sources.loanbook import AS_OF, CURR_SQL, PREV_SQL, loan_book

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOTH = f"{CURR_SQL},{PREV_SQL},\ncp AS (SELECT c.*, p.curr_bucket AS prev_bucket, p.loan_no IS NOT NULL AS in_prev FROM curr c LEFT JOIN prev p USING (loan_no))"


def _score(x: str) -> str:
    return f"(CASE {x} WHEN 'STD' THEN 0 WHEN '1-30 DPD' THEN 1 WHEN 'SMA-1' THEN 2 WHEN 'SMA-2' THEN 3 WHEN 'NPA' THEN 4 END)"


def _r(x: str, places: int = 2) -> str:
    return f"(round_even(({x}) * {10**places}, 0) / {10**places})"


def _pct(a: str, b: str, places: int = 2) -> str:
    return f"COALESCE(CASE WHEN {b} <> 0 THEN {_r(f'CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100', places)} END, 0)"


def query(sql: str | None = None, over: str = "curr") -> Callable:
    """Register a function of the current snapshot, or of both, the current one with prev_bucket unless ``apart``; SQL reads curr, prev and cp."""

    def add(f: Callable) -> Callable:
        name = f.__name__
        if over == "curr":
            QUERIES[name] = lambda spark, d: f(loan_book(spark, d, "curr"))
        elif over == "apart":
            QUERIES[name] = lambda spark, d: f(loan_book(spark, d, "curr"), loan_book(spark, d, "prev"))
        else:
            QUERIES[name] = lambda spark, d: f(*_pair(spark, d))
        if sql:
            ctes = CURR_SQL if over == "curr" else BOTH
            SQL[name] = f"WITH {ctes}{sql}" if sql.lstrip().startswith(",") else f"WITH {ctes}\n{sql}"
        return f

    return add


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prev = loan_book(spark, d, "prev")
    return c.with_prev_bucket(loan_book(spark, d, "curr"), prev), prev


# buckets and exposure
@query("SELECT loan_no, arrears_emi, curr_bucket, curr_score, CAST(soh AS DOUBLE) AS soh FROM curr")
def bucket_assign(curr):
    raw = curr.drop("curr_bucket", "curr_score", "soh")
    return c.with_soh(c.with_buckets(raw)).select("loan_no", "arrears_emi", "curr_bucket", "curr_score", F.col("soh").cast("double").alias("soh"))


@query("SELECT loan_no, curr_bucket, prev_bucket FROM cp", "both")
def attach_prev_bucket(curr, prev):
    return curr.select("loan_no", "curr_bucket", "prev_bucket")


_BUCKETS = ", b(bucket, place) AS (VALUES ('STD', 0), ('1-30 DPD', 1), ('SMA-1', 2), ('SMA-2', 3), ('NPA', 4), ('NA', 5))\n"


@query(_BUCKETS + "SELECT bucket, place, CAST(COALESCE(SUM(soh), 0) AS DOUBLE) AS soh FROM b LEFT JOIN curr ON curr_bucket = bucket GROUP BY 1, 2")
def exposure_by_bucket(curr):
    return branches.exposure_by_bucket(curr)


@query(_BUCKETS + "SELECT bucket, place, COUNT(DISTINCT loan_no) AS loans FROM b LEFT JOIN curr ON curr_bucket = bucket GROUP BY 1, 2")
def loans_by_bucket(curr):
    return branches.loans_by_bucket(curr)


@query(_BUCKETS + "SELECT bucket, place, CAST(COALESCE(SUM(closing_arrears), 0) AS DOUBLE) AS closing_arrears FROM b LEFT JOIN curr ON curr_bucket = bucket GROUP BY 1, 2")
def arrears_by_bucket(curr):
    return branches.arrears_by_bucket(curr)


@query(f"SELECT loan_no, CASE WHEN loan_amount <> 0 THEN {_r('(CAST(COALESCE(arr_inst, 0) AS DOUBLE) + CAST(COALESCE(arr_exp, 0) AS DOUBLE) + CAST(COALESCE(arr_bc, 0) AS DOUBLE)) / CAST(loan_amount AS DOUBLE) * 100', 1)} END AS arrears_ratio_pct FROM curr")
def arrears_ratio(curr):
    return curr.select("loan_no", c.arrears_ratio_pct().alias("arrears_ratio_pct"))


@query("""SELECT loan_no, CONCAT(mnt_name, ' (', unit, ')') AS executive, CASE WHEN soh >= 10000000 THEN printf('₹%.2fCr', CAST(soh AS DOUBLE) / 1e7)
  WHEN soh >= 100000 THEN printf('₹%.2fL', CAST(soh AS DOUBLE) / 1e5) ELSE CONCAT('₹', format('{:,}', CAST(round_even(CAST(soh AS DOUBLE), 0) AS BIGINT))) END AS soh_text FROM curr""")
def money_labels(curr):
    return curr.select("loan_no", c.pair_label("mnt_name", "unit").alias("executive"), c.money_text(F.col("soh")).alias("soh_text"))


# filters
def _ids(df, *more):
    return df.select("loan_no", *more)


@query("SELECT loan_no, arrears_emi, CAST(pos AS DOUBLE) AS pos FROM curr WHERE curr_bucket = 'NPA'")
def filter_npa_sorted(curr):
    rows = q.run_filter(curr, {"conditions": [{"column": "curr_bucket", "op": "==", "value": "npa"}], "sort_by": "Arrears / EMI", "display_columns": ["loan_no", "arrears_emi", "pos"]})
    return rows.withColumn("pos", F.col("pos").cast("double"))


@query("SELECT loan_no, unit, due_day FROM curr WHERE unit IN ('NATION_3', 'NATION_7', 'NATION_20') AND due_day IN (5, 15)")
def filter_in(curr):

    spec = {"conditions": [{"column": "unit", "op": "in", "value": ["nation_3", "Nation_7 ", "NATION_20"]}, {"column": "due_day", "op": "in", "value": [5, 15]}]}
    return _ids(q.filter_rows(curr, spec), "unit", "due_day")


@query("SELECT loan_no, mnt_name FROM curr WHERE regexp_matches(mnt_name, '(?i)exec_[13]$')")
def filter_contains(curr):
    return _ids(q.filter_rows(curr, {"conditions": [{"column": "MNT NAME", "op": "contains", "value": "exec_[13]$"}]}), "mnt_name")


@query("SELECT loan_no, strike FROM curr WHERE strike IS DISTINCT FROM 'Y' AND arrears_emi IS DISTINCT FROM 0")
def filter_not_equal_nulls(curr):
    return _ids(q.filter_rows(curr, {"conditions": [{"column": "strike", "op": "!=", "value": "y"}, {"column": "arrears_emi", "op": "!=", "value": 0}]}), "strike")


@query(f"SELECT loan_no, prev_bucket, curr_bucket FROM cp WHERE {_score('curr_bucket')} > {_score('prev_bucket')}", "both")
def filter_rolled_forward(curr, prev):
    return _ids(q.filter_rows(curr, {"conditions": [{"column": "curr_bucket", "op": "bucket_worse_than", "value": "prev_bucket"}]}), "prev_bucket", "curr_bucket")


@query(f"SELECT loan_no, prev_bucket, curr_bucket FROM cp WHERE {_score('curr_bucket')} < {_score('prev_bucket')}", "both")
def filter_rolled_backward(curr, prev):
    return _ids(q.filter_rows(curr, {"conditions": [{"column": "curr_bucket", "op": "bucket_better_than", "value": "prev_bucket"}]}), "prev_bucket", "curr_bucket")


@query(f"SELECT loan_no FROM cp WHERE {_score('curr_bucket')} = {_score('prev_bucket')}", "both")
def filter_stable(curr, prev):
    return _ids(q.filter_rows(curr, {"conditions": [{"column": "curr_bucket", "op": "bucket_stable", "value": "prev_bucket"}]}))


@query("SELECT loan_no, CAST(ag_date AS DATE) AS ag_date FROM curr WHERE ag_date >= TIMESTAMP '2000-11-01 00:00:00' AND ag_date < TIMESTAMP '2001-06-01 00:00:00' AND loan_status <> 'MAT'")
def filter_dates(curr):
    spec = {"conditions": [{"column": "Ag_Date", "op": ">=", "value": "2000-11-01"}, {"column": "Ag_Date", "op": "<", "value": "2001-06-01"}, {"column": "loan_status", "op": "!=", "value": "MAT"}], "sort_by": "ag_date", "display_columns": ["loan_no", "ag_date"]}
    return q.run_filter(curr, spec)


@query("SELECT loan_no, CAST(collection AS DOUBLE) AS collection, CAST(demand AS DOUBLE) AS demand FROM curr WHERE collection > 0 AND collection < demand")
def short_collection(curr):
    spec = {"conditions": [{"column": "collection", "op": ">", "value": 0}, {"column": "collection", "op": "<", "value": {"col": "demand"}}]}
    return q.filter_rows(curr, spec).select("loan_no", F.col("collection").cast("double").alias("collection"), F.col("demand").cast("double").alias("demand"))


_SEGMENTS = {
    "matured": "loan_status = 'MAT'", "running": "loan_status = 'RUN'", "seized": "loan_status = 'S&S'", "no_collection_3m": "no_coll_3m = 'Y'",
    "three_emi_arrears": "arrears_emi >= 3", "overdue": "curr_bucket IN ('SMA-1', 'SMA-2', 'NPA')", "at_risk": "curr_bucket IN ('SMA-2', 'NPA')",
    "regular": "curr_bucket = 'STD'", "delinquent": "arrears_emi > 0", "advances_since": "ag_date >= TIMESTAMP '2000-11-01 00:00:00'",
    "non_starter": "non_starter = 'Y'", "nach_inactive": "nach_status = 'N'", "legal": "lgl_flag = 'Y'", "colending": "colending = 'Y'",
    "colending_at_risk": "colending = 'Y' AND arrears_emi > 0", "deceased": "customer_status = 'Dead'", "strike_yes": "strike = 'Y'", "strike_no": "strike = 'N'",
    "insurance_driven": "COALESCE(arr_inst, 0) <= 0 AND arr_exp > 5000 AND arrears_emi > 0", "easy_settlement": "closing_arrears > 0 AND closing_arrears < 1000",
    "no_collection": "collection = 0 AND demand > 0", "short_collection": "collection > 0 AND collection < demand", "under_collected": "collection < demand AND demand > 0",
    "hard_bucket": "arrears_emi >= 6", "paid_this_month": "last_receipt_date >= TIMESTAMP '2001-11-01 00:00:00'",
}


@query("\nUNION ALL ".join(f"SELECT '{k}' AS segment, COUNT(*) AS loans FROM curr WHERE {v}" for k, v in _SEGMENTS.items()))
def segment_counts(curr):
    found = curr.agg(*[F.count_if(v).alias(k) for k, v in p.segments(AS_OF).items()])
    return found.select(F.inline(F.array(*[F.struct(F.lit(k).alias("segment"), F.col(k).alias("loans")) for k in found.columns])))


@query("SELECT loan_no, unit FROM curr WHERE region_name = 'ASIA' AND loan_status = 'RUN'")
def slicer(curr):
    return _ids(p.sliced(curr, region="ASIA", status="RUN"), "unit")


@query("SELECT DISTINCT unit FROM curr WHERE region_name = 'EUROPE'")
def slicer_values(curr):
    return p.slicer_values(curr, "unit", region="EUROPE")


# key figures
def _kpi_sql(table: str) -> str:
    return f"""SELECT CAST(COALESCE(SUM(demand), 0) AS DOUBLE) AS month_demand, CAST(COALESCE(SUM(collection), 0) AS DOUBLE) AS total_collection,
  {_pct('SUM(collection)', 'SUM(demand)')} AS collection_pct, {_pct("COUNT(*) FILTER (strike = 'Y')", "COUNT(*) FILTER (strike IN ('Y', 'N'))")} AS strike_pct,
  {_pct("COUNT(DISTINCT loan_no) FILTER (curr_bucket = 'NPA')", 'COUNT(DISTINCT loan_no)')} AS npa_pct,
  {_pct('COUNT(DISTINCT loan_no) FILTER (arrears_emi >= 6)', 'COUNT(DISTINCT loan_no)')} AS hard_bucket_pct, CAST(COUNT(DISTINCT loan_no) AS DOUBLE) AS count,
  CAST(COALESCE(SUM(soh), 0) AS DOUBLE) AS soh, {_pct('SUM(total_cum_coll)', '(CAST(SUM(cum_due_inst) AS DOUBLE) + CAST(SUM(cum_due_exp) AS DOUBLE))')} AS lcc_pct,
  {_pct('SUM(total_cum_coll)', 'SUM(cum_coll_ie)')} AS cmd_pct FROM {table}"""


_KPIS = f""", kc AS ({_kpi_sql('curr')}), kp AS ({_kpi_sql('prev')}),
k AS ({' UNION ALL '.join(f"SELECT '{k}' AS kpi, kc.{k} AS value, kp.{k} AS prev_value FROM kc, kp" for k in kpis.KPIS)}),
m AS (SELECT *, COALESCE(CASE WHEN prev_value <> 0 THEN {_r('(value - prev_value) / abs(prev_value) * 100')} END, 0) AS mom_pct FROM k)
"""


@query(_KPIS + "SELECT * FROM m", "both")
def kpi_mom(curr, prev):
    return kpis.kpi_table(curr, prev)


@query(_KPIS + """SELECT *, CASE kpi WHEN 'collection_pct' THEN CASE WHEN value >= 90 THEN 'green' WHEN value >= 75 THEN 'amber' ELSE 'red' END
  WHEN 'npa_pct' THEN CASE WHEN value <= 3 THEN 'green' WHEN value <= 7 THEN 'amber' ELSE 'red' END
  WHEN 'hard_bucket_pct' THEN CASE WHEN value <= 10 THEN 'green' WHEN value <= 20 THEN 'amber' ELSE 'red' END
  WHEN 'strike_pct' THEN CASE WHEN value >= 80 THEN 'green' WHEN value >= 60 THEN 'amber' ELSE 'red' END END AS light FROM m""", "both")
def portfolio_health(curr, prev):
    return kpis.portfolio_health(curr, prev)


@query(f"""SELECT COUNT(DISTINCT loan_no) AS accounts, CAST(COALESCE(SUM(soh), 0) AS DOUBLE) AS soh, CAST(COALESCE(SUM(demand), 0) AS DOUBLE) AS demand,
  CAST(COALESCE(SUM(collection), 0) AS DOUBLE) AS collection, {_pct('SUM(collection)', 'SUM(demand)')} AS collection_pct, {_r('AVG(arrears_emi)')} AS avg_arrears
  FROM curr WHERE curr_bucket IN ('SMA-2', 'NPA')""")
def result_kpis(curr):
    return kpis.result_kpis(q.filter_rows(curr, {"conditions": [{"column": "curr_bucket", "op": "in", "value": ["SMA-2", "NPA"]}]}))


# alerts
_Z = {k: f"COALESCE(CAST({k} AS DOUBLE), 0)" for k in ("arrears_emi", "closing_arrears", "arr_inst", "arr_exp", "arr_bc", "loan_amount")}
_RULES = {
    "non_starter": "non_starter = 'Y'", "insurance": f"{_Z['arr_inst']} <= 0 AND {_Z['arr_exp']} > 5000 AND {_Z['arrears_emi']} > 0",
    "easy_settlement": "closing_arrears > 0 AND closing_arrears < 1000", "recent_advances": "ag_date >= TIMESTAMP '2000-11-01 00:00:00' AND arrears_emi > 0",
    "colending": "colending = 'Y' AND arrears_emi > 0", "high_arrears": f"loan_amount > 0 AND {_Z['arr_inst']} + {_Z['arr_exp']} + {_Z['arr_bc']} > 0.5 * CAST(loan_amount AS DOUBLE)",
}
_ALERTS = f""", d(alert_id, severity, place) AS (VALUES {', '.join(f"('{a}', '{s}', {k})" for k, (a, s) in enumerate(alerts.ALERTS, 1))}),
h AS ({' UNION ALL '.join(f"SELECT '{k}' AS alert_id, * FROM curr WHERE {v}" for k, v in _RULES.items())}),
s AS (SELECT alert_id, severity, place, COUNT(DISTINCT loan_no) AS count, CAST(COALESCE(SUM(soh), 0) AS DOUBLE) AS soh,
  CAST(COALESCE(SUM(closing_arrears), 0) AS DOUBLE) AS closing_arrears FROM d LEFT JOIN h USING (alert_id) GROUP BY ALL)
"""


@query(_ALERTS + "SELECT * FROM s")
def alert_summary(curr):
    return alerts.summary(curr, AS_OF)


@query(_ALERTS + f"""SELECT alert_id, loan_no, CAST(ag_date AS DATE) AS ag_date, CAST(last_receipt_date AS DATE) AS last_receipt_date, curr_bucket, arrears_emi,
  CASE WHEN alert_id = 'high_arrears' THEN {_r(f"({_Z['arr_inst']} + {_Z['arr_exp']} + {_Z['arr_bc']}) / CAST(loan_amount AS DOUBLE) * 100", 1)} END AS arrears_ratio_pct FROM h""")
def alert_drilldown(curr):
    return alerts.drilldown(curr, AS_OF).select("alert_id", "loan_no", "ag_date", "last_receipt_date", "curr_bucket", "arrears_emi", "arrears_ratio_pct")


@query(_ALERTS + "SELECT severity, COUNT(*) FILTER (count > 0) AS active FROM s GROUP BY severity")
def alert_by_severity(curr):
    return alerts.by_severity(alerts.summary(curr, AS_OF))


@query(_ALERTS + "SELECT * FROM s WHERE count > 0 ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, count DESC, place LIMIT 3")
def risk_flags_top3(curr):
    return alerts.risk_flags(alerts.summary(curr, AS_OF))


@query(_ALERTS + f"SELECT loan_no, {_r(f'''({_Z['arr_inst']} + {_Z['arr_exp']} + {_Z['arr_bc']}) / CAST(loan_amount AS DOUBLE) * 100''', 1)} AS arrears_ratio_pct FROM h WHERE alert_id = 'high_arrears'")
def high_arrears_ratio(curr):
    return alerts.drilldown(curr, AS_OF, alert="high_arrears").select("loan_no", "arrears_ratio_pct")


# scorecard and branches
_CARD = f""", e AS (SELECT mnt_name, unit, COUNT(DISTINCT loan_no) AS accounts, COUNT(*) FILTER (strike = 'Y') AS yes, COUNT(*) FILTER (strike IN ('Y', 'N')) AS yn,
  SUM(demand) AS demand, SUM(collection) AS collected, SUM(soh) AS soh, SUM(pos) AS pos, COUNT(DISTINCT loan_no) FILTER (curr_bucket = 'NPA') AS npa,
  COUNT(DISTINCT loan_no) FILTER (curr_bucket = 'SMA-2') AS sma2, COUNT(*) FILTER ({_score('curr_bucket')} IS NOT NULL AND {_score('prev_bucket')} IS NOT NULL) AS moved,
  COUNT(*) FILTER ({_score('curr_bucket')} > {_score('prev_bucket')}) AS worse, COUNT(*) FILTER ({_score('curr_bucket')} < {_score('prev_bucket')}) AS better
  FROM cp GROUP BY mnt_name, unit HAVING COUNT(DISTINCT loan_no) >= 5),
f AS (SELECT CONCAT(mnt_name, ' (', unit, ')') AS executive, mnt_name, unit, accounts, {_pct('yes', 'yn', 1)} AS strike_pct, {_pct('collected', 'demand', 1)} AS collection_pct,
  {_pct('worse', 'moved', 1)} AS roll_fwd_pct, {_pct('better', 'moved', 1)} AS roll_bwd_pct, {_pct('npa', 'accounts', 1)} AS npa_pct, npa, sma2,
  {_r('CAST(COALESCE(pos, 0) AS DOUBLE) / 100000')} AS pos_lakh, {_r('CAST(COALESCE(soh, 0) AS DOUBLE) / 100000')} AS soh_lakh,
  {_r('CAST(COALESCE(demand, 0) AS DOUBLE) / 100000')} AS demand_lakh, {_r('CAST(COALESCE(collected, 0) AS DOUBLE) / 100000')} AS collected_lakh FROM e),
qs AS (SELECT quantile_cont(collection_pct, 0.25) AS q25, quantile_cont(collection_pct, 0.75) AS q75 FROM f),
card AS (SELECT f.*, CASE WHEN collection_pct >= q75 THEN 'top' WHEN collection_pct <= q25 THEN 'bottom' ELSE 'mid' END AS tier FROM f, qs)
"""


@query(_CARD + "SELECT * FROM card", "both")
def executive_scorecard(curr, prev):
    return scorecard.scorecard(curr)


@query(_CARD + """SELECT executive, CASE WHEN collection_pct > 100 THEN 'green' WHEN collection_pct >= 90 THEN 'amber' ELSE 'red' END AS collection_light,
  CASE WHEN roll_fwd_pct >= 20 THEN 'red' WHEN roll_fwd_pct >= 10 THEN 'amber' ELSE 'green' END AS roll_fwd_light,
  CASE WHEN roll_bwd_pct >= 10 THEN 'green' WHEN roll_bwd_pct >= 5 THEN 'amber' ELSE 'grey' END AS roll_bwd_light FROM card""", "both")
def scorecard_lights(curr, prev):
    return scorecard.banded(scorecard.scorecard(curr)).select("executive", "collection_light", "roll_fwd_light", "roll_bwd_light")


@query(_CARD + f"""SELECT COUNT(*) AS executives, COUNT(*) FILTER (tier = 'top') AS top, COUNT(*) FILTER (tier = 'mid') AS mid, COUNT(*) FILTER (tier = 'bottom') AS bottom,
  {_r('SUM(CAST(collection_pct AS DECIMAL(12,1))) / COUNT(*)', 1)} AS avg_collection_pct, {_r('SUM(CAST(strike_pct AS DECIMAL(12,1))) / COUNT(*)', 1)} AS avg_strike_pct,
  {_r('SUM(CAST(npa_pct AS DECIMAL(12,1))) / COUNT(*)', 1)} AS avg_npa_pct FROM card""", "both")
def scorecard_summary(curr, prev):
    return scorecard.summary(scorecard.scorecard(curr))


@query(_CARD + "SELECT * FROM card WHERE tier = 'top' ORDER BY collection_pct DESC, executive LIMIT 5", "both")
def executive_top5(curr, prev):
    return scorecard.top(scorecard.scorecard(curr))


@query(_CARD + "SELECT * FROM card WHERE tier = 'bottom' ORDER BY collection_pct, executive LIMIT 5", "both")
def executive_bottom5(curr, prev):
    return scorecard.bottom(scorecard.scorecard(curr))


_BRANCH = f""", br AS (SELECT unit AS branch, COUNT(DISTINCT loan_no) AS accounts, {_pct('SUM(collection)', 'SUM(demand)')} AS coll_pct,
  CAST(COALESCE(SUM(collection), 0) AS DOUBLE) AS collection, CAST(COALESCE(SUM(demand), 0) AS DOUBLE) AS demand FROM curr GROUP BY unit)
"""
_SHOWN = f"SELECT branch, accounts, {_r('coll_pct', 1)} AS coll_pct, {_r('collection / 100000')} AS collection_lakh, {_r('demand / 100000')} AS demand_lakh FROM"


@query(_BRANCH + f"{_SHOWN} (SELECT * FROM br ORDER BY coll_pct DESC, branch LIMIT 5)")
def branch_top5(curr):
    return branches.top_branches(curr)


@query(_BRANCH + f"{_SHOWN} (SELECT * FROM br ORDER BY coll_pct, branch LIMIT 5)")
def branch_bottom5(curr):
    return branches.bottom_branches(curr)


@query(_BRANCH + f"SELECT branch, CASE WHEN {_r('coll_pct', 1)} >= 100 THEN 'green' WHEN {_r('coll_pct', 1)} >= 90 THEN 'amber' ELSE 'red' END AS coll_light FROM (SELECT * FROM br ORDER BY coll_pct DESC, branch LIMIT 5)")
def branch_lights(curr):
    return branches.top_branches(curr).select("branch", branches.light(F.col("coll_pct")).alias("coll_light"))


@query(_BRANCH + "SELECT branch, coll_pct FROM br ORDER BY coll_pct DESC, branch LIMIT 12")
def branch_best12(curr):
    return branches.best_branches(curr)


# migration
_MOVES = """, mv AS (SELECT p.curr_bucket AS prev_bucket, c.curr_bucket FROM curr c JOIN prev p USING (loan_no) WHERE c.curr_bucket <> 'NA' AND p.curr_bucket <> 'NA')
"""


@query(_MOVES + """, pb(prev_bucket, place) AS (VALUES ('STD', 0), ('1-30 DPD', 1), ('SMA-1', 2), ('SMA-2', 3), ('NPA', 4))
SELECT prev_bucket, place, COUNT(*) FILTER (curr_bucket = 'STD') AS std, COUNT(*) FILTER (curr_bucket = '1-30 DPD') AS dpd_1_30, COUNT(*) FILTER (curr_bucket = 'SMA-1') AS sma_1,
  COUNT(*) FILTER (curr_bucket = 'SMA-2') AS sma_2, COUNT(*) FILTER (curr_bucket = 'NPA') AS npa FROM pb LEFT JOIN mv USING (prev_bucket) GROUP BY 1, 2""", "apart")
def roll_matrix(curr, prev):
    return migration.matrix(curr, prev)


@query(_MOVES + f"""SELECT COUNT(*) AS matched, {_pct(f"COUNT(*) FILTER ({_score('curr_bucket')} > {_score('prev_bucket')})", 'COUNT(*)')} AS roll_forward_pct,
  {_pct(f"COUNT(*) FILTER ({_score('curr_bucket')} < {_score('prev_bucket')})", 'COUNT(*)')} AS roll_backward_pct,
  {_pct("COUNT(*) FILTER (prev_bucket <> 'NPA' AND curr_bucket = 'NPA')", "COUNT(*) FILTER (prev_bucket <> 'NPA')")} AS npa_formation_pct,
  (SELECT COUNT(*) FROM curr WHERE loan_no NOT IN (SELECT loan_no FROM prev)) AS new_entries, (SELECT COUNT(*) FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr)) AS exits FROM mv""", "apart")
def roll_kpis(curr, prev):
    return migration.migration_kpis(curr, prev)


@query(SQL["roll_kpis"].removeprefix(f"WITH {BOTH}"), "apart")
def roll_kpis_stored(curr, prev):
    """The same from two months of a table that is dealt and sorted by loan number; the earlier one is written twice, the second time whole."""
    spark, name = curr.sparkSession, f"months_{uuid.uuid4().hex}"
    columns = ("loan_no", "curr_bucket")
    ingest.create_months(spark, name, curr.select(*columns), 16, shared.folder(spark, name))
    for df, month in ((prev.limit(0), "2001-10"), (prev, "2001-10"), (curr, "2001-11")):
        ingest.write_month(df.select(*columns), name, month)
    return migration.migration_kpis(ingest.read_month(spark, name, "2001-11"), ingest.read_month(spark, name, "2001-10"))


@query("SELECT loan_no FROM curr WHERE loan_no NOT IN (SELECT loan_no FROM prev)", "apart")
def new_entries(curr, prev):
    return migration.new_entries(curr, prev)


@query("SELECT loan_no FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr)", "apart")
def exits(curr, prev):
    return migration.exits(curr, prev)


@query(_MOVES + f"""SELECT prev_bucket, curr_bucket, COUNT(*) AS n,
  {_r(f"({_score('curr_bucket')} - {_score('prev_bucket')}) * (CAST(COUNT(*) AS DOUBLE) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM mv) * 100)", 4)} AS intensity FROM mv GROUP BY prev_bucket, curr_bucket""", "apart")
def migration_intensity(curr, prev):
    return migration.intensity(curr, prev)


# priorities
_PRIORITY = f""", pr AS (SELECT *, CASE WHEN non_starter = 'Y' THEN 1 WHEN closing_arrears > 0 AND closing_arrears < 1000 THEN 2
  WHEN ag_date >= TIMESTAMP '2000-11-01 00:00:00' AND arrears_emi >= 1 THEN 3 WHEN arr_inst <= 0 AND arr_exp > 5000 AND arrears_emi > 0 THEN 4
  WHEN colending = 'Y' AND arrears_emi > 0 THEN 5 WHEN no_coll_3m = 'Y' THEN 6 WHEN curr_bucket = 'NPA' THEN 7 END AS rank FROM curr),
pl AS (SELECT *, CASE rank {' '.join(f"WHEN {k} THEN 'P{k}: {name}'" for k, name in enumerate(priority.LABELS, 1))} END AS priority FROM pr WHERE rank IS NOT NULL)
"""


@query(_PRIORITY + "SELECT priority, loan_no, CAST(ag_date AS DATE) AS ag_date, curr_bucket, arrears_emi, CAST(pos AS DOUBLE) AS pos, CAST(closing_arrears AS DOUBLE) AS closing_arrears FROM pl")
def priority_list(curr):
    rows = priority.priority_list(curr, AS_OF).select("priority", "loan_no", "ag_date", "curr_bucket", "arrears_emi", "pos", "closing_arrears")
    return rows.withColumns({k: F.col(k).cast("double") for k in ("pos", "closing_arrears")})


@query(_PRIORITY + """, g AS (SELECT rank, ROW_NUMBER() OVER (ORDER BY rank) AS place, COUNT(*) OVER () AS n FROM (SELECT DISTINCT rank FROM pl)),
x AS (SELECT pl.*, ROW_NUMBER() OVER (PARTITION BY rank ORDER BY loan_no) AS rn FROM pl)
SELECT priority, loan_no FROM x JOIN g USING (rank) WHERE rn <= 50 // n + CASE WHEN place <= 50 % n THEN 1 ELSE 0 END""")
def priority_quota(curr):
    return priority.quota(priority.ranked(curr, AS_OF), 50).select("priority", "loan_no")


# declarative queries
@query(f"""SELECT ROW_NUMBER() OVER (ORDER BY npa_pct DESC, region_name) AS rank, * FROM (SELECT region_name, COUNT(*) AS total, COUNT(*) FILTER (curr_bucket = 'NPA') AS npa,
  CAST(SUM(soh) AS DOUBLE) AS soh, COALESCE({_r("CAST(COUNT(*) FILTER (curr_bucket = 'NPA') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100")}, 0) AS npa_pct FROM curr GROUP BY region_name)""")
def agg_region_pct(curr):
    return q.run_aggregation(curr, {
        "group_by": "RegionName", "counts": [{"alias": "total", "column": "__total__"}, {"alias": "npa", "column": "curr_bucket", "op": "==", "value": "NPA"}],
        "sums": [{"alias": "soh", "column": "SOH"}], "metrics": [{"label": "npa_pct", "expr": "npa / total * 100"}], "sort_asc": False,
    })


@query(f"""SELECT ROW_NUMBER() OVER (ORDER BY share DESC, unit) AS rank, * FROM (SELECT unit, COUNT(*) FILTER (arrears_emi >= 2) AS high, COUNT(*) FILTER (loan_status IN ('RUN', 'MAT')) AS open,
  COALESCE(CASE WHEN COUNT(*) FILTER (loan_status IN ('RUN', 'MAT')) <> 0 THEN {_r("CAST(COUNT(*) FILTER (arrears_emi >= 2) AS DOUBLE) / COUNT(*) FILTER (loan_status IN ('RUN', 'MAT')) * 100")} END, 0) AS share
  FROM curr GROUP BY unit HAVING COUNT(*) FILTER (arrears_emi >= 2) >= 3 ORDER BY share DESC, unit LIMIT 7)""")
def agg_having_limit(curr):
    return q.run_aggregation(curr, {
        "group_by": "Unit", "counts": [{"alias": "high", "column": "Arrears / EMI", "op": ">=", "value": 2}, {"alias": "open", "column": "loan_status", "op": "in", "value": ["run", "mat"]}],
        "metric": "high / open * 100", "metric_label": "share", "having": [{"alias": "high", "op": ">=", "value": 3}], "limit": 7, "sort_asc": False,
    })


@query(f"""SELECT ROW_NUMBER() OVER (ORDER BY net, mnt_name, unit) AS rank, CONCAT(mnt_name, ' (', unit, ')') AS "mnt_name (unit)", worse, better, stable, net FROM (SELECT mnt_name, unit,
  COUNT(*) FILTER ({_score('curr_bucket')} > {_score('prev_bucket')}) AS worse, COUNT(*) FILTER ({_score('curr_bucket')} < {_score('prev_bucket')}) AS better,
  COUNT(*) FILTER ({_score('curr_bucket')} = {_score('prev_bucket')}) AS stable,
  CAST(COUNT(*) FILTER ({_score('curr_bucket')} > {_score('prev_bucket')}) - COUNT(*) FILTER ({_score('curr_bucket')} < {_score('prev_bucket')}) AS DOUBLE) AS net FROM cp GROUP BY mnt_name, unit)""", "both")
def agg_two_keys_moves(curr, prev):
    move = lambda a, op: {"alias": a, "column": "curr_bucket", "op": op, "value": "prev_bucket"}
    return q.run_aggregation(curr, {
        "group_by": ["MNT NAME", "Unit"], "counts": [move("worse", "bucket_worse_than"), move("better", "bucket_better_than"), move("stable", "bucket_stable")],
        "metrics": [{"label": "net", "expr": "worse - better"}],
    })


@query(f"""SELECT ROW_NUMBER() OVER (ORDER BY reduction DESC, unit) AS rank, * FROM (SELECT unit, COUNT(*) FILTER (prev_bucket = 'NPA') AS before, COUNT(*) FILTER (curr_bucket = 'NPA') AS after,
  COALESCE(CASE WHEN COUNT(*) FILTER (prev_bucket = 'NPA') <> 0 THEN {_r("CAST(COUNT(*) FILTER (prev_bucket = 'NPA') - COUNT(*) FILTER (curr_bucket = 'NPA') AS DOUBLE) / COUNT(*) FILTER (prev_bucket = 'NPA') * 100")} END, 0) AS reduction
  FROM cp GROUP BY unit HAVING COUNT(*) FILTER (prev_bucket = 'NPA') >= 2)""", "both")
def agg_snapshot_reduction(curr, prev):
    count = lambda a, col: {"alias": a, "column": col, "op": "==", "value": "NPA"}
    return q.run_aggregation(curr, {
        "group_by": "Unit", "counts": [count("before", "prev_bucket"), count("after", "curr_bucket")], "metrics": [{"label": "reduction", "expr": "(before - after) / before * 100"}],
        "having": [{"alias": "before", "op": ">=", "value": 2}], "sort_asc": False,
    })


@query(f"""SELECT 1 AS rank, unit, soh, CAST(total AS BIGINT) AS total, per_loan FROM (SELECT unit, CAST(SUM(soh) AS DOUBLE) AS soh, COUNT(*) AS total,
  {_r('CAST(SUM(soh) AS DOUBLE) / COUNT(*)')} AS per_loan FROM curr GROUP BY unit ORDER BY per_loan DESC, unit LIMIT 1)""")
def agg_single_answer(curr):
    return q.single_answer(curr, {
        "group_by": "Unit", "counts": [{"alias": "total", "column": "__total__"}], "sums": [{"alias": "soh", "column": "soh"}], "metrics": [{"label": "per_loan", "expr": "soh / total"}], "sort_asc": False,
    })


@query("""SELECT ROW_NUMBER() OVER (ORDER BY owners DESC, unit) AS rank, * FROM (SELECT unit, COUNT(*) AS owners, SUM(loans) AS loans FROM
  (SELECT unit, cust_mob_no, COUNT(DISTINCT loan_no) AS loans FROM curr GROUP BY 1, 2 HAVING COUNT(DISTINCT loan_no) >= 3) GROUP BY unit)""")
def plan_fleet_customers(curr):
    return q.run_plan(curr, [
        {"op": "group_aggregate", "group_by": ["Unit", "Cust Mob No"], "aggregations": [{"alias": "loans", "func": "nunique", "column": "Loan No"}]},
        {"op": "filter", "conditions": [{"column": "loans", "op": ">=", "value": 3}]},
        {"op": "group_aggregate", "group_by": ["Unit"], "aggregations": [{"alias": "owners", "func": "count"}, {"alias": "loans", "func": "sum", "column": "loans"}]},
        {"op": "sort", "by": "owners"},
    ])


@query(f"""SELECT ROW_NUMBER() OVER (ORDER BY per_branch DESC, region_name) AS rank, * FROM (SELECT region_name, SUM(customers) AS customers, COUNT(*) AS branches, MAX(most) AS most,
  {_r('CAST(SUM(customers) AS DOUBLE) / COUNT(*)')} AS per_branch FROM (SELECT region_name, unit, COUNT(*) AS customers, MAX(loans) AS most FROM
  (SELECT region_name, unit, cust_mob_no, COUNT(DISTINCT loan_no) AS loans FROM curr GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)""")
def plan_three_level(curr):
    return q.run_plan(curr, [
        {"op": "group_aggregate", "group_by": ["region_name", "unit", "cust_mob_no"], "aggregations": [{"alias": "loans", "func": "nunique", "column": "loan_no"}]},
        {"op": "group_aggregate", "group_by": ["region_name", "unit"], "aggregations": [{"alias": "customers", "func": "count"}, {"alias": "most", "func": "max", "column": "loans"}]},
        {"op": "group_aggregate", "group_by": "region_name", "aggregations": [{"alias": "customers", "func": "sum", "column": "customers"}, {"alias": "branches", "func": "count"}, {"alias": "most", "func": "max", "column": "most"}]},
        {"op": "derive", "column": "per_branch", "expr": "customers / branches"}, {"op": "sort", "by": "per_branch"},
    ])


@query("""SELECT ROW_NUMBER() OVER (ORDER BY unpaid DESC, unit) AS rank, * FROM (SELECT unit, COUNT(DISTINCT loan_no) AS loans, COUNT(DISTINCT loan_no) FILTER (last_receipt_date >= TIMESTAMP '2000-06-01 00:00:00') AS paid,
  CAST(COUNT(DISTINCT loan_no) - COUNT(DISTINCT loan_no) FILTER (last_receipt_date >= TIMESTAMP '2000-06-01 00:00:00') AS DOUBLE) AS unpaid FROM curr GROUP BY unit) ORDER BY rank LIMIT 10""")
def plan_unpaid_where(curr):
    paid = [{"column": "Last Receipt Date", "op": ">=", "value": "2000-06-01"}]
    return q.run_plan(curr, [
        {"op": "group_aggregate", "group_by": ["unit"], "aggregations": [{"alias": "loans", "func": "nunique", "column": "loan_no"}, {"alias": "paid", "func": "nunique", "column": "loan_no", "where": paid}]},
        {"op": "derive", "column": "unpaid", "expr": "loans - paid"}, {"op": "sort", "by": "unpaid", "ascending": False}, {"op": "limit", "n": 10},
    ])


@query("""SELECT ROW_NUMBER() OVER (ORDER BY unit) AS rank, unit, COUNT(*) AS n, MIN(due_day) AS low, MAX(tenure) AS high,
  CASE WHEN COUNT(*) FILTER (arrears_emi >= 6) = 0 THEN 0 ELSE AVG(tenure) FILTER (arrears_emi >= 6) END AS hard_tenure FROM curr GROUP BY unit""")
def plan_mean_where_zero(curr):
    hard = [{"column": "arrears_emi", "op": ">=", "value": 6}]
    return q.run_plan(curr, [{"op": "group_aggregate", "group_by": ["unit"], "aggregations": [
        {"alias": "n", "func": "count"}, {"alias": "low", "func": "min", "column": "due_day"}, {"alias": "high", "func": "max", "column": "tenure"},
        {"alias": "hard_tenure", "func": "mean", "column": "tenure", "where": hard},
    ]}])


def _rankings(table: str) -> str:
    return f"""SELECT * FROM (SELECT 'regions' AS ranking, ROW_NUMBER() OVER (ORDER BY COUNT(DISTINCT loan_no) DESC, region_name) AS place, region_name AS name, CAST(COUNT(DISTINCT loan_no) AS DOUBLE) AS value FROM {table} GROUP BY region_name) WHERE place <= 5
UNION ALL SELECT * FROM (SELECT 'executives', ROW_NUMBER() OVER (ORDER BY COUNT(DISTINCT loan_no) DESC, mnt_name, unit) AS place, CONCAT(mnt_name, ' (', unit, ')'), CAST(COUNT(DISTINCT loan_no) AS DOUBLE) FROM {table} GROUP BY mnt_name, unit) WHERE place <= 8
UNION ALL SELECT * FROM (SELECT 'branches', ROW_NUMBER() OVER (ORDER BY COUNT(DISTINCT loan_no) DESC, unit) AS place, unit, CAST(COUNT(DISTINCT loan_no) AS DOUBLE) FROM {table} GROUP BY unit) WHERE place <= 5
UNION ALL SELECT * FROM (SELECT 'branch_exposure', ROW_NUMBER() OVER (ORDER BY SUM(soh) DESC, unit) AS place, unit, CAST(SUM(soh) AS DOUBLE) FROM {table} GROUP BY unit) WHERE place <= 5
UNION ALL SELECT 'bucket_share', ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, curr_bucket), curr_bucket, {_r(f'CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM {table}) * 100', 1)} FROM {table} GROUP BY curr_bucket"""


@query(f""", r AS (SELECT * FROM curr WHERE curr_bucket IN ('SMA-1', 'SMA-2', 'NPA'))
{_rankings('r')}""")
def contextual_rankings(curr):
    return q.contextual_rankings(q.filter_rows(curr, {"conditions": [{"column": "curr_bucket", "op": "in", "value": ["SMA-1", "SMA-2", "NPA"]}]}))


@query(_PRIORITY + f""", r AS (SELECT * FROM curr WHERE loan_no IN (SELECT loan_no FROM pl WHERE rank <= 5))
{_rankings('r')}""")
def priority_rankings(curr):
    """The rankings of what a priority list shows, by loan number: its rows lack the columns."""
    shown = priority.ranked(curr, AS_OF).where("rank <= 5").select("priority", "loan_no")
    return q.contextual_rankings(q.rows_behind(curr, shown))


# ingest and report
def _as_extract(df: DataFrame) -> DataFrame:
    """A snapshot as its text extract: source headers, padded or in lower case, numbers and serial dates as text."""
    back = {canonical(h): h for h in HEADERS}
    out = []
    for k, f in enumerate(x for x in df.schema if x.name in back):
        head = back[f.name]
        name = f" {head} " if k % 3 == 0 else head.lower() if k % 3 == 1 else head
        col = F.col(f.name)
        if f.dataType.typeName().startswith("timestamp"):
            col = (F.datediff(col, F.lit("1899-12-30").cast("date"))).cast("string")
        out.append(col.cast("string").alias(name))
    return df.select(*out)


@query("""SELECT CAST(loan_no AS VARCHAR) AS loan_no, unit, CAST(ag_date AS DATE) AS ag_date, CAST(closing_arrears AS DOUBLE) AS closing_arrears, CAST(demand AS DOUBLE) AS demand,
  CAST(COALESCE(collection, 0) AS DOUBLE) AS collection, CAST(tenure AS DOUBLE) AS tenure, strike, curr_bucket FROM curr""")
def ingest_dirty_csv(curr):
    made = ingest.load(_as_extract(curr))
    return made.select("loan_no", "unit", F.to_date("ag_date").alias("ag_date"), "closing_arrears", "demand", "collection", "tenure", "strike", "curr_bucket")


@query("""SELECT CAST(loan_no AS VARCHAR) AS loan_no, curr_bucket FROM curr UNION ALL
SELECT CAST(loan_no AS VARCHAR), curr_bucket FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr)""", "apart")
def union_dedupe(curr, prev):
    made, _ = ingest.load_many({"curr": _as_extract(curr), "prev": _as_extract(prev)})
    return made.select("loan_no", "curr_bucket")


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("compression", "gzip").csv(path)


def _csv(df: DataFrame) -> DataFrame:
    """A snapshot's extract as CSV files, written and read again as text."""
    path = shared.folder(df.sparkSession)
    _write_csv(_as_extract(df), path)
    return ingest.read_raw(df.sparkSession, path)


@query("""SELECT CAST(loan_no AS VARCHAR) AS loan_no, unit, CAST(ag_date AS DATE) AS ag_date, CAST(last_receipt_date AS DATE) AS last_receipt_date, CAST(tenure AS DOUBLE) AS tenure,
  CAST(closing_arrears AS DOUBLE) AS closing_arrears, CAST(COALESCE(collection, 0) AS DOUBLE) AS collection, strike, curr_bucket FROM curr""")
def ingest_csv_files(curr):
    """CSV files in, typed snapshot out."""
    made = ingest.load(_csv(curr))
    return c.dated(made.select("loan_no", "unit", "ag_date", "last_receipt_date", "tenure", "closing_arrears", "collection", "strike", "curr_bucket"))


def _files(curr: DataFrame, prev: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Extracts as CSV, loaded in order: the current one, one that lacks columns, one that is not there, the previous one."""
    spark = curr.sparkSession
    paths = [shared.folder(spark) for _ in range(4)]
    _write_csv(_as_extract(curr), paths[0])
    whole = ingest.read_raw(spark, paths[0])
    _write_csv(whole.select(*[F.col(f"`{c}`").alias(h) for c, h in ingest.match_headers(whole.columns).items() if h in ("Loan No", "Unit")]), paths[1])
    _write_csv(_as_extract(prev), paths[3])
    return *ingest.load_files(spark, paths), paths


@query("""SELECT CAST(loan_no AS VARCHAR) AS loan_no, unit, curr_bucket FROM curr UNION ALL
SELECT CAST(loan_no AS VARCHAR), unit, curr_bucket FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr)""", "apart")
def ingest_many_files(curr, prev):
    """Of a loan in several files the row of the first file; files that cannot be used are left out."""
    return _files(curr, prev)[0].select("loan_no", "unit", "curr_bucket")


@query("""SELECT 1 AS file, 'missing columns: ' AS error, (SELECT COUNT(*) FROM curr) + (SELECT COUNT(*) FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr)) AS loaded
UNION ALL SELECT 2, 'cannot be read: ', (SELECT COUNT(*) FROM curr) + (SELECT COUNT(*) FROM prev WHERE loan_no NOT IN (SELECT loan_no FROM curr))""", "apart")
def ingest_file_errors(curr, prev):
    """What was wrong with the files that were left out, beside the loans that the others gave."""
    made, errors, paths = _files(curr, prev)
    names = curr.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "path string, file int")
    found = errors.join(F.broadcast(names), "path").select("file", F.regexp_extract("error", "^[^:]*: ", 0).alias("error"))
    return found.crossJoin(F.broadcast(made.agg(F.count(F.lit(1)).alias("loaded"))))  # one row


@query("\nUNION ALL ".join(f"SELECT '{h}' AS header, '{canonical(h)}' AS column, TRUE AS present, COUNT({canonical(h)}) AS filled FROM curr" for h in MANDATORY))
def mandatory_filled(curr):
    """Whether an extract has the mandatory columns, and in how many rows each holds something."""
    return ingest.mandatory_columns(_as_extract(curr))


@query("SELECT loan_no, unit, (SELECT COUNT(*) FROM curr) AS total FROM curr ORDER BY loan_no LIMIT 1000")
def rows_preview(curr):
    """The first thousand rows by loan number and how many there are, from one pass."""
    shown, n = c.preview(curr.select("loan_no", "unit"), 1000, ("loan_no",))
    return curr.sparkSession.createDataFrame(shown, curr.select("loan_no", "unit").schema).withColumn("total", F.lit(n).cast("long"))


@query("SELECT CAST(loan_no AS VARCHAR) AS loan_no, unit, COALESCE(strike, '') AS strike, COALESCE(strftime(ag_date, '%Y-%m-%d'), '') AS ag_date, CAST(due_day AS VARCHAR) AS due_day FROM curr")
def rows_as_text(curr):
    return c.as_text(c.dated(curr.select("loan_no", "unit", "strike", "ag_date", "due_day")))


@query("SELECT loan_no, unit, curr_bucket FROM curr", "both")
def rows_distinct_names(curr, prev):
    """A join that repeats columns, each name once."""
    left, right = curr.select("loan_no", "unit", "curr_bucket"), curr.select("loan_no", "unit").toDF("k", "u")
    return c.distinct_names(left.join(right, F.col("loan_no") == F.col("k")).toDF("loan_no", "unit", "curr_bucket", "loan_no", "unit"))


@query("""SELECT ROW_NUMBER() OVER (ORDER BY unit) AS rank, unit, COUNT(*) FILTER (tenure >= 36) AS long_tenure, COUNT(*) FILTER (tenure IS DISTINCT FROM 12) AS other_tenure,
  COUNT(*) AS no_number FROM curr GROUP BY unit""")
def agg_text_numbers(curr):
    """Numeric comparisons of columns that hold text: numbers in it count, what is none differs from every number."""
    rows = curr.withColumns({"tenure": F.concat(F.lit(" "), F.col("tenure").cast("string")), "note": F.concat(F.lit("n/a "), "unit")})
    count = lambda alias, column, op, value: {"alias": alias, "column": column, "op": op, "value": value}
    return q.run_aggregation(rows, {"group_by": "Unit", "counts": [count("long_tenure", "tenure", ">=", 36), count("other_tenure", "tenure", "!=", 12), count("no_number", "note", "!=", 5)]})


@query("SELECT ROW_NUMBER() OVER (ORDER BY loans DESC, cust_name) AS rank, cust_name, loans, soh FROM (SELECT cust_name, COUNT(*) AS loans, CAST(SUM(soh) AS DOUBLE) AS soh FROM curr GROUP BY cust_name)")
def agg_customers(curr):
    """Ranks of as many groups as there are customers."""
    spec = {"group_by": "cust_name", "counts": [{"alias": "loans", "column": "__total__"}], "sums": [{"alias": "soh", "column": "SOH"}], "metrics": [{"expr": "loans", "label": "n"}], "sort_asc": False}
    return q.run_aggregation(curr, spec).drop("n")


_SPECS = {
    "good": ("filter", {"conditions": [{"column": "Arrears / EMI", "op": ">", "value": 2}], "sort_by": "loan_no"}),
    "zone": ("filter", {"conditions": [{"column": "zone", "op": "like", "value": 1}, {"column": "curr_bucket", "op": "bucket_worse_than", "value": "old_bucket"}]}),
    "keys": ("aggregation", {"counts": [{"column": "unit", "value": "A"}], "metrics": [{"expr": "npa / n", "label": "share"}], "having": [{"alias": "total", "op": "~"}]}),
    "steps": ("plan", [{"op": "group_aggregate", "group_by": ["unit"], "aggregations": [{"func": "median", "alias": "m", "column": "pos"}]}, {"op": "sort", "by": "loan_no"}, {"op": "pivot"}]),
}
_PROBLEMS = (
    ("zone", 1, "unknown column ''zone''"), ("zone", 2, "unknown op ''like''"), ("zone", 3, "unknown column ''old_bucket''"),
    ("keys", 1, "group_by is missing"), ("keys", 2, "an aggregation has no alias"), ("keys", 3, "undefined name ''n''"), ("keys", 4, "undefined name ''npa''"),
    ("keys", 5, "having: undefined alias ''total''"), ("keys", 6, "having: unknown op ''~''"),
    ("steps", 1, "step 1 (group_aggregate): unknown function ''median''"), ("steps", 2, "step 2 (sort): unknown column ''loan_no''"), ("steps", 3, "step 3 (pivot): unknown operation ''pivot''"),
)


@query("\nUNION ALL ".join(f"SELECT '{name}' AS spec, {k} AS place, '{text}' AS problem, COUNT(*) AS rows_waiting FROM curr" for name, k, text in _PROBLEMS))
def spec_problems(curr):
    """Everything wrong with specs over the book's columns, a row each, beside the rows that they would have read."""
    return checks.problems(curr.sparkSession, curr, _SPECS).crossJoin(F.broadcast(curr.agg(F.count(F.lit(1)).alias("rows_waiting"))))  # one row


@query("""SELECT '2001-11' AS snapshot_month, CAST(loan_no AS VARCHAR) AS loan_no, curr_bucket FROM curr UNION ALL
SELECT '2001-10', CAST(loan_no AS VARCHAR), curr_bucket FROM prev""", "apart")
def snapshot_roundtrip(curr, prev):
    """Months of a snapshot table; the current one is written twice and stays single."""
    spark, path = curr.sparkSession, shared.folder(curr.sparkSession)
    for month, df in (("2001-10", prev), ("2001-11", curr), ("2001-11", curr)):
        ingest.write_snapshot(df.select(F.col("loan_no").cast("string").alias("loan_no"), "curr_bucket"), path, month)
    months = [ingest.read_snapshot(spark, path, m).select(F.col("snapshot_month").cast("string").alias("snapshot_month"), "loan_no", "curr_bucket") for m in ("2001-10", "2001-11")]
    return months[0].unionByName(months[1])


@query("SELECT loan_no, CAST(ag_date AS DATE) AS ag_date FROM curr")
def ingest_dates(curr):
    """Dates in every spelling that extracts have: serial days, ISO, day first with dashes, slashes or month names."""
    forms = [F.date_format("ag_date", f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy")]
    serial = F.datediff("ag_date", F.lit("1899-12-30").cast("date")).cast("string")
    text = F.element_at(F.array(serial, *forms), (F.col("loan_no") % 5 + 1).cast("int"))
    rows = curr.select("loan_no", text.alias("ag_date"))
    return rows.select("loan_no", F.to_date(ingest.day(rows, "ag_date")).alias("ag_date"))


@query("""SELECT loan_no, region_name, unit, CAST(ag_date AS DATE) AS ag_date, mnt_name, due_day, tenure, loan_status, CAST(loan_amount AS DOUBLE) AS loan_amount, cust_name, cust_mob_no,
  curr_bucket, CAST(month_due_inst AS DOUBLE) AS month_due_inst, CAST(month_due_exp AS DOUBLE) AS month_due_exp, CAST(demand AS DOUBLE) AS demand, CAST(month_receipt AS DOUBLE) AS month_receipt,
  CAST(closing_arrears AS DOUBLE) AS closing_arrears, CAST(arr_inst AS DOUBLE) AS arr_inst, CAST(arr_exp AS DOUBLE) AS arr_exp, lcc_pct, arrears_emi, CAST(pos AS DOUBLE) AS pos, CAST(soh AS DOUBLE) AS soh,
  non_starter, strike, CAST(last_receipt_date AS DATE) AS last_receipt_date, no_coll_3m, nach_status FROM curr WHERE arrears_emi >= 2""")
def filter_default_columns(curr):
    """The usual display columns of a query's rows."""
    rows = q.run_filter(curr, {"conditions": [{"column": "Arrears / EMI", "op": ">=", "value": 2}]})
    return rows.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in rows.schema])


def _figures(section: str, table: str, item: str, label: str, measures: str) -> str:
    return f"""SELECT '{section}' AS section, {item} AS item, {label} AS label, measure, value FROM (UNPIVOT (SELECT {', '.join(x for x in (item, label) if x != 'NULL') + ', ' if item != 'NULL' else ''}
  {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in measures.split())} FROM {table}) ON {', '.join(measures.split())} INTO NAME measure VALUE value)"""


_CARD_MEASURES = "accounts strike_pct collection_pct roll_fwd_pct roll_bwd_pct npa_pct npa sma2 pos_lakh soh_lakh demand_lakh collected_lakh"
_FLAGS = SQL["risk_flags_top3"].rpartition("SELECT * FROM s")[2]
_PART = lambda name, head: "(" + SQL[name].rpartition(head)[1] + SQL[name].rpartition(head)[2] + ")"
_REPORT = ",\n".join(x.strip().removeprefix(",").strip() for x in (_KPIS, _ALERTS, _CARD, _BRANCH, _MOVES))


@query(", " + _REPORT + "\n" + "\nUNION ALL ".join([
    _figures("portfolio_health", _PART("portfolio_health", "SELECT *, CASE kpi"), "kpi", "light", "value prev_value mom_pct"),
    _figures("risk_flags", f"(SELECT * FROM s{_FLAGS})", "alert_id", "severity", "place count soh closing_arrears"),
    _figures("migration_matrix", f"(WITH {SQL['roll_matrix'].rpartition('pb(prev_bucket')[1]}{SQL['roll_matrix'].rpartition('pb(prev_bucket')[2]})", "prev_bucket", "NULL", "place std dpd_1_30 sma_1 sma_2 npa"),
    _figures("migration_kpis", _PART("roll_kpis", "SELECT COUNT(*) AS matched"), "NULL", "NULL", "matched roll_forward_pct roll_backward_pct npa_formation_pct new_entries exits"),
    _figures("executives_top", _PART("executive_top5", "SELECT * FROM card"), "executive", "tier", _CARD_MEASURES),
    _figures("executives_bottom", _PART("executive_bottom5", "SELECT * FROM card"), "executive", "tier", _CARD_MEASURES),
    _figures("branches_top", _PART("branch_top5", "SELECT branch, accounts"), "branch", "NULL", "accounts coll_pct collection_lakh demand_lakh"),
    _figures("branches_bottom", _PART("branch_bottom5", "SELECT branch, accounts"), "branch", "NULL", "accounts coll_pct collection_lakh demand_lakh"),
]), "both")
def report_tables(curr, prev):
    """All sections from two written tables, a row per figure."""
    return report.figures(report.sections(shared.written(curr.select(*report.CURR)), shared.written(prev.select(*report.PREV)), AS_OF))
