"""A loan book derived from orders and their lines: one loan per order, one instalment per line, two snapshots."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions.columns import bucket, score

AS_OF = datetime(2001, 11, 1)
#: Loans opened from here on are not in the previous snapshot; loans whose last instalment lies before the other day have left the current one.
OPENED, CLOSED = "2001-04-01", "1997-06-01"


def _money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def _unpaid(snapshot: str) -> Column:
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    if snapshot == "curr":
        return (flag == "R") & ((status == "O") | (line <= 2))
    return (status == "O") & (flag != "N")


def loan_book(spark: SparkSession, sf_dir: str, snapshot: str = "curr") -> DataFrame:
    """The snapshot ``curr`` or ``prev``."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    line = F.col("l_linenumber")
    lines = read("lineitem").select(
        "l_orderkey", "l_shipdate", _money(F.col("l_extendedprice")).alias("amt"),
        (_money(F.col("l_extendedprice")) * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))).alias("net"),
        F.when(line <= 5, "INST").when(line == 6, "BC").otherwise("EXP").alias("comp"), F.coalesce(_unpaid(snapshot), F.lit(False)).alias("unpaid"),
    )
    inst, exp, bc, unpaid, zero = F.col("comp") == "INST", F.col("comp") == "EXP", F.col("comp") == "BC", F.col("unpaid"), F.lit(0)
    units = {"amt": (100, "decimal(28,2)"), "net": (10000, "decimal(33,4)")}
    exact = lambda x, name: (x.cast("decimal(19,0)") * F.lit(Decimal(1) / units[name][0])).cast(units[name][1])
    total = lambda cond, x: exact(F.sum(F.when(cond, (F.col(x) * units[x][0]).cast("long")).otherwise(zero)), x)
    loans = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(unpaid.cast("int")).alias("n_unpaid"), total(F.lit(True), "amt").alias("due"),
        (total(F.lit(True), "amt").cast("double") / F.count(F.lit(1))).alias("emi"),
        total(inst, "amt").alias("due_inst"), total(exp, "amt").alias("due_exp"), total(unpaid, "amt").alias("arr"),
        total(unpaid & inst, "amt").alias("arr_inst"), total(unpaid & exp, "amt").alias("arr_exp"), total(unpaid & bc, "amt").alias("arr_bc"),
        total(~unpaid, "net").alias("coll"), total(~unpaid & ~bc, "net").alias("coll_ie"), F.max(F.when(~unpaid, F.col("l_shipdate"))).alias("last_receipt"), F.max("l_shipdate").alias("last_line"),
    )
    region = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owned = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = owned.join(loans, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(region, F.col("c_nationkey") == F.col("n_nationkey"))  # names last
    day = lambda text: F.lit(text).cast("timestamp")
    here = F.coalesce(F.col("last_line") >= day(CLOSED), F.lit(True)) if snapshot == "curr" else F.col("o_orderdate") < day(OPENED)
    rows = rows.where(here)
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    money = lambda c: F.col(c).cast("double")
    ratio = money("arr") / F.col("emi")
    due = F.col("due_inst") + F.col("due_exp")
    pos = F.when(status == "F", _money(F.col("o_totalprice")) * F.lit("0.4").cast("decimal(2,1)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    no_lines, flag = F.col("n_lines").isNull(), lambda c: F.when(c, "Y").otherwise("N")
    out = rows.select(
        key.alias("loan_no"), F.col("r_name").alias("region_name"), F.col("n_name").alias("unit"),
        F.concat(F.lit("EXEC_"), (F.col("c_custkey") % 4).cast("string")).alias("mnt_name"), cust.alias("cust_mob_no"), F.col("c_name").alias("cust_name"),
        F.col("c_mktsegment").alias("segment"), F.when(status == "F", "RUN").when(status == "O", "MAT").otherwise("S&S").alias("loan_status"),
        F.col("o_orderdate").alias("ag_date"), (5 * (1 + key % 4)).alias("due_day"), (12 * (1 + key % 5)).alias("tenure"),
        _money(F.col("o_totalprice")).alias("loan_amount"), ratio.alias("arrears_emi"), F.col("arr").alias("closing_arrears"),
        "arr_inst", "arr_exp", "arr_bc", F.col("due_inst").alias("month_due_inst"), F.col("due_exp").alias("month_due_exp"), F.col("due").alias("demand"),
        F.col("coll").alias("collection"), F.col("coll").alias("month_receipt"), F.col("coll").alias("total_cum_coll"), F.col("coll_ie").alias("cum_coll_ie"),
        F.col("due_inst").alias("cum_due_inst"), F.col("due_exp").alias("cum_due_exp"),
        F.when(due > 0, F.least(F.lit(100.0), F.col("coll_ie").cast("double") / due.cast("double") * 100)).alias("lcc_pct"),
        pos.alias("pos"), (pos + F.coalesce(F.col("arr"), F.lit(0))).alias("soh"),
        F.when(no_lines, None).when(F.col("arr_inst") <= 0, "Y").otherwise("N").alias("strike"),
        flag(F.col("n_unpaid") == F.col("n_lines")).alias("non_starter"), flag(F.col("o_orderpriority") == "1-URGENT").alias("colending"),
        F.when(no_lines, "NA").when((F.col("n_unpaid") >= 3) & (F.col("last_receipt") < F.lit("2001-08-01").cast("timestamp")), "Y").otherwise("N").alias("no_coll_3m"),
        F.when(cust % 3 == 0, "N").otherwise("Y").alias("nach_status"), flag(key % 50 == 7).alias("lgl_flag"),
        F.when(F.col("c_custkey") % 97 == 5, "Dead").otherwise("Alive").alias("customer_status"), F.col("last_receipt").alias("last_receipt_date"),
        bucket(ratio).alias("curr_bucket"),
    )
    return out.withColumn("curr_score", F.coalesce(score(F.col("curr_bucket")), F.lit(-1)))


def _sql(name: str, unpaid: str, here: str) -> str:
    return f"""
{name}_i AS (SELECT l_orderkey, l_shipdate, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS net_amt,
  CASE WHEN l_linenumber <= 5 THEN 'INST' WHEN l_linenumber = 6 THEN 'BC' ELSE 'EXP' END AS comp,
  CASE WHEN {unpaid} THEN 1 ELSE 0 END AS unpaid FROM lineitem),
{name}_l AS (SELECT l_orderkey, COUNT(*) AS n_lines, SUM(unpaid) AS n_unpaid, SUM(amt) AS due, CAST(SUM(amt) AS DOUBLE) / COUNT(*) AS emi,
  SUM(CASE WHEN comp = 'INST' THEN amt ELSE 0 END) AS due_inst, SUM(CASE WHEN comp = 'EXP' THEN amt ELSE 0 END) AS due_exp,
  SUM(CASE WHEN unpaid = 1 THEN amt ELSE 0 END) AS arr, SUM(CASE WHEN unpaid = 1 AND comp = 'INST' THEN amt ELSE 0 END) AS arr_inst,
  SUM(CASE WHEN unpaid = 1 AND comp = 'EXP' THEN amt ELSE 0 END) AS arr_exp, SUM(CASE WHEN unpaid = 1 AND comp = 'BC' THEN amt ELSE 0 END) AS arr_bc,
  SUM(CASE WHEN unpaid = 0 THEN net_amt ELSE 0 END) AS coll, SUM(CASE WHEN unpaid = 0 AND comp <> 'BC' THEN net_amt ELSE 0 END) AS coll_ie,
  MAX(CASE WHEN unpaid = 0 THEN l_shipdate END) AS last_receipt, MAX(l_shipdate) AS last_line FROM {name}_i GROUP BY l_orderkey),
{name}_b AS (SELECT o_orderkey AS loan_no, r_name AS region_name, n_name AS unit, CONCAT('EXEC_', CAST(c_custkey % 4 AS VARCHAR)) AS mnt_name,
  c_custkey AS cust_mob_no, c_name AS cust_name, c_mktsegment AS segment,
  CASE o_orderstatus WHEN 'F' THEN 'RUN' WHEN 'O' THEN 'MAT' ELSE 'S&S' END AS loan_status, o_orderdate AS ag_date,
  5 * (1 + o_orderkey % 4) AS due_day, 12 * (1 + o_orderkey % 5) AS tenure, CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amount,
  CAST(arr AS DOUBLE) / emi AS arrears_emi, arr AS closing_arrears, arr_inst, arr_exp, arr_bc, due_inst AS month_due_inst, due_exp AS month_due_exp,
  due AS demand, coll AS collection, coll AS month_receipt, coll AS total_cum_coll, coll_ie AS cum_coll_ie, due_inst AS cum_due_inst, due_exp AS cum_due_exp,
  CASE WHEN due_inst + due_exp > 0 THEN LEAST(CAST(100 AS DOUBLE), CAST(coll_ie AS DOUBLE) / CAST(due_inst + due_exp AS DOUBLE) * 100) END AS lcc_pct,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.4 AS DECIMAL(2,1)) ELSE CAST(0 AS DECIMAL(18,2)) END AS pos,
  CASE WHEN n_lines IS NULL THEN NULL WHEN arr_inst <= 0 THEN 'Y' ELSE 'N' END AS strike, CASE WHEN n_unpaid = n_lines THEN 'Y' ELSE 'N' END AS non_starter,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS colending,
  CASE WHEN n_lines IS NULL THEN 'NA' WHEN n_unpaid >= 3 AND last_receipt < TIMESTAMP '2001-08-01 00:00:00' THEN 'Y' ELSE 'N' END AS no_coll_3m,
  CASE WHEN o_custkey % 3 = 0 THEN 'N' ELSE 'Y' END AS nach_status, CASE WHEN o_orderkey % 50 = 7 THEN 'Y' ELSE 'N' END AS lgl_flag,
  CASE WHEN c_custkey % 97 = 5 THEN 'Dead' ELSE 'Alive' END AS customer_status, last_receipt AS last_receipt_date,
  CASE WHEN arr IS NULL THEN 'NA' WHEN CAST(arr AS DOUBLE) / emi <= 0 THEN 'STD' WHEN CAST(arr AS DOUBLE) / emi < 1 THEN '1-30 DPD'
    WHEN CAST(arr AS DOUBLE) / emi < 2 THEN 'SMA-1' WHEN CAST(arr AS DOUBLE) / emi < 3 THEN 'SMA-2' ELSE 'NPA' END AS curr_bucket
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN {name}_l ON o_orderkey = l_orderkey WHERE {here}),
{name} AS (SELECT *, pos + COALESCE(closing_arrears, 0) AS soh,
  CASE curr_bucket WHEN 'STD' THEN 0 WHEN '1-30 DPD' THEN 1 WHEN 'SMA-1' THEN 2 WHEN 'SMA-2' THEN 3 WHEN 'NPA' THEN 4 ELSE -1 END AS curr_score FROM {name}_b)"""


#: The same two snapshots as common table expressions, for SQL that starts WITH them.
CURR_SQL = _sql("curr", "l_returnflag = 'R' AND (l_linestatus = 'O' OR l_linenumber <= 2)", f"COALESCE(last_line >= TIMESTAMP '{CLOSED} 00:00:00', TRUE)")
PREV_SQL = _sql("prev", "l_linestatus = 'O' AND l_returnflag <> 'N'", f"o_orderdate < TIMESTAMP '{OPENED} 00:00:00'")
