from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duebook import catalog
from duebook.plans.queries import run_filter
from duebook.schema import DATES, HEADERS, MANDATORY, NUMBERS, SNAPSHOT, TEXTS, canonical
from duebook.sources import ingest, shared


def extract(spark, changes=None, n=1):
    values = {h: "1" for h in MANDATORY} | {"Loan No": "A", "RegionName": "W", "Unit": " alpha ", "Ag_Date": "46082.5", "Strike": " y"} | (changes or {})
    return spark.createDataFrame([tuple(values.values())] * n, ", ".join(f"`{k}` string" for k in values))


def test_names_are_distinct():
    assert len(HEADERS) == 85 and len({canonical(h) for h in HEADERS}) == 85


@pytest.mark.parametrize("given,expected", [
    (" Loan No ", "Loan No"), ("loan no", "Loan No"), ("Cum Coll (Inst+Exp+BC)", "Cum Coll (Inst+Exp)"), ("NET Collection Demand Inst+Exp+B", "Net Collection Demand Inst+Exp+BC"),
    ("UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by R", "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by RE"), ("Month Collection (Exc", "Month Collection (Excluding Reserve Collection)"),
])
def test_headers(given, expected):
    assert ingest.match_headers([given]) == {given: expected}


def test_headers_claim_targets_once():
    assert ingest.match_headers(["Loan No", "loan no", "Month Rec", "remarks"]) == {"Loan No": "Loan No"}


def test_load(spark):
    df = ingest.load(extract(spark, {"Arrears / EMI": "2.5", "POS": "n/a", "Closing Arrears": "x", "remarks": "kept", "LCC%": "NaN"}))
    r = df.first()
    assert r["ag_date"] == datetime(2026, 3, 1, 12) and r["curr_bucket"] == "SMA-2" and r["pos"] is None and r["closing_arrears"] is None and r["soh"] == 0 and r["net_collection"] == 0
    assert r["unit"] == "ALPHA" and r["strike"] == "Y" and r["remarks"] == "kept" and r["lcc_pct"] is None and r["cum_coll_ie"] == 0


@pytest.mark.parametrize("given,expected", [("46082", datetime(2026, 3, 1)), ("2024-02-03", datetime(2024, 2, 3)), ("03-02-2024", datetime(2024, 2, 3)), ("0", None), ("soon", None), (None, None)])
def test_dates(spark, given, expected):
    assert ingest.load(extract(spark, {"Ag_Date": given})).first()["ag_date"] == expected


def test_missing_columns_are_all_named(spark):
    with pytest.raises(ingest.IngestError, match="Strike.*Closing Arrears|Closing Arrears.*Strike"):
        ingest.load(extract(spark).drop("Strike", "Closing Arrears"))


def test_many_files(spark):
    good, again = extract(spark, {"POS": "5"}, n=2), extract(spark, {"POS": "7"})
    other = extract(spark, {"Loan No": "B"}).withColumn("more", F.lit(1))
    df, errors = ingest.load_many({"a": good, "bad": spark.range(1), "b": again, "c": other})
    assert rows(df, "loan_no", "pos") == [("A", 5.0), ("B", 1.0)] and len(errors) == 1 and errors[0].startswith("bad")


def test_load_has_the_declared_schema(spark):
    df = ingest.load(extract(spark, {"DelinquencyDays": "95", "Tenure": "x", "remarks": "kept"}))
    assert [(f.name, f.dataType) for f in df.schema] == [*((f.name, f.dataType) for f in SNAPSHOT), ("remarks", StringType())]
    assert run_filter(df, {"conditions": [{"column": "DelinquencyDays", "op": ">", "value": 90}]}).count() == 1
    assert len(NUMBERS) + len(TEXTS) + len(DATES) == len(HEADERS) and df.first()["tenure"] is None


def test_load_keeps_the_first_row_of_a_loan(spark):
    values = [("A", "5"), ("B", "6"), ("A", "7"), (None, "8"), (None, "9")]
    df = extract(spark).drop("Loan No", "POS").crossJoin(spark.createDataFrame([(*v, k) for k, v in enumerate(values)], "`Loan No` string, POS string, place int").coalesce(1))
    got = ingest.load(df.orderBy("place").coalesce(1))
    assert sorted((r["loan_no"] or "", r["pos"]) for r in got.collect()) == [("", 8.0), ("", 9.0), ("A", 5.0), ("B", 6.0)]


def test_of_loaded_rows_only_used_columns_are_shuffled(spark):
    got = ingest.load(extract(spark, {"Cust Name": "C", "POS": "5"}, n=2)).select("loan_no", "curr_bucket")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "cust_name" not in plan and "SortAggregate" not in plan and rows(got) == [("A", "SMA-1")]
    assert plan.count("WindowGroupLimit") == 2  # repeats go before the shuffle too


def test_extracts_are_written_compressed(spark):
    with shared.Tables():
        raw = catalog._csv(ingest.load(extract(spark, n=3)))
        assert raw.count() == 1 and all(f.endswith(".csv.gz") for f in raw.inputFiles())


def test_loan_books_sum_whole_cents(spark, tmp_path):
    from duebook.sources.loanbook import loan_book

    ref = "/root/testdata/sf0.001"
    for name in ("nation", "region"):
        spark.read.parquet(f"{ref}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.sql("SELECT 1L AS c_custkey, 'C' AS c_name, 3 AS c_nationkey, 0D AS c_acctbal, 'S' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 7L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 10.5D AS o_totalprice, timestamp'2000-01-01' AS o_orderdate, 'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(7, 1, 0.1, 0.07, "R", "O"), (7, 2, 99999999.99, 0.1, "A", "F"), (7, 7, 0.2, 0.0, "A", "F")]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    df.withColumn("l_shipdate", F.lit("2001-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    book = loan_book(spark, str(tmp_path)).select("demand", "closing_arrears", "collection", "month_due_exp")
    assert [str(x) for x in book.first()] == ["100000000.29", "0.10", "90000000.1910", "0.20"]
    assert [f.dataType.simpleString() for f in book.schema] == ["decimal(28,2)", "decimal(28,2)", "decimal(33,4)", "decimal(28,2)"]
    assert "isEmpty" not in book._jdf.queryExecution().executedPlan().toString()  # what decimal sums shuffle beside each sum


def test_a_month_written_again_replaces_itself(spark, tmp_path):
    for month, n in (("2024-01", 2), ("2024-02", 3), ("2024-01", 1)):
        ingest.write_snapshot(spark.range(n), f"{tmp_path}/t", month)
    assert [ingest.read_snapshot(spark, f"{tmp_path}/t", m).count() for m in ("2024-01", "2024-02")] == [1, 3]


def csv(path, loans, header=None):
    names = header or ["Loan No", *[h for h in MANDATORY if h != "Loan No"]]
    lines = [",".join(names)] + [",".join([loan, *[unit if h == "Unit" else "46082" if h == "Ag_Date" else "1" for h in names[1:]]]) for loan, unit in loans]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_of_two_files_in_one_read_the_first_named_wins(spark, tmp_path):
    small = csv(tmp_path / "z.csv", [("1", "FIRST")])
    large = csv(tmp_path / "a.csv", [(str(k), "SECOND") for k in range(3000)])
    for paths, won in (([small, large], "FIRST"), ([large, small], "SECOND")):
        got = ingest.load(ingest.read_raw(spark, paths))
        assert got.count() == 3000 and got.where("loan_no = '1'").first()["unit"] == won
        assert "__place" not in got.columns
    assert ingest.load(ingest.read_raw(spark, str(tmp_path))).where("loan_no = '1'").first()["unit"] == "SECOND"  # by name


def test_within_a_file_the_first_line_wins_across_blocks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        path = csv(tmp_path / "a.csv", [(str(k % 700), f"U{k}") for k in range(2100)])
        raw = ingest.read_raw(spark, path)
        assert raw.rdd.getNumPartitions() > 5
        assert {(r["loan_no"], r["unit"]) for r in ingest.load(raw).collect()} == {(str(k), f"U{k}") for k in range(700)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_that_cannot_be_read_are_errors_of_their_own(spark, tmp_path):
    import gzip

    good = csv(tmp_path / "good.csv", [("1", "A"), ("2", "B")])
    (tmp_path / "good.csv").write_text((tmp_path / "good.csv").read_text() + "3,only\n")
    lacks = csv(tmp_path / "lacks.csv", [("4", "D")], ["Loan No", "Unit"])
    cut = tmp_path / "cut.csv.gz"
    csv(tmp_path / "whole.csv", [(str(k), "E") for k in range(50_000)])
    cut.write_bytes(gzip.compress((tmp_path / "whole.csv").read_bytes())[:-2000])
    later = csv(tmp_path / "later.csv", [("1", "LATE"), ("5", "F")])
    with shared.Tables():
        got, errors = ingest.load_files(spark, [good, lacks, str(cut), f"{tmp_path}/absent.csv", later])
        assert rows(got, "loan_no", "unit") == [("1", "A"), ("2", "B"), ("5", "F")]
        found = {r["path"].rsplit("/")[-1]: (r["line"], r["error"]) for r in errors.collect()}
    assert set(found) == {"good.csv", "lacks.csv", "cut.csv.gz", "absent.csv"} and found["good.csv"] == ("3,only", "does not fit the header")
    assert "Strike" in found["lacks.csv"][1] and "PATH_NOT_FOUND" in found["absent.csv"][1] and "cannot be read" in found["cut.csv.gz"][1]
    with pytest.raises(ingest.IngestError, match="absent"):
        ingest.load_files(spark, [f"{tmp_path}/absent.csv"])


def test_parquet_files_keep_their_order(spark, tmp_path):
    for name, pos in (("b", "5"), ("a", "7")):
        extract(spark, {"POS": pos}).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got, errors = ingest.load_files(spark, [f"{tmp_path}/b", f"{tmp_path}/a"], "parquet")
    assert rows(got, "loan_no", "pos") == [("A", 5.0)] and errors.count() == 0


def test_mandatory_columns_are_counted(spark):
    found = {r["header"]: (r["present"], r["filled"]) for r in ingest.mandatory_columns(extract(spark, {"POS": None}, n=2).drop("Strike")).collect()}
    assert len(found) == len(MANDATORY) and found["Strike"] == (False, 0) and found["POS"] == (True, 0) and found["Loan No"] == (True, 2)


def test_an_empty_month_replaces_the_former_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    ingest.write_snapshot(spark.range(3), path, "2024-01")
    ingest.write_snapshot(spark.range(2), path, "2024-02")
    ingest.write_snapshot(spark.range(0), path, "2024-01")
    assert [ingest.read_snapshot(spark, path, m).count() for m in ("2024-01", "2024-02")] == [0, 2]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    ingest.write_snapshot(spark.range(3), path, "2024-01")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
        ingest.write_snapshot(spark.range(3).select((F.lit(1) / (F.col("id") - 2)).cast("long").alias("id")), path, "2024-01")
    assert ingest.read_snapshot(spark, path, "2024-01").count() == 3
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("_new") or p.name.startswith("_old")] == []


def test_months_join_without_a_shuffle(spark):
    from duebook.operators import migration

    data = {"2024-01": [(f"L{k}", "STD") for k in range(50)], "2024-02": [(f"L{k}", "NPA" if k % 2 else "STD") for k in range(10, 60)]}
    with shared.Tables():
        frames = {m: spark.createDataFrame(x, "loan_no string, curr_bucket string") for m, x in data.items()}
        ingest.create_months(spark, "months_test", frames["2024-01"], 4, shared.folder(spark, "months_test"))
        for m, df in frames.items():
            ingest.write_month(df, "months_test", m)
        curr, prev = (ingest.read_month(spark, "months_test", m) for m in ("2024-02", "2024-01"))
        got = migration.migration_kpis(curr, prev)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SinglePartition" in plan  # only the last, one-row step moves rows
        assert tuple(got.first()) == tuple(migration.migration_kpis(frames["2024-02"], frames["2024-01"]).first())
        ingest.write_month(frames["2024-01"].limit(0), "months_test", "2024-01")
        assert ingest.read_month(spark, "months_test", "2024-01").count() == 0 and curr.count() == 50
    assert not spark.catalog.tableExists("months_test")


def test_tables_go_with_their_scope(spark):
    with shared.Tables():
        made = shared.written(spark.range(5))
        path = made.inputFiles()[0].rsplit("/", 2)[0]
        assert made.count() == 5 and shared.exists(spark, path)
        with shared.Tables():
            shared.written(spark.range(2))
        assert made.count() == 5
    assert not shared.exists(spark, path)


def test_tables_outside_scopes_go_with_the_application(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from duebook.sources import shared
print("rows", shared.written(spark.range(3)).count(), len(list(__import__("pathlib").Path("{tmp_path}").glob("table-*"))))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "rows 3 1" in done.stdout, done.stderr[-2000:]
    assert not list(tmp_path.glob("table-*"))


def test_csv_and_partitions(spark, tmp_path):
    extract(spark).write.option("header", True).csv(f"{tmp_path}/in")
    df = ingest.load(ingest.read_raw(spark, f"{tmp_path}/in"))
    for month in ("2024-01", "2024-02"):
        ingest.write_snapshot(df, f"{tmp_path}/out", month)
    one = ingest.read_snapshot(spark, f"{tmp_path}/out", "2024-02")
    assert one.count() == 1 and "snapshot_month" in one.columns
