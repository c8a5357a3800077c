"""Small snapshots with defaults for what a test does not care about."""

from datetime import datetime

from duebook.functions.columns import with_buckets, with_soh

AS_OF = datetime(2024, 6, 1)
SCHEMA = (
    "loan_no string, region_name string, unit string, mnt_name string, loan_status string, ag_date timestamp, arrears_emi double, month_receipt double, "
    "collection double, demand double, pos double, lcc_pct double, strike string, closing_arrears double, month_due_inst double, month_due_exp double, "
    "total_cum_coll double, cum_coll_ie double, cum_due_inst double, cum_due_exp double, non_starter string, colending string, no_coll_3m string, "
    "arr_inst double, arr_exp double, arr_bc double, loan_amount double, last_receipt_date timestamp, cust_mob_no string, cust_name string"
)
DEFAULTS = {
    "region_name": "WEST", "unit": "ALPHA", "mnt_name": "EXEC", "loan_status": "Active", "ag_date": datetime(2020, 1, 1), "arrears_emi": 0.0, "month_receipt": 10000.0,
    "collection": 10000.0, "demand": 10000.0, "pos": 100000.0, "lcc_pct": 85.0, "strike": "Y", "closing_arrears": 0.0, "month_due_inst": 9500.0, "month_due_exp": 500.0,
    "total_cum_coll": 50000.0, "cum_coll_ie": 50000.0, "cum_due_inst": 9500.0, "cum_due_exp": 500.0, "non_starter": "N", "colending": "N", "no_coll_3m": "N",
    "arr_inst": 0.0, "arr_exp": 0.0, "arr_bc": 0.0, "loan_amount": 200000.0, "last_receipt_date": datetime(2024, 5, 20), "cust_mob_no": "1", "cust_name": "C",
}


def book(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    made = [tuple({**DEFAULTS, "loan_no": f"L{k:03d}", **r}.get(n) for n in names) for k, r in enumerate(rows, 1)]
    return with_soh(with_buckets(spark.createDataFrame(made, SCHEMA)))


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
