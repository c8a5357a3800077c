"""Canonical names of the loan snapshot and what is fixed about it."""

from __future__ import annotations

import re

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

# The 85 headers of the source extracts, in their order.
HEADERS = [
    "SNo", "Loan No", "CHANNEL", "BU", "StateName", "Zone", "RegionName", "Unit",
    "Ag_Date", "SRC Code", "SRC Name", "MNT CODE", "MNT NAME", "Due Dt", "Tenure",
    "Loan Status", "Loan Amount", "Veh ID", "Cust Name", "Guar Name", "Cust Mob No",
    "Guar Mob No", "Segment", "SegmentName", "Make", "Vehicle Description",
    "Year Of Manufacture", "Arrear Opening", "ARREARS OPEN AGAINST INST",
    "ARREARS OPEN AGAINST EXP", "ARREARS OPEN AGAINST BC", "ARREARS OPEN AGAINST PC",
    "OPENING RESERVE COLLECTION", "Month Due-Inst", "Month Due-Exp", "MONTH DUE (BC)",
    "MONTH DUE PC", "Month Receipt Amount", "MONTHCOLL INST", "MONTHCOLL EXP",
    "MONTHCOLL BC", "MONTHCOLL PC", "Month Collection (Excluding Reserve Collection)",
    "Closing Arrears", "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by RE",
    "Cum Due-Inst", "Cum Due-Exp", "CUM DUE (BC)", "Cum Due PC", "Cum Coll (Inst+Exp)",
    "Total Cum Collection", "ARREARS AGAINST INST", "ARREARS AGAINST EXP",
    "ARREARS AGAINST BC", "ARREARS AGAINST PC", "CLOSING RESERVE COLLECTION",
    "Arrears against Inst+Exp", "Uncleared Cheque/Amount Not remitted by RE", "LCC%",
    "Arrears / EMI", "DelinquencyDays", "VehEMI Accrued", "ClosingPC", "POS", "scheme",
    "Non Starter", "Strike", "RCEndors(>90Days)", "RTO / INSURANCE",
    "NET Collection Demand Inst+Exp", "Net Collection Demand Inst+Exp+BC",
    "NET COLLECTION", "NET COLLECTION EXCLUDING RESERVE COLL", "Last Receipt Date",
    "Last Receipt Amount", "ParentLDueDate", "No Coll 3 Months and >6 EMI",
    "NACHStatus", "SaleType", "CoLending_Loans", "CUSTOMER_STATUS", "LGL_FLAG",
    "LGL_DESCRIPTION", "TyreFlag", "FUEL_TYPE",
]

# Headers without which a file is refused.
MANDATORY = [
    "Loan No", "RegionName", "Unit", "Loan Status", "Ag_Date", "Arrears / EMI", "Month Receipt Amount",
    "Month Collection (Excluding Reserve Collection)", "Net Collection Demand Inst+Exp+BC", "POS", "LCC%", "Strike",
    "Closing Arrears", "Month Due-Inst", "Month Due-Exp", "Total Cum Collection",
]

# Other spellings seen in extracts.
ALIASES = {
    "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by": "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by RE",
    "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by R": "UN-CLEARED CHEQUE FOR THE MONTH/Amount Not remitted by RE",
    "Cum Coll (Inst+Exp+BC)": "Cum Coll (Inst+Exp)",
}

#: Shorter names than the rule gives.
SHORT = {
    "RegionName": "region_name", "Due Dt": "due_day", "Arrears / EMI": "arrears_emi", "ARREARS AGAINST INST": "arr_inst", "ARREARS AGAINST EXP": "arr_exp",
    "ARREARS AGAINST BC": "arr_bc", "Net Collection Demand Inst+Exp+BC": "demand", "NET Collection Demand Inst+Exp": "demand_ie",
    "Month Collection (Excluding Reserve Collection)": "collection", "Month Receipt Amount": "month_receipt", "Total Cum Collection": "total_cum_coll",
    "Cum Coll (Inst+Exp)": "cum_coll_ie", "CoLending_Loans": "colending", "No Coll 3 Months and >6 EMI": "no_coll_3m", "NACHStatus": "nach_status",
    "LCC%": "lcc_pct",
}


def canonical(header: str) -> str:
    """The column name of a source header: lower case, runs of other characters as one underscore, % as pct."""
    if header in SHORT:
        return SHORT[header]
    return re.sub(r"[^a-z0-9]+", "_", header.lower().replace("%", "pct")).strip("_")


DATES = [canonical(h) for h in ("Ag_Date", "Last Receipt Date", "ParentLDueDate")]
#: Amounts that flow in a month: missing counts as 0. In all other numbers it stays missing.
FLOWS = [canonical(h) for h in ("Month Receipt Amount", "Month Collection (Excluding Reserve Collection)", "NET COLLECTION", "Cum Coll (Inst+Exp)", "Total Cum Collection")]
TEXTS = [canonical(h) for h in (
    "SNo", "Loan No", "CHANNEL", "BU", "StateName", "Zone", "RegionName", "Unit", "SRC Code", "SRC Name", "MNT CODE", "MNT NAME", "Loan Status", "Veh ID", "Cust Name",
    "Guar Name", "Cust Mob No", "Guar Mob No", "Segment", "SegmentName", "Make", "Vehicle Description", "scheme", "Non Starter", "Strike", "RCEndors(>90Days)",
    "RTO / INSURANCE", "No Coll 3 Months and >6 EMI", "NACHStatus", "SaleType", "CoLending_Loans", "CUSTOMER_STATUS", "LGL_FLAG", "LGL_DESCRIPTION", "TyreFlag", "FUEL_TYPE",
)]
NUMBERS = [c for c in map(canonical, HEADERS) if c not in {*DATES, *TEXTS}]
UPPER = [canonical(h) for h in ("Strike", "Unit")]

BUCKETS = ["STD", "1-30 DPD", "SMA-1", "SMA-2", "NPA", "NA"]
SCORES = {b: k for k, b in enumerate(BUCKETS[:5])}

#: A loaded snapshot: the 85 columns of an extract, missing ones null, and what is derived from them. Further columns of a file follow.
SNAPSHOT = StructType([
    *[StructField(c, TimestampType() if c in DATES else DoubleType() if c in NUMBERS else StringType()) for c in map(canonical, HEADERS)],
    StructField("curr_bucket", StringType()), StructField("curr_score", IntegerType()), StructField("soh", DoubleType()),
])

# Columns of query, alert and priority tables.
QUERY_COLUMNS = [canonical(h) for h in (
    "Loan No", "Zone", "RegionName", "Unit", "Ag_Date", "MNT NAME", "Due Dt", "Tenure", "Loan Status", "Loan Amount", "Veh ID", "Cust Name",
    "Guar Name", "Cust Mob No", "Guar Mob No", "Vehicle Description", "prev_bucket", "curr_bucket", "Month Due-Inst", "Month Due-Exp",
    "MONTH DUE (BC)", "MONTH DUE PC", "Net Collection Demand Inst+Exp+BC", "Month Receipt Amount", "Closing Arrears", "Arrears against Inst+Exp",
    "ARREARS AGAINST INST", "ARREARS AGAINST EXP", "LCC%", "Arrears / EMI", "DelinquencyDays", "VehEMI Accrued", "ClosingPC", "POS", "SOH",
    "Non Starter", "Strike", "Last Receipt Date", "Last Receipt Amount", "ParentLDueDate", "No Coll 3 Months and >6 EMI", "NACHStatus", "TyreFlag", "FUEL_TYPE",
)]
ALERT_COLUMNS = [canonical(h) for h in (
    "Loan No", "Zone", "RegionName", "Unit", "Ag_Date", "MNT NAME", "curr_bucket", "Due Dt", "Tenure", "Loan Status", "Loan Amount", "Veh ID",
    "Cust Name", "Guar Name", "Cust Mob No", "Guar Mob No", "Vehicle Description", "Month Due-Inst", "Month Due-Exp", "MONTH DUE (BC)",
    "MONTH DUE PC", "Month Receipt Amount", "Closing Arrears", "Arrears against Inst+Exp", "ARREARS AGAINST INST", "ARREARS AGAINST EXP", "LCC%",
    "Arrears / EMI", "DelinquencyDays", "VehEMI Accrued", "ClosingPC", "POS", "Non Starter", "Strike", "Last Receipt Date", "Last Receipt Amount",
    "ParentLDueDate", "No Coll 3 Months and >6 EMI", "NACHStatus", "TyreFlag", "FUEL_TYPE",
)]
PRIORITY_COLUMNS = ["priority", *[canonical(h) for h in (
    "Loan No", "Cust Name", "Cust Mob No", "RegionName", "Unit", "MNT NAME", "Ag_Date", "curr_bucket", "Arrears / EMI", "POS",
    "Net Collection Demand Inst+Exp+BC", "Closing Arrears",
)]]
