"""Loan-collection analytics on Spark: monthly snapshots in, KPI, alert, scorecard and migration tables out."""
