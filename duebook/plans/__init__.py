"""Declarative queries: filter specs, aggregation specs and multi-step plans."""
