"""Household utility bills on Spark: ingest, history, charts, analysis prompts and reports."""
