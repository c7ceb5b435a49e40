"""Structured Streaming jobs (incremental re-runs of the scheduled KPI check)."""
