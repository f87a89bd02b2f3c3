"""Structured Streaming jobs: scoring, alarms, per-system state, windows, drift."""
