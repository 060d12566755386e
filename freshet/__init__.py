"""Scenario hazard analytics on Spark."""
