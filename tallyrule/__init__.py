"""Verified rule-scorecard analytics on Spark."""
