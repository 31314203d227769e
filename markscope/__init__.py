"""Provenance-mark analytics on Spark: inspect, measure and clean marks in texts and files."""
