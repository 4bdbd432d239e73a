"""Forensic event timelines and text pipelines on Spark."""
