"""Whole timelines, and the queries that exercise each operator."""
