"""Timelines over arriving files."""
