"""Parsers and the operators over events."""
