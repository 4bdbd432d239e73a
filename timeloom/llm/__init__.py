"""Training-data operators: tokens, near duplicates, decontamination, mixing, scoring, search.

Nothing else in the library imports this subpackage.
"""
