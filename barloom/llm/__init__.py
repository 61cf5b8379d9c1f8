"""Operators of a training-data pipeline: archives, privacy, duplicates, quality, packing.

Nothing else in the package imports this subpackage.  ``queries.py`` registers one query per operator.
"""
