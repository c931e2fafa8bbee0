"""Operators for preparing training text, run as Spark jobs.

Nothing else in the package imports this subpackage.
"""
