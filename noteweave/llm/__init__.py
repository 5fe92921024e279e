"""Operators of a training-data pipeline, each with its query and, where SQL can say it, its oracle.

Nothing else in the library imports this subpackage.
"""
