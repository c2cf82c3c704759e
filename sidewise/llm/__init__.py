"""Operators for large-scale training-data preparation.

Nothing else in the package imports this folder; ``__spark_entry__`` adds its
queries when it can be imported.
"""
