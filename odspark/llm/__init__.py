"""Operators for training-data pipelines over text tables.

One module per operator; ``queries.py`` registers them. Nothing else in the
library imports this subpackage.
"""
