"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``queries`` registers the
jobs ``opN_<name>`` that ``__spark_entry__`` offers.
"""
