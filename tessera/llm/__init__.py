"""Operators for preparing large-scale training data.

Each operator module has a general interface (DataFrame in, DataFrame out); ``queries`` holds the
thin ``opN_<name>`` queries over the ``documents`` table and ``sql`` their DuckDB equivalents.
Nothing else in the library imports this subpackage.
"""
