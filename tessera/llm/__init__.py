"""Operators for preparing training data for language models.

Each module holds one operator; `queries` registers the thin contract queries.
Nothing outside this subpackage imports it.
"""
