"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; the ``opN_*`` queries are thin wrappers kept in ``queries``.
"""
