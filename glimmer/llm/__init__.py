"""Operators of a training-data pipeline over text and vector tables.

Nothing outside this subpackage imports it.  The queries that apply the
operators to the test tables, and their SQL where SQL can express them, are in
:mod:`glimmer.llm.queries`.
"""
