"""Operators for cleaning and measuring text corpora.

Nothing outside this subpackage imports it.  ``versograph.llm.registry`` lists
the queries that apply each operator to the whole ``documents`` table.
"""
