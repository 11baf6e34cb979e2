"""Training-data operators: ten large-scale text and vector operations.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin contract queries are in :mod:`genoloom.llm.queries`.
"""
