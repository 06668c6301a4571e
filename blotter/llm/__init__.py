"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Each module holds one operator with a general interface (DataFrames in,
DataFrames out, real outputs such as spans, files and ids); ``queries`` derives
the registered digest columns from them.  Nothing outside this package imports
it.  Conventions common to all operators: only the columns an operator names
are read, by exact name, so further columns never clash; a null text counts as
empty; a null ``doc_id`` never equals another one; empty tables give empty
results with the same columns.
"""
