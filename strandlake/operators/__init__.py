"""Operators of the engine, each a function of DataFrames.

Unless an operator says otherwise: a null key joins nothing and is a group of
its own; null and empty sequences have no k-mers, signs or alignments; repeated
rows count as often as they come; ties go to the smaller key; columns that an
operator does not name are not read; an empty table gives no rows, or, where a
whole table gives one row, that row with zeros and nulls.
"""
