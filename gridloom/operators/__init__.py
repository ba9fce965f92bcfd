"""Relational, reshaping, window and table-cleaning operators over DataFrames."""
