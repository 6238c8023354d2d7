"""Operators on the table of nodes: DataFrame in, DataFrame out."""
