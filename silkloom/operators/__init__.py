"""Operators on DataFrames: k-mer statistics, similarity joins, graphs, alignment, clustering and reports."""
