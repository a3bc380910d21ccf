"""Spark-native sequence similarity: sources, k-mer statistics, similarity joins, clustering and reports on DataFrames."""
