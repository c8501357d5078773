"""Operators over tables: trees, intervals, windows, clusters and evaluation."""
