"""Spark-native corpus analytics: mining, judging and measuring recurring code patterns.

Every operator takes DataFrames and returns a DataFrame.  Nothing here collects
row data to the driver; Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
