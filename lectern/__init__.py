"""Spark-native document analytics: scalars, block tables, verdicts, rendering and reports over DataFrames."""
