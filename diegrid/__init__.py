"""Spark-native analytics over semiconductor wafer maps.

Tables in, tables out: every public function takes and returns DataFrames.
"""
