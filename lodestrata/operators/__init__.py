"""Operators on DataFrames. They take column names and return DataFrames; nothing is
collected but results whose size does not depend on the number of rows."""
