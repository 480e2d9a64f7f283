"""Operator library: every function takes DataFrames/Columns and returns a
lazy DataFrame.  Modules follow SURVEY §2 families."""
