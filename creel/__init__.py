"""Field-inventory analytics as PySpark DataFrame operators.

Every operator takes DataFrames and column names. Nothing here knows about a
particular species list, station network or file: those are arguments.
"""
