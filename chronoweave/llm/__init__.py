"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames;
``queries`` binds them to the driver tables.  Python code runs inside Arrow batches only, on rows
that Spark has partitioned and shuffled.
"""
