"""Batch operators: functions from DataFrames to DataFrames over canonical columns."""
