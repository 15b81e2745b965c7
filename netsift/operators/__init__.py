"""Operators: functions from DataFrames to DataFrames with keyword parameters."""
