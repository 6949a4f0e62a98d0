"""Operators: functions from DataFrame and parameters to DataFrame."""
