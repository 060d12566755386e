"""Scalar functions: special functions, calendars, seeds."""
