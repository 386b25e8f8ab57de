"""Cleaning, profiling and chart operators: each is a fit (aggregates) and a lazy projection."""
