"""The operators: pure functions from model tables to DataFrames."""
