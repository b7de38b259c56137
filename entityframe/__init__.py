"""Typed, relation-aware tables that compile to Spark DataFrames."""
