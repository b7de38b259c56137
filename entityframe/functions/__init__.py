"""Scalar functions: Column in, Column out, with the dialect differences as arguments."""
