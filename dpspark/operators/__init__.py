"""Operators: DataFrame in, DataFrame out, deterministic unless said otherwise."""
