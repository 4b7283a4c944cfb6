"""Differentially private analysis of tables on Spark."""
