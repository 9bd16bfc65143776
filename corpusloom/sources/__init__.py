"""Readers that turn scholarly text formats into DataFrames of the corpus model."""
