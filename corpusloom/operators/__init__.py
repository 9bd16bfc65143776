"""Operators: functions from DataFrames of the corpus model (verses, words, edges, clauses) to DataFrames."""
