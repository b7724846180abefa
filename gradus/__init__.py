"""Tabular data preparation, graded-set analytics and corpus operators as Spark plans."""
