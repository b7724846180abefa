"""Column and row filters, measures, selection, classifiers and tests as Spark plans."""
