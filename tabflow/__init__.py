"""tabflow: interactive tabular data preparation, compiled to Spark plans."""
