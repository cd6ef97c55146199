"""logfold: log templates, schema mapping and evaluation as Spark table jobs."""
