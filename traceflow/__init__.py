"""traceflow: a PySpark-native engine for trace volumes, survey data and text corpora."""
