"""lectern: a PySpark-native engine for reference-keyed text corpora."""
