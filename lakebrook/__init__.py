"""lakebrook: a PySpark-native engine for evidence corpora and training-data pipelines."""
