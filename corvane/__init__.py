"""Spark-first engine for curating, scoring and analysing question/answer
corpora and model-written attempts."""
