"""Workforce and risk analytics as Spark DataFrame operators.

Every operator takes a DataFrame plus column names and gives a DataFrame back;
models are ``pyspark.ml`` pipelines.  See README.md for a tour.
"""
