"""Tabular profiling, learner selection and model benchmarking on Spark DataFrames."""

__version__ = "0.1.0"
