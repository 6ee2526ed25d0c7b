"""Screening of identity documents at scale, as declarative Spark pipelines."""
