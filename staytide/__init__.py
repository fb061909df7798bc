"""Temporal cohorts from keyed event series, written as Spark DataFrame operators."""
