"""Transcript classification on Spark."""
