"""Specifications as relational data on Spark."""
