"""Data-preparation operators: fit a few parameters with distributed aggregates, apply them as columns."""
