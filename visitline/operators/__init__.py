"""Cohort, catalog, drift, evaluation and model operators."""
