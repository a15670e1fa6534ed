"""Whole queries and pipelines composed of operators."""
