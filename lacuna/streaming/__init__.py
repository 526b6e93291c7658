"""Imputation of streams."""
