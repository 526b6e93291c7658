"""Imputers, hole generators, metrics, missingness tests and preprocessing."""
