"""Numerical functions: keyed randomness, tail probabilities, matrices."""
