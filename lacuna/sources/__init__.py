"""Readers, synthetic series and derived features."""
