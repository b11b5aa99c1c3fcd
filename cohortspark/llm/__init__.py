"""Operators for the texts of a training corpus."""
