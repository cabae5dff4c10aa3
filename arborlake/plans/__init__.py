"""Compositions of the operators over concrete tables."""
