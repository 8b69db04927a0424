"""Whole jobs composed of operators: read, compute, write."""
