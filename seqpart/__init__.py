"""Homology-aware partitioning and filtering of sequence collections on Spark."""

__version__ = "0.1.0"
