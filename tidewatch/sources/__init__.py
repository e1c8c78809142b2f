"""Readers of series, labels and topologies, and writers of fitted state and results."""
