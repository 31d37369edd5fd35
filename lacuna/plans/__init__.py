"""Whole runs: evaluation, focused fills, and the registered queries."""
