"""Leakage-safe temporal features, walk-forward evaluation and append-only ledgers on Spark."""
