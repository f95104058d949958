"""streaming of the scoring engine."""
