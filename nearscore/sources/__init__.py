"""sources of the scoring engine."""
