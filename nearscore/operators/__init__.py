"""operators of the scoring engine."""
