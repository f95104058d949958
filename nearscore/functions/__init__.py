"""functions of the scoring engine."""
