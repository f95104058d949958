"""plans of the scoring engine."""
