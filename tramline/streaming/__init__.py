"""Archives checked as they arrive."""
