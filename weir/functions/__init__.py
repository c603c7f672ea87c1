"""Column statistics and unsigned arithmetic."""
