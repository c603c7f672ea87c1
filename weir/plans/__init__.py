"""Logical rewrites, join order, and translation to DataFrame operations."""
