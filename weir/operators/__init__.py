"""Operators that stand behind queries and can be used by themselves."""

from weir.operators.aggregates import column_stats, foreign_key_orphans, group_sums, unique_columns
from weir.operators.layout import shared_path, write_bucketed, write_sorted

__all__ = ["column_stats", "foreign_key_orphans", "group_sums", "shared_path", "unique_columns", "write_bucketed", "write_sorted"]
