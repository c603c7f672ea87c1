"""weir: a Spark-first engine for batches of conjunctive select-join-sum queries."""

from weir.engine import Engine
from weir.spec import Interval, QuerySpec, Ref

__all__ = ["Engine", "Interval", "QuerySpec", "Ref"]
