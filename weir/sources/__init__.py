"""Sources and sinks."""

from weir.sources.binary import read_relation, write_relation

__all__ = ["read_relation", "write_relation"]
