"""Sessions: a stream of request lines answered batch by batch."""

from weir.streaming.session import Session, run_script

__all__ = ["Session", "run_script"]
