"""The line protocol: relation paths up to ``Done``, then queries; a line starting with ``F``
ends a batch, whose answers are given in the order of its queries, a line each."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import SparkSession

from weir.engine import Engine


class Session:
    def __init__(self, engine: Engine, *, u64: bool = False, parallel: int = 8) -> None:
        self.engine, self.u64, self.parallel = engine, u64, parallel
        self.loading, self.batch = True, []

    def feed(self, line: str) -> list[str] | None:
        """The answers if the line ended a batch."""
        line = line.strip()
        if not line:
            return None
        if self.loading:
            if line == "Done":
                self.loading = False
            else:
                self.engine.load(line, u64=self.u64)
            return None
        if not line.startswith("F"):
            self.batch.append(line)
            return None
        batch, self.batch = self.batch, []
        return self.engine.run_batch(batch, parallel=self.parallel)

    def answers(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            yield from self.feed(line) or ()


def run_script(spark: SparkSession, lines: Iterable[str], out: IO[str] = sys.stdout, *, u64: bool = False) -> Engine:
    """Runs a whole session, answers flushed after each batch."""
    session = Session(Engine(spark), u64=u64)
    for line in lines:
        if answers := session.feed(line):
            out.write("\n".join(answers) + "\n")
            out.flush()
    return session.engine


def main() -> None:
    spark = SparkSession.builder.appName("weir").config("spark.scheduler.mode", "FAIR").getOrCreate()
    source = open(sys.argv[1]) if len(sys.argv) > 1 else sys.stdin
    run_script(spark, source)


if __name__ == "__main__":
    main()
