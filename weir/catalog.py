"""Relations by number: a DataFrame and its positional integer columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    id: int
    name: str
    df: DataFrame  # columns c0..cn, all bigint, or all decimal(20,0) if u64
    source_columns: tuple[str, ...]
    u64: bool
    nullable: tuple[bool, ...]
    #: Reads just some columns, within bounds of some, where the source isn't pruned by Spark itself.
    reader: Callable | None = None
    #: Materialised sums by key column (Engine.build_aggregate_index).
    aggregate: dict[int, DataFrame] = field(default_factory=dict)

    def columns(self, wanted: set[int], domains: dict) -> DataFrame:
        return self.reader(sorted(wanted), domains) if self.reader and wanted else self.df

    @property
    def width(self) -> int:
        return len(self.source_columns)


class Catalog:
    """Registers relations; ids are given or follow the order of registration."""

    def __init__(self) -> None:
        self._relations: dict[int, Relation] = {}

    def register(self, df: DataFrame, columns: list[str] | None = None, *, id: int | None = None, name: str | None = None, u64: bool = False, not_null: bool = False, reader: Callable | None = None) -> Relation:
        """columns: the integral columns, by position (all if None). Integral values in other
        numeric types (double quantities) are cast. not_null: the caller vouches that no value
        is null, whatever the schema says (Parquet columns are nullable to Spark)."""
        columns = list(columns or df.columns)
        id = len(self._relations) if id is None else id
        if id in self._relations:
            raise ValueError(f"relation {id} is already registered")
        kinds = {f.name: f for f in df.schema.fields}
        for c in columns:
            if not isinstance(kinds[c].dataType, T.NumericType):
                raise TypeError(f"{c} is {kinds[c].dataType.simpleString()}; relations hold integers")
        to = T.DecimalType(20, 0) if u64 else T.LongType()
        cols = [(F.col(f"`{c}`") if kinds[c].dataType == to else F.col(f"`{c}`").cast(to)).alias(f"c{i}") for i, c in enumerate(columns)]
        r = Relation(id, name or f"r{id}", df.select(*cols), tuple(columns), u64, tuple(not not_null and kinds[c].nullable for c in columns), reader)
        self._relations[id] = r
        return r

    def __getitem__(self, id: int) -> Relation:
        if id not in self._relations:
            raise KeyError(f"relation {id} is not registered")
        return self._relations[id]

    def __iter__(self):
        return iter(self._relations.values())

    def __len__(self) -> int:
        return len(self._relations)
