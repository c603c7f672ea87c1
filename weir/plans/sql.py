"""The plain SQL meaning of a spec, without any rewrite: what answers are held against."""

from __future__ import annotations

from weir.catalog import Catalog
from weir.spec import QuerySpec, Ref


def to_sql(spec: QuerySpec, tables: dict[int, tuple[str, tuple[str, ...]]]) -> str:
    """tables: relation id to its name and columns by position."""

    def col(r: Ref) -> str:
        return f"b{r.binding}.{tables[spec.relations[r.binding]][1][r.col]}"

    where = [f"{col(a)} = {col(b)}" for a, b in spec.pairs]
    for r, i in spec.domains:
        where += ([f"{col(r)} >= {i.lo}"] if i.lo is not None else []) + ([f"{col(r)} <= {i.hi}"] if i.hi is not None else [])
    select = ", ".join(f"CAST(SUM(CAST({col(o)} AS BIGINT)) AS BIGINT) AS s{i}" for i, o in enumerate(spec.outputs))
    source = ", ".join(f"{tables[spec.relations[b]][0]} b{b}" for b in spec.bindings)
    return f"SELECT {select} FROM {source}" + (f" WHERE {' AND '.join(where)}" if where else "")


def names(catalog: Catalog) -> dict[int, tuple[str, tuple[str, ...]]]:
    return {r.id: (r.name, r.source_columns) for r in catalog}
