"""From a cell back to the rows it counts: SQL predicates made from the structured keys of row and column."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators.counting import MISSING, SUBJECTS, TOTAL
from tessera.plans.build import KINDS, BuildResult
from tessera.spec import CustomGroup


@dataclass(frozen=True)
class AntiJoin:
    """Population rows whose keys have no row in the filtered data."""

    on: tuple[str, ...]
    filters: tuple[str, ...]


@dataclass(frozen=True)
class Meta:
    """A cell: the variables it involves and the filters that give its rows."""

    names: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    layer_index: int | None = None
    anti_join: AntiJoin | None = None
    statistic: str | None = None
    kind: str = "normal"

    def __repr__(self) -> str:
        lines = [f"cell of layer {self.layer_index} ({self.kind})", f"  variables: {', '.join(self.names)}"]
        lines += [f"  {f}" for f in self.filters]
        return "\n".join(lines)


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def equals(var: str, value: str | None) -> str:
    return f"`{var}` is null" if value is None else f"cast(`{var}` as string) = {quote(value)}"


def _expand(customs: dict[str, dict[str, list[str]]], name: str, seen: frozenset[str] = frozenset()) -> list[str]:
    out = []
    for value in customs.get(name, [name]) if name not in seen else [name]:
        out += _expand(customs, value, seen | {name}) if value in customs and value != name else [value]
    return out


def column_filters(result: BuildResult, combo: tuple[str, ...]) -> list[str]:
    """Filters of a column: none for a total, membership for a pooled group."""
    spec, out = result.context.spec, []
    for var, value in zip(spec.cols, combo, strict=False):
        if any(t.col_var == var and t.label == value for t in spec.total_groups):
            continue
        customs: dict[str, list[str]] = {}
        for g in spec.custom_groups:
            if isinstance(g, CustomGroup) and g.col_var == var:
                customs |= {k: [str(x) for x in v] for k, v in g.groups.items()}
        if value in customs:
            out.append(f"cast(`{var}` as string) in ({', '.join(quote(x) for x in dict.fromkeys(_expand(customs, value)))})")
        else:
            out.append(equals(var, value))
    return out


def meta_result(result: BuildResult, row_id: str, column: str) -> Meta | None:
    """What a cell is made of; None where there is no such cell."""
    row = _keys(result).where(F.col("row_id") == row_id).first()
    return None if row is None else _cell(result, row, column)


def cell_metadata(result: BuildResult) -> dict[tuple[str, str], Meta]:
    """What every cell is made of, by row id and column, from one read of the table's row keys (a table is for readers).

    Rows of missing subjects are left out, with a warning, where no ``distinct_by`` names a subject.
    """
    out: dict[tuple[str, str], Meta] = {}
    unkeyed = False
    for row in _keys(result).collect():
        plan = result.layers[row["layer"] - 1]
        unkeyed |= plan.layer.kind == "count" and row["kind"] == SUBJECTS and not plan.layer.settings.distinct_by
        for column, _ in plan.columns:
            if (meta := _cell(result, row, column)) is not None:
                out[row["row_id"], column] = meta
    if unkeyed:
        warnings.warn("Rows of missing subjects have no metadata: distinct_by names no subject to look for", stacklevel=2)
    return out


def _keys(result: BuildResult) -> DataFrame:
    if result.keys is None:
        raise ValueError("The table was built without metadata; use build(..., metadata=True)")
    return result.keys


def _cell(result: BuildResult, row: Row, column: str) -> Meta | None:
    plan = result.layers[row["layer"] - 1]
    layer, ctx, spec = plan.layer, result.context, result.context.spec
    names = [n for n, _ in plan.columns]
    if column not in names or not column.startswith("res"):
        return None
    at, width = names.index(column), len(plan.long.formats)
    combo = plan.long.combos[at // width]
    statistic = plan.long.formats[at % width][1] or None
    filters = [f for f in (spec.where, layer.where) if f]
    variables = list(spec.cols)
    columns = column_filters(result, combo)
    if layer.kind == "shift":
        columns.append(equals(layer.target[1], combo[len(spec.cols)]))
    by = [equals(v, x) for v, x in zip(plan.long.by_vars, row["by"], strict=False)]
    own: list[str] = []
    kind = row["kind"]
    if layer.kind in ("count", "shift"):
        missing = layer.settings.missing_count or {}
        values = missing.get("missing_values")
        values = [values] if isinstance(values, str) else list(values or [])
        is_null = f"`{layer.target[0]}` is null"
        if values:
            is_null = f"({is_null} or cast(`{layer.target[0]}` as string) in ({', '.join(quote(str(v)) for v in values)}))"
        if layer.kind == "count" and kind == MISSING:
            own.append(is_null)
        elif layer.kind == "count" and kind == TOTAL:
            if layer.settings.missing_count is not None and not layer.settings.total_row_count_missings:
                own.append(f"not {is_null}")
        elif kind != SUBJECTS and not (layer.kind == "shift" and row["depth"] == 0):
            variables_of_row = layer.target[: row["depth"]] if layer.kind == "count" else layer.target[:1]
            own += [equals(v, x) for v, x in zip(variables_of_row, row["target"], strict=False)]
    own_targets = [row["variable"]] if layer.kind == "desc" and row["variable"] else layer.target
    variables += [*plan.long.by_vars, *own_targets]
    if layer.kind == "count" and kind == SUBJECTS:
        if not layer.settings.distinct_by:
            return None
        of_population = [equals(v, x) for v, x in zip(plan.long.by_vars, row["by"], strict=False) if v in ctx.pop_source.columns]
        return Meta(tuple(variables), tuple([*columns, *of_population]), row["layer"], AntiJoin((layer.settings.distinct_by,), tuple([*filters, *columns, *by])), statistic, KINDS[kind])
    return Meta(tuple(dict.fromkeys(variables)), tuple([*filters, *columns, *by, *own]), row["layer"], None, statistic, KINDS.get(kind, "normal"))


def meta_subset(result: BuildResult, row_id: str, column: str, data: DataFrame | None = None, pop: DataFrame | None = None) -> DataFrame | None:
    """The source rows of a cell, lazily; for missing subjects, the population's rows."""
    meta = meta_result(result, row_id, column)
    if meta is None:
        return None
    source = result.context.source if data is None else data

    def keep(df: DataFrame, filters: tuple[str, ...]) -> DataFrame:
        for f in filters:
            df = df.where(f)
        return df

    if meta.anti_join is None:
        return keep(source, meta.filters)
    population = result.context.pop_source if pop is None else pop
    return keep(population, meta.filters).join(keep(source, meta.anti_join.filters), list(meta.anti_join.on), "left_anti")


