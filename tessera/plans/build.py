"""From a specification and data to a table: lazy plans behind one small action that pins the columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.comparing import omnibus, pairwise_columns, risk_columns
from tessera.operators.counting import MISSING, NORMAL, SUBJECTS, TOTAL, Long, build_count, build_shift
from tessera.operators.describing import DEFAULTS, build_analyze, build_desc, transpose
from tessera.options import Options, current_options
from tessera.plans.context import Context, add_groups, report_errors
from tessera.spec import Layer, PopData, TableSpec, formats_of, validate_data, validate_spec

KINDS = {NORMAL: "normal", MISSING: "missing", SUBJECTS: "missing_subjects", TOTAL: "total"}


@dataclass
class LayerPlan:
    layer: Layer
    long: Long
    wide: DataFrame
    columns: list[tuple[str, str]]


@dataclass
class BuildResult:
    """A built table and what stands behind it; all frames are lazy."""

    table: DataFrame
    numeric: dict[int, DataFrame]
    group_cols: dict[int, list[str]]
    header_n: list[tuple[tuple[str, ...], int]] | None
    labels: dict[str, str]
    context: Context
    layers: list[LayerPlan] = field(repr=False, default_factory=list)
    keys: DataFrame | None = field(repr=False, default=None)


def apply_overrides(spec: TableSpec, overrides: Mapping[str, Any]) -> TableSpec:
    """A copy of the spec with a new where, cols or pop_data; pop_data's fields are merged."""
    if unknown := sorted(set(overrides) - {"where", "cols", "pop_data"}):
        raise TypeError(f"Unknown build override(s): {', '.join(unknown)}")
    changes = dict(overrides)
    if "cols" in changes:
        changes["cols"] = (changes["cols"],) if isinstance(changes["cols"], str) else tuple(changes["cols"])
    if "pop_data" in changes:
        given = changes["pop_data"]
        if isinstance(given, Mapping):
            if odd := sorted(set(given) - {"cols", "where"}):
                raise TypeError(f"Unknown pop_data override(s): {', '.join(odd)}")
            changes["pop_data"] = replace(spec.pop_data or PopData(), **given)
    return replace(spec, **changes)


def plan_layer(ctx: Context, layer: Layer) -> Long:
    if layer.kind == "count":
        return build_count(ctx, layer)
    if layer.kind == "shift":
        return build_shift(ctx, layer)
    if layer.kind == "analyze":
        return build_analyze(ctx, layer)
    long = build_desc(ctx, layer)
    if layer.settings.stats_as_columns:
        transpose(long, formats_of(layer) or DEFAULTS, ctx)
    return long


def pivot(ctx: Context, layer: Layer, long: Long, index: int) -> LayerPlan:
    """One row for each row identity; every column is a conditional aggregate over pinned combinations."""
    aggregates, columns, k = [], [], 1
    for combo, text in zip(long.combos, ctx.labels(long.combos, long.header), strict=True):
        inside = F.lit(True)
        for j, level in enumerate(combo, 1):
            inside = inside & (F.col(f"__c{j}") == level)
        for source, name in long.formats:
            aggregates.append(F.coalesce(F.max(F.when(inside, F.col(source))), F.lit("")).alias(f"res{k}"))
            columns.append((f"res{k}", f"{text} | {name}" if name else text))
            k += 1
    s = layer.settings
    if layer.kind == "count" and s.risk_diff:
        for name, text, aggregate in risk_columns(ctx, layer):
            aggregates.append(aggregate.alias(name))
            columns.append((name, text))
    if layer.kind == "count" and s.assoc_test is not None and s.assoc_test.pairwise:
        for name, text, aggregate, error in pairwise_columns(ctx, layer):
            aggregates += [aggregate.alias(name), error.alias(f"__error_{name}")]
            columns.append((name, text))
    kept = list(dict.fromkeys([*long.row_keys, *(key.name for key in long.order)]))
    wide = long.rows.groupBy(*kept).agg(*aggregates)
    if errors := [x for x in wide.columns if x.startswith("__error_")]:
        wide = report_errors(wide.withColumn("__error", F.coalesce(*errors)).drop(*errors), "A pairwise test")
    # The final table is one for readers: its rows are numbered in one order.
    place = F.row_number().over(Window.orderBy(*[key.column() for key in long.order]))
    wide = wide.withColumn("ord_layer_1", place.cast("int"))
    for j, extra in enumerate(long.ord_columns, 2):
        wide = wide.withColumn(f"ord_layer_{j}", extra.cast("int"))
    if s.assoc_test is not None and not s.assoc_test.pairwise:
        found, text = omnibus(ctx, layer, long)
        by = [f"__b{j}" for j in range(1, len(long.by_vars) + 1)]
        first = F.row_number().over(Window.partitionBy(*by).orderBy("ord_layer_1")) == 1
        if by:
            wide = wide.withColumn("__first", first).join(found.withColumnsRenamed({b: f"__r{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"__r{b}")) for b in by], "left")
        else:
            wide = wide.withColumn("__first", F.col("ord_layer_1") == 1).join(F.broadcast(found), F.lit(True), "left")
        wide = wide.withColumn("pval1", F.when(F.col("__first"), F.coalesce("pval1", F.lit(""))).otherwise(""))
        columns.append(("pval1", text))
    wide = wide.withColumns({f"rowlabel{j}": c for j, c in enumerate(long.labels, 1)}).withColumn("ord_layer_index", F.lit(index))
    return LayerPlan(layer, long, wide, columns)


def transposed(ctx: Context, plan: LayerPlan) -> LayerPlan:
    """Without by variables, arms become rows and statistics columns named by the formats."""
    long, names = plan.long, list(formats_of(plan.layer) or DEFAULTS)
    arms = list(zip(long.combos, ctx.labels(long.combos, long.header), strict=True))
    cells = F.array(*[F.struct(F.lit(t).alias("label"), F.lit(k).alias("ord"), F.col(f"res{k}").alias("cell")) for k, (_, t) in enumerate(arms, 1)])
    wide = plan.wide.select("__t1", F.explode(cells).alias("__x")).groupBy(F.col("__x.label").alias("__arm"), F.col("__x.ord").alias("ord_layer_1"))
    wide = wide.agg(*[F.max(F.when(F.col("__t1") == n, F.col("__x.cell"))).alias(n) for n in names])
    texts = [c for c in long.labels[: len(long.labels) - 1]]
    labels = [*texts, F.col("__arm")]
    wide = wide.withColumns({f"rowlabel{j}": c for j, c in enumerate(labels, 1)}).withColumn("ord_layer_index", F.lit(1))
    return LayerPlan(plan.layer, replace(long, labels=labels, row_keys=[]), wide, [(n, n) for n in names])


def build(spec: TableSpec | str, data: DataFrame, pop_data: DataFrame | None = None, metadata: bool = False, options: Options | None = None, weight: str | None = None, **overrides: Any) -> BuildResult:
    """Build a table.  ``spec`` may be a path; ``where=``, ``cols=`` and ``pop_config={"cols", "where"}`` override parts of it.

    ``metadata=True`` adds ``row_id`` and lets cells be traced to source rows.  ``weight`` names a column that tells how often
    a row counts, for tables of count and shift layers.
    """
    if isinstance(spec, str):
        from tessera.sources.serialize import read_spec

        spec = read_spec(spec)
    if "pop_config" in overrides:
        overrides["pop_data"] = overrides.pop("pop_config")
    spec = apply_overrides(spec, overrides) if overrides else spec
    validate_spec(spec)
    columns = list(data.columns)
    validate_data(spec, columns)
    if weight is not None:
        if weight not in columns:
            raise ValueError(f"There is no weight column '{weight}'")
        if any(layer.kind not in ("count", "shift") for layer in spec.layers):
            raise ValueError("A weight column is for count and shift layers only")
    source = data
    if spec.where:
        data = data.where(spec.where)
    pop = pop_source = None
    if pop_data is not None:
        pop = pop_data
        if spec.pop_data is not None:
            if spec.pop_data.where:
                pop = pop.where(spec.pop_data.where)
            pop = pop.withColumnsRenamed({a: b for a, b in spec.pop_data.mapping(spec.cols).items() if a != b})
        pop_source = pop
        pop = add_groups(pop, [g for g in spec.custom_groups if g.col_var in pop.columns], [g for g in spec.total_groups if g.col_var in pop.columns])
        if lacking := [c for c in spec.cols if c not in pop.columns]:
            raise ValueError(f"Population data lacks column variable(s): {', '.join(lacking)}")
    data = add_groups(data, spec.custom_groups, spec.total_groups)
    ctx = Context(spec, options or current_options(), source, data, pop, pop_source, columns, weight=weight)
    ctx.pin()
    plans = []
    for k, layer in enumerate(spec.layers, 1):
        plan = pivot(ctx, layer, plan_layer(ctx, layer), k)
        if layer.kind == "desc" and layer.settings.stats_as_columns and not plan.long.by_vars:
            plan = transposed(ctx, plan)
        plans.append(plan)
    labels: dict[str, str] = {}
    for plan in plans:
        for name, text in plan.columns:
            labels.setdefault(name, text)
    n_labels = max(len(p.long.labels) for p in plans)
    text_columns = [f"rowlabel{j}" for j in range(1, n_labels + 1)] + _sorted(labels)
    orders = ["ord_layer_index", "ord_layer_1"] + (["ord_layer_2"] if any(p.long.ord_columns for p in plans) else [])
    parts, keys = [], None
    for plan in plans:
        have = set(plan.wide.columns)
        shown = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in text_columns]
        shown += [F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in orders]
        parts.append(plan.wide.select(*shown))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    if metadata:
        table = table.withColumn("row_id", F.concat_ws("_", F.col("ord_layer_index").cast("string"), *[F.trim(f"rowlabel{j}") for j in range(1, n_labels + 1)]))
        keys = _row_keys(plans, n_labels)
        if bare := [str(k) for k, p in enumerate(plans, 1) if p.layer.kind == "desc" and p.layer.settings.stats_as_columns and not p.long.by_vars]:
            warnings.warn(f"Cells of layer(s) {', '.join(bare)} have no metadata: their columns are statistics; a by variable would change that", stacklevel=2)
    table = table.select(*[F.col(f"`{c}`").alias(c, metadata={"label": labels[c]}) if c in labels else F.col(f"`{c}`") for c in table.columns]).orderBy(*orders)
    header = sorted(ctx.header.items(), key=lambda kv: ctx.combos.index(kv[0])) if pop_data is not None else None
    numeric = {k: p.long.numeric for k, p in enumerate(plans, 1)}
    groups = {k: [c for c in n.columns if c in (*spec.cols, *p.long.by_vars, *(p.layer.target if p.layer.kind in ("count", "shift") else ()), "variable")] for (k, n), p in zip(numeric.items(), plans, strict=True)}
    return BuildResult(table, numeric, groups, header, labels, ctx, plans, keys)


def _sorted(labels: Mapping[str, str]) -> list[str]:
    """res10 after res9; statistics of a transposed table as they come."""

    def rank(name: str) -> tuple:
        head = name.rstrip("0123456789")
        return (("res", "rdiff", "pval").index(head), int(name[len(head) :])) if head in ("res", "rdiff", "pval") and name != head else (-1, 0)

    return sorted(labels, key=rank)


def _row_keys(plans: list[LayerPlan], n_labels: int) -> DataFrame:
    """For each row_id: its layer, its kind, and the values of its by and target variables."""
    out = None
    for k, plan in enumerate(plans, 1):
        have = set(plan.wide.columns)
        by = [f"__b{j}" for j in range(1, len(plan.long.by_vars) + 1) if f"__b{j}" in have]
        targets = [f"__t{j}" for j in range(1, len(plan.layer.target) + 1) if f"__t{j}" in have]
        part = plan.wide.select(
            F.concat_ws("_", F.col("ord_layer_index").cast("string"), *[F.trim(f"rowlabel{j}") if f"rowlabel{j}" in have else F.lit("") for j in range(1, n_labels + 1)]).alias("row_id"),
            F.lit(k).alias("layer"),
            (F.col("__kind") if "__kind" in have else F.lit(0)).cast("int").alias("kind"),
            (F.col("__depth") if "__depth" in have else F.lit(1)).cast("int").alias("depth"),
            F.array(*[F.col(b) for b in by]).cast("array<string>").alias("by"),
            F.array(*[F.col(t) for t in targets]).cast("array<string>").alias("target"),
            (F.col("__var") if "__var" in have else F.lit(None).cast("string")).alias("variable"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def header_n(result: BuildResult) -> list[tuple[tuple[str, ...], int]] | None:
    """Population counts of the columns, or None without a population."""
    return result.header_n


def numeric_data(result: BuildResult, layer: int | None = None) -> DataFrame | dict[int, DataFrame]:
    """Raw statistics of one layer, or of all."""
    if layer is None:
        return result.numeric
    if layer not in result.numeric:
        raise KeyError(f"There is no layer {layer}")
    return result.numeric[layer]


def stats_data(result: BuildResult, layer: int, statistic: str) -> DataFrame | None:
    """Group columns and one statistic; None where the layer hasn't got it."""
    frame = numeric_data(result, layer)
    return frame.select(*result.group_cols[layer], statistic) if statistic in frame.columns else None


def generate_row_ids(table: DataFrame) -> DataFrame:
    """The table with ``row_id``: layer index and row labels; a warning where two rows share one."""
    labels = [c for c in table.columns if c.startswith("rowlabel")]
    out = table.withColumn("row_id", F.concat_ws("_", F.col("ord_layer_index").cast("string"), *[F.trim(F.col(c)) for c in labels]))
    if not out.groupBy("row_id").count().where("count > 1").isEmpty():
        warnings.warn("Row labels do not tell all rows apart: some row_ids are shared", stacklevel=2)
    return out
