"""Results as long data, one row a statistic, and back to a table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.counting import DEFAULT, Key, Long, cell
from tessera.operators.describing import DEFAULTS
from tessera.functions.fmt import format_column
from tessera.options import Options, current_options
from tessera.plans.build import BuildResult, pivot
from tessera.plans.context import Context, keyed
from tessera.spec import TableSpec, classify_by, formats_of, is_spec


def to_ard(result: BuildResult) -> DataFrame:
    """analysis_id, the group columns, stat_name and stat_value of every layer, by unpivots of the raw statistics."""
    out = None
    for k, frame in result.numeric.items():
        groups = [c for c in result.group_cols[k] if c in frame.columns]
        numbers = [f.name for f in frame.schema.fields if f.name not in groups and isinstance(f.dataType, T.NumericType)]
        if not numbers:
            continue
        part = frame.select(*[F.col(g).cast("string").alias(g) for g in groups], *[F.col(n).cast("double").alias(n) for n in numbers])
        part = part.unpivot(groups, numbers, "stat_name", "stat_value").withColumn("analysis_id", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("to_ard() takes the result of build(); this has no statistics")
    middle = [c for c in out.columns if c not in ("analysis_id", "stat_name", "stat_value")]
    return out.select("analysis_id", *middle, "stat_name", "stat_value")


def from_ard(ard: DataFrame, spec: TableSpec, options: Options | None = None) -> DataFrame:
    """The table again: statistics pivoted to columns, then formatted and laid out as a build does.

    Header counts, comparison columns and special rows are not part of long results and are not restored.
    """
    if not is_spec(spec):
        raise TypeError("'spec' must be a table spec")
    if "analysis_id" not in ard.columns:
        raise ValueError("The long results must contain an 'analysis_id' column")
    out = None
    for k, layer in enumerate(spec.layers, 1):
        names = [*spec.cols, *layer.target[: 1 if layer.kind == "count" else 2 if layer.kind == "shift" else 0], "variable"]
        by, _ = classify_by(layer.by, ard.columns)
        groups = [c for c in dict.fromkeys([*names[:-1], *by, "variable"]) if c in ard.columns]
        if len(layer.target) > 1 and layer.kind == "count":
            groups += [t for t in layer.target[1:] if t in ard.columns]
        formats = formats_of(layer) or (DEFAULTS if layer.kind == "desc" else {"n_counts": DEFAULT})
        if layer.settings.stat_columns:
            formats = dict(layer.settings.stat_columns)
        wanted = list(dict.fromkeys(v for f in formats.values() for v in f.vars))
        rows = ard.where(F.col("analysis_id") == k).groupBy(*groups).agg(*[F.max(F.when(F.col("stat_name") == v, F.col("stat_value"))).alias(v) for v in wanted])
        plan = _plan(rows, spec, layer, k, by, formats, options or current_options())
        shown = plan.wide.select(*[c for c in plan.wide.columns if not c.startswith("__")])
        out = shown if out is None else out.unionByName(shown, allowMissingColumns=True)
    texts = sorted((c for c in out.columns if c.startswith(("rowlabel", "res"))), key=lambda c: (c.startswith("res"), len(c), c))
    orders = sorted(c for c in out.columns if c.startswith("ord_"))
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in texts], *orders).orderBy("ord_layer_index", "ord_layer_1")


def _plan(rows: DataFrame, spec: TableSpec, layer, k: int, by: list[str], formats, options: Options):
    cols = [*spec.cols, *([layer.target[1]] if layer.kind == "shift" else [])]
    ctx = Context(replace(spec, cols=tuple(cols)), options, rows, rows, None, None, rows.columns)
    ctx.pin()
    ctx.header = {}
    _, texts = classify_by(layer.by, rows.columns)
    targets = [t for t in (layer.target[:1] if layer.kind == "shift" else layer.target if layer.kind == "count" else ()) if t in rows.columns]
    rows = keyed(keyed(keyed(rows, cols, "__c"), by, "__b"), targets, "__t")
    b, t = [f"__b{j}" for j in range(1, len(by) + 1)], [f"__t{j}" for j in range(1, len(targets) + 1)]
    if layer.kind in ("count", "shift"):
        rows = rows.withColumns({x: F.coalesce(x, F.lit("")) for x in t})
        for j, fmt in enumerate(formats.values() if layer.settings.stat_columns else [next(iter(formats.values()))], 1):
            plain = replace(layer.settings, pct_lt=None, pct_gt=None, zero_count_display="full")
            rows = rows.withColumn(f"__f{j}", cell(fmt, rows, plain, ctx))
        order = [Key(x) for x in ([*b, *t] if layer.kind == "count" else [*t, *b])]
        texts_of = [F.col(x) for x in t]
    else:
        structs = [
            F.struct(F.lit(n).alias("__t1"), F.lit(j).alias("__stat"), format_column(f, [F.col(v) for v in f.vars], options=options).alias("__f1"))
            for j, (n, f) in enumerate(formats.items(), 1)
        ]
        rows = rows.withColumn("__x", F.explode(F.array(*structs))).select("*", "__x.*").drop("__x")
        t, order, texts_of = ["__t1", "__stat"], [Key("__stat"), *[Key(x) for x in b]], [F.col("__t1")]
    names = [(f"__f{j}", n) for j, n in enumerate(layer.settings.stat_columns or {"": None}, 1)]
    labels = [F.lit(x) for x in texts] + [F.col(x) for x in b] + texts_of
    bare = replace(layer, settings=replace(layer.settings, risk_diff=None, assoc_test=None))
    return pivot(ctx, bare, Long(rows, ctx.combos, {}, [*b, *t], order, labels, names, rows, [], by, targets), k)
