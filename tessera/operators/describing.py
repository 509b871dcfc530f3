"""Descriptive layers and layers of the caller's own functions."""

from __future__ import annotations

import warnings
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fmt import FStr, format_column
from tessera.functions.stats import quantile_places
from tessera.operators.counting import Key, Long, denominator_frame, null_safe, order_key, with_denominators
from tessera.plans.context import Context, keyed, message, once, report_errors
from tessera.spec import Layer, classify_by, f_str, formats_of

DEFAULTS = {
    "n": f_str("xxx", "n"),
    "Mean (SD)": f_str("xx.x (xx.xx)", "mean", "sd"),
    "Median": f_str("xx.x", "median"),
    "Q1, Q3": f_str("xx.x, xx.x", "q1", "q3"),
    "Min, Max": f_str("xx, xx", "min", "max"),
    "Missing": f_str("xxx", "missing"),
}


def statistics(value: Column) -> dict[str, Column]:
    """Aggregates of a numeric variable; missing and NaN are dropped, infinite values are kept but for min and max.

    Median and quartiles (type 7) are points of one exact aggregate.
    """
    finite = F.when(F.abs(value) != float("inf"), value)
    points = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q1, median, q3 = (points[k] for k in range(3))
    return {
        "n": F.count(value),
        "n_records": F.count(F.lit(1)),
        "mean": F.avg(value),
        "sd": F.stddev_samp(value),
        "median": median,
        "var": F.var_samp(value),
        "min": F.min(finite),
        "max": F.max(finite),
        "iqr": q3 - q1,
        "q1": q1,
        "q3": q3,
        "missing": F.count_if(value.isNull()),
    }


def clean_number(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def precision_scan(value: Column) -> dict[str, Column]:
    """The most digits before and after the point that values of a group show at seven significant digits."""
    v = F.when(F.abs(value) != float("inf"), value)
    places = F.lit(6) - F.floor(F.log10(F.abs(v))).cast("int")
    scale = F.pow(F.lit(10.0), F.least(F.greatest(places, F.lit(0)), F.lit(15)))
    rounded = F.when(v == 0, 0.0).otherwise(F.round(v * scale) / scale)
    shown = F.regexp_replace(F.format_string("%.15f", rounded), "0+$", "")
    # Digits beyond a double's own precision are noise of the decimal form.
    decimals = F.least(F.length(F.regexp_extract(shown, r"\.(\d*)$", 1)), F.greatest(places, F.lit(0)))
    return {
        "max_int": F.coalesce(F.max(F.length(F.floor(F.abs(v)).cast("bigint").cast("string"))), F.lit(1)),
        "max_dec": F.coalesce(F.max(F.when(v == 0, 0).otherwise(decimals)), F.lit(0)),
    }


def collect_precision(ctx: Context, data: DataFrame, layer: Layer, target: str) -> tuple[DataFrame, list[str]]:
    """Widths by group: given as a frame, or scanned from the data; capped."""
    s = layer.settings
    by = [s.precision_by] if isinstance(s.precision_by, str) else list(s.precision_by or [])
    if s.precision_data is not None:
        given = s.precision_data if isinstance(s.precision_data, DataFrame) else data.sparkSession.createDataFrame(pd.DataFrame(s.precision_data))
        if not {"max_int", "max_dec"} <= set(given.columns):
            raise ValueError("precision_data must contain 'max_int' and 'max_dec' columns")
        if lacking := [v for v in by if v not in given.columns]:
            warnings.warn(f"precision_data has no column {', '.join(lacking)} of precision_by, so all its groups share their widths", stacklevel=3)
        by = [v for v in by if v in given.columns]
        frame = given.select(*[F.col(f"`{v}`").cast("string").alias(f"__p_{v}") for v in by], "max_int", "max_dec")
    else:
        found = precision_scan(clean_number(s.precision_on or target))
        frame = data.groupBy(*[F.col(f"`{v}`").cast("string").alias(f"__p_{v}") for v in by]).agg(*[c.alias(k) for k, c in found.items()])
    cap = s.precision_cap if s.precision_cap is not None else ctx.options.precision_cap
    if cap is not None:
        if not {"int", "dec"} & set(cap):
            warnings.warn("precision_cap has no 'int' or 'dec' name and was ignored", stacklevel=3)
        for key, column in (("int", "max_int"), ("dec", "max_dec")):
            if key in cap:
                frame = frame.withColumn(column, F.least(F.col(column), F.lit(int(cap[key]))))
    return frame, by


def build_desc(ctx: Context, layer: Layer) -> Long:
    """One block of rows for each target: a row for each format, statistics of all formats from one pass."""
    s, cols = layer.settings, list(ctx.cols)
    data = ctx.data.where(layer.where) if layer.where else ctx.data
    by, texts = classify_by(layer.by, ctx.columns)
    c, b = ([f"__{p}{k}" for k in range(1, n + 1)] for p, n in (("c", len(cols)), ("b", len(by))))
    names = dict(zip([*cols, *by], [*c, *b], strict=True))
    data = keyed(keyed(data, cols, "__c"), by, "__b")
    formats = formats_of(layer) or DEFAULTS
    summaries: dict[str, Any] = dict(ctx.options.custom_summaries) | dict(s.custom_summaries or {})
    several = len(layer.target) > 1
    rows, numeric = None, None
    for t, target in enumerate(layer.target):
        value = clean_number(target)
        wanted = statistics(value)
        for name, text in summaries.items():
            if isinstance(text, str):
                wanted[name] = F.expr(text.replace(".var", "__value"))
        frame = data.withColumn("__value", value)
        block = frame.groupBy(*c, *b).agg(*[col.alias(k) for k, col in wanted.items()])
        if ctx.options.quantile_type != 7:
            block = null_safe(block.drop("q1", "q3", "iqr"), quartiles(frame, [*c, *b], ctx.options.quantile_type), [*c, *b])
        calls = {k: f for k, f in summaries.items() if callable(f)}
        if calls:
            found = report_errors(_call_summaries(frame, [*c, *b], calls), f"A summary of '{target}'")
            block = null_safe(block, found, [*c, *b])
        group = [s.denoms_by] if isinstance(s.denoms_by, str) else list(s.denoms_by) if s.denoms_by is not None else cols
        if group:
            block = with_denominators(block, denominator_frame(ctx, layer, data, names, target, True), group, names, None)
            block = block.withColumn("pct", F.when(F.col("total") > 0, F.col("n_records") / F.col("total") * 100))
        widths = None
        if any(g.auto for f in formats.values() for g in f.groups):
            found, keys = collect_precision(ctx, data, layer, target)
            have = [v for v in keys if v in names]
            for v in have:
                block = block.withColumn(f"__p_{v}", F.col(names[v]))
            block = null_safe(block, found.select(*[f"__p_{v}" for v in have], "max_int", "max_dec"), [f"__p_{v}" for v in have]) if have else block.crossJoin(found.select("max_int", "max_dec"))
            if s.precision_data is not None:
                block = once(block)
                lacking = block.where("max_int is null or max_dec is null").select(*have_keys(names, [*cols, *by])).limit(5).collect()
                if lacking:
                    shown_ = ", ".join("/".join("(missing)" if v is None else v for v in r) or "all rows" for r in lacking)
                    warnings.warn(f"precision_data has no widths for some groups, whose cells are blank: {shown_}", stacklevel=3)
            widths = (F.col("max_int"), F.col("max_dec"))
        structs = []
        for k, (name, fmt) in enumerate(formats.items(), 1):
            values = [F.col(v) if v in block.columns else F.lit(None).cast("double") for v in fmt.vars]
            structs.append(F.struct(F.lit(name).alias("__t1"), F.lit(k).alias("__stat"), format_column(fmt, values, widths, options=ctx.options).alias("__f1")))
        long = block.withColumn("__x", F.explode(F.array(*structs))).select(*c, *b, "__x.*")
        long = long.withColumns({"__block": F.lit(t), "__var": F.lit(target)})
        rows = long if rows is None else rows.unionByName(long)
        shown = block.select(
            *[F.col(k).alias(v) for v, k in names.items()],
            *([F.lit(target).alias("variable")] if several else []),
            *[k for k in [*wanted, *calls, "total", "pct"] if k in block.columns],
        )
        numeric = shown if numeric is None else numeric.unionByName(shown)
    rows = rows.withColumns({"__kind": F.lit(0), "__depth": F.lit(1)})
    order = [Key("__block"), Key("__stat")]
    for v, k in zip(by, b, strict=True):
        rows, keys = order_key(ctx, data, rows, v, k)
        order += keys
    labels = [F.lit(x) for x in texts] + ([F.col("__var")] if several else []) + [F.col(x) for x in b] + [F.col("__t1")]
    return Long(rows, ctx.combos, ctx.header, [*b, "__block", "__var", "__stat", "__t1", "__kind", "__depth"], order, labels, [("__f1", "")], numeric, [], by, list(layer.target))


def have_keys(names: dict[str, str], wanted: list[str]) -> list[str]:
    return [names[v] for v in wanted]


def quartiles(frame: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """q1, q3 and iqr of types other than 7, from how often each value occurs: no group is gathered in a row."""
    counts = frame.where(F.col("__value").isNotNull()).groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__value")
    counts = counts.withColumn("__upto", F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = frame.groupBy(*keys).agg(F.count("__value").alias("__size"))
    counts = null_safe(sizes, counts, keys) if keys else sizes.crossJoin(counts)
    points = {name: quantile_places(F.col("__size"), p, kind) for name, p in (("q1", 0.25), ("q3", 0.75))}

    def at(k: Column) -> Column:
        inside = F.least(F.greatest(k, F.lit(1)), F.col("__size"))
        return F.min(F.when(F.col("__upto") >= inside, F.col("__value")))

    sums = [at(j + more).alias(f"__{name}{more}") for name, (j, _) in points.items() for more in (0, 1)]
    found = counts.groupBy(*keys, "__size").agg(*sums)
    for name, (_, step) in points.items():
        low, high = F.col(f"__{name}0"), F.col(f"__{name}1")
        found = found.withColumn(name, F.when(step == 0, low).when(step == 1, high).otherwise(low * (1 - step) + high * step))
    return found.select(*keys, "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def _call_summaries(frame: DataFrame, keys: list[str], calls: dict[str, Any]) -> DataFrame:
    """Python summaries of a group's values; an error gives a null and its text in ``__error``."""
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *[T.StructField(n, T.DoubleType()) for n in calls], T.StructField("__error", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["__value"].dropna()
        out = {k: pdf[k].iloc[0] for k in keys} | {"__error": None}
        for name, fn in calls.items():
            try:
                out[name] = float(fn(values))
            except Exception as e:  # noqa: BLE001  a caller's function
                out[name] = None
                out["__error"] = out["__error"] or f"{name}: {message(e)}"
        return pd.DataFrame([out])[[*keys, *calls, "__error"]]

    return frame.select(*keys, "__value").groupBy(*keys).applyInPandas(run, schema)


def transpose(long: Long, formats: dict[str, FStr], ctx: Context) -> None:
    """Statistics become columns: beside the column levels where there are by variables, else in place of them."""
    stats = list(formats)
    base = long.combos
    if long.by_vars:
        long.rows = long.rows.withColumn(f"__c{len(ctx.cols) + 1}", F.col("__t1"))
        long.combos = [(*x, s) for x in base for s in stats]
        long.header = {(*x, s): n for x, n in long.header.items() for s in stats}
        long.row_keys = [k for k in long.row_keys if k not in ("__stat", "__t1")]
        long.order = [k for k in long.order if k.name != "__stat"]
        long.labels = long.labels[:-1]


def build_analyze(ctx: Context, layer: Layer) -> Long:
    """The caller's function, once for each group of column and by variables."""
    s, cols = layer.settings, list(ctx.cols)
    data = ctx.data.where(layer.where) if layer.where else ctx.data
    by, texts = classify_by(layer.by, ctx.columns)
    c, b = ([f"__{p}{k}" for k in range(1, n + 1)] for p, n in (("c", len(cols)), ("b", len(by))))
    data = keyed(keyed(data, cols, "__c"), by, "__b")
    formats = formats_of(layer)
    fn, targets, keys = layer.analyze_fn, list(layer.target), [*c, *b]
    names = list(dict.fromkeys(v for f in formats.values() for v in f.vars))
    fields = [T.StructField(k, T.StringType()) for k in keys]
    fields += [T.StructField(n, T.DoubleType()) for n in names] if formats else [T.StructField("row_label", T.StringType()), T.StructField("formatted", T.StringType())]
    wanted = [*(names or ["row_label", "formatted"])]
    hidden = [x for x in data.columns if x.startswith("__")]
    fields.append(T.StructField("__error", T.StringType()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, error = {k: pdf[k].iloc[0] for k in keys}, None
        try:
            found = fn(pdf.drop(columns=hidden), targets[0] if len(targets) == 1 else targets)
            found = pd.DataFrame([found]) if isinstance(found, dict) else found
            found = found.assign(**{n: None for n in wanted if n not in found.columns})[wanted]
            if names:
                found = found.astype(float)
        except Exception as e:  # noqa: BLE001  a caller's function
            found, error = pd.DataFrame([dict.fromkeys(wanted)]), message(e)
        return found.assign(**head, __error=error)[[*keys, *wanted, "__error"]]

    # A group is what the caller's function asks for at once, so it has to fit into one task.
    found = (data.withColumn("__one", F.lit(1)) if not keys else data).groupBy(*(keys or ["__one"])).applyInPandas(run, T.StructType(fields))
    found = report_errors(found, f"analyze_fn of '{', '.join(targets)}'")
    if not formats:
        found = found.where(F.col("row_label").isNotNull() | F.col("formatted").isNotNull())
    if formats:
        structs = [
            F.struct(F.lit(n).alias("__t1"), F.lit(k).alias("__stat"), format_column(f, [F.col(v) for v in f.vars], options=ctx.options).alias("__f1"))
            for k, (n, f) in enumerate(formats.items(), 1)
        ]
        rows = found.withColumn("__x", F.explode(F.array(*structs))).select(*keys, "__x.*")
    else:
        rows = found.select(*keys, F.col("row_label").alias("__t1"), F.lit(0).alias("__stat"), F.col("formatted").alias("__f1"))
    rows = rows.withColumns({"__kind": F.lit(0), "__depth": F.lit(1)})
    named = dict(zip([*cols, *by], keys, strict=True))
    numeric = found.select(*[F.col(k).alias(v) for v, k in named.items()], *wanted)
    order = [Key("__stat"), *[Key(k) for k in b], Key("__t1")]
    labels = [F.lit(x) for x in texts] + [F.col(x) for x in b] + [F.col("__t1")]
    return Long(rows, ctx.combos, ctx.header, [*b, "__stat", "__t1", "__kind", "__depth"], order, labels, [("__f1", "")], numeric, [], by, targets)
