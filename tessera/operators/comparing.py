"""Comparison columns of a layer: risk differences and tests of association."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fmt import FStr, format_column
from tessera.functions.stats import risk_difference
from tessera.operators.counting import NORMAL, TOTAL, Long
from tessera.plans.context import Context, message, originals, report_errors
from tessera.spec import AssocTest, Layer, f_str

RISK = f_str("xx.x (xx.x, xx.x)", "rdiff", "lower", "upper")


def arm(level: str, column: str, kinds: Sequence[int] = (NORMAL,)) -> Column:
    """A statistic of one column level, as an aggregate over a row's cells."""
    return F.max(F.when((F.col("__c1") == level) & F.col("__kind").isin(*kinds), F.col(column)))


def risk_columns(ctx: Context, layer: Layer) -> list[tuple[str, str, Column]]:
    """(name, label, aggregate) of each comparison; the statistics use n and total."""
    config = layer.settings.risk_diff
    if not config or not config.get("comparisons"):
        return []
    if not ctx.cols:
        raise ValueError("risk_diff compares column levels, so the table needs a column variable (cols)")
    fmt: FStr = config.get("format", RISK)
    count, total = ("distinct_n", "distinct_total") if config.get("use_distinct") else ("n", "total")
    out = []
    for k, pair in enumerate(config["comparisons"], 1):
        if len(pair) != 2:
            raise ValueError("Each risk_diff comparison must name a treatment and a reference")
        found = risk_difference(arm(pair[0], count), arm(pair[0], total), arm(pair[1], count), arm(pair[1], total), config.get("ci", 0.95))
        shown = format_column(fmt, [found[v] for v in fmt.vars], options=ctx.options)
        out.append((f"rdiff{k}", f"{pair[0]} vs {pair[1]}", F.when(found["rdiff"].isNotNull(), shown).otherwise("")))
    return out


def render(value: Any, fmt: FStr) -> tuple[str | None, list[float | None], str | None]:
    """A test's result: a text as it is, or numbers for the format; anything else is blank, and an error or missing."""
    none = [None] * len(fmt.groups)
    if isinstance(value, str):
        return value, none, None
    try:
        numbers = [float(v) for v in (value if isinstance(value, Sequence) or hasattr(value, "__iter__") else [value])]
    except (TypeError, ValueError) as e:
        return "", none, message(e)
    if len(numbers) != len(fmt.groups):
        return "", none, f"{len(numbers)} value(s) returned for a format of {len(fmt.groups)}"
    if any(math.isnan(v) for v in numbers):
        return "", none, None
    return None, numbers, None


def attempt(fn: Callable[..., Any], argument: Any, fmt: FStr) -> tuple[Any, ...]:
    """Text, numbers and error of one call."""
    try:
        text, numbers, error = render(fn(argument), fmt)
    except Exception as e:  # noqa: BLE001  a caller's function
        text, numbers, error = "", [None] * len(fmt.groups), message(e)
    return (text, *numbers, error)


def pairwise_columns(ctx: Context, layer: Layer) -> list[tuple[str, str, Column, Column]]:
    """(name, label, aggregate, its error) of each comparison."""
    test: AssocTest = layer.settings.assoc_test
    levels = ctx.col_levels[ctx.cols[0]]
    reference = test.reference or levels[0]
    named = {t.label for t in ctx.spec.total_groups} | {g for c in ctx.spec.custom_groups for g in c.groups}
    others = list(test.comparisons) if test.comparisons else [x for x in levels if x != reference and x not in named]
    count, total = ("distinct_n", "distinct_total") if layer.settings.distinct_by else ("n", "total")
    kinds = (NORMAL, TOTAL) if test.total_row else (NORMAL,)
    fn, fmt = test.fn, test.format
    labels = [test.label] * len(others) if isinstance(test.label, str) else list(test.label) if test.label else [f"{reference} vs {x}" for x in others]
    schema = "text string, " + ", ".join(f"v{k} double" for k in range(len(fmt.groups))) + ", error string"

    @F.pandas_udf(schema)
    def call(a: pd.Series, m: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for w, x, y, z in zip(a, m, b, n, strict=True):
            if any(v is None or pd.isna(v) for v in (x, z)):
                out.append(("", *[None] * len(fmt.groups), None))
                continue
            w, y = (0 if v is None or pd.isna(v) else v for v in (w, y))
            out.append(attempt(fn, [[int(w), int(x - w)], [int(y), int(z - y)]], fmt))
        return pd.DataFrame(out, columns=["text", *[f"v{k}" for k in range(len(fmt.groups))], "error"])

    columns = []
    for k, (other, text) in enumerate(zip(others, labels, strict=True), 1):
        found = call(*[arm(x, y, kinds).cast("double") for x in (reference, other) for y in (count, total)])
        shown = format_column(fmt, [found[f"v{j}"] for j in range(len(fmt.groups))], options=ctx.options)
        columns.append((f"pval{k}", text, F.coalesce(found["text"], shown), found["error"]))
    return columns


def omnibus(ctx: Context, layer: Layer, long: Long) -> tuple[DataFrame, str]:
    """(by columns, pval1) of a function over all original rows of each by group."""
    test: AssocTest = layer.settings.assoc_test
    data = ctx.data.where(layer.where) if layer.where else ctx.data
    keys = [f"__b{k}" for k in range(1, len(long.by_vars) + 1)]
    data = originals(data).withColumns({k: F.col(f"`{v}`").cast("string") for k, v in zip(keys, long.by_vars, strict=True)})
    plain = [c for c in data.columns if not c.startswith("__")]
    if test.columns is not None:
        plain = list(dict.fromkeys(test.columns))
    fn, fmt, width = test.fn, test.format, len(test.format.groups)
    schema = ", ".join([*(f"{k} string" for k in keys), "text string", *(f"v{k} double" for k in range(width)), "__error string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = attempt(fn, pdf[plain], fmt)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *found]], columns=[*keys, "text", *[f"v{k}" for k in range(width)], "__error"])

    # The test gets the columns that it names (all, if it doesn't), and its groups as a whole.
    narrow = data.select(*(f"`{c}`" for c in plain), *keys).withColumn("__one", F.lit(1))
    grouped = report_errors(narrow.groupBy(*(keys or ["__one"])).applyInPandas(run, schema), "A test of association")
    shown = format_column(fmt, [F.col(f"v{k}") for k in range(width)], options=ctx.options)
    label = test.label if isinstance(test.label, str) else "p-value"
    return grouped.select(*keys, F.coalesce("text", shown).alias("pval1")), label


