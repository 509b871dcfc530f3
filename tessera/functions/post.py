"""Post-processing of built tables and their texts, as columns and DataFrames."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ORDER = ("ord_layer_index", "ord_layer_1", "ord_layer_2")
# Fixed value: a format group as it appears in a cell: lead-in, number, and what clings to it.
FORMAT_GROUP = r"[^\s\d]*\s*(\-?\d+(?:\.\d+)?)\S*"
NUMBER = r"-?[0-9]+\.?[0-9]*"


def _orders(df: DataFrame) -> list[str]:
    return [c for c in _ORDER if c in df.columns]


def _labels(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if re.fullmatch(r"rowlabel\d+", c)), key=lambda c: int(c[8:]))


def apply_row_masks(table: DataFrame, row_breaks: bool = False) -> DataFrame:
    """Blank each row label that equals the one above it in its layer; optionally a blank row between layers."""
    orders = _orders(table)
    if not orders:
        return table
    window = Window.partitionBy("ord_layer_index").orderBy(*orders[1:])
    masked = table.withColumns({c: F.when(F.coalesce(F.lag(c).over(window) == F.col(c), F.lit(False)), F.lit("")).otherwise(F.col(c)) for c in _labels(table)})
    if not row_breaks:
        return masked.orderBy(*orders)
    # A break row follows each layer but the last; it has no order columns of its own, so rows are numbered first.
    ends = table.groupBy("ord_layer_index").agg(F.lit(1).alias("__x"))
    last = ends.agg(F.max("ord_layer_index").alias("__last"))
    ends = ends.join(F.broadcast(last), F.col("ord_layer_index") < F.col("__last"))
    blank = ends.select(
        F.col("ord_layer_index").alias("__layer"),
        *[(F.lit("") if t == "string" else F.lit(None).cast(t)).alias(c) for c, t in table.dtypes],
        F.lit(1).alias("__break"),
    )
    masked = masked.withColumns({"__layer": F.col("ord_layer_index"), "__break": F.lit(0)})
    return masked.unionByName(blank).orderBy("__layer", "__break", *orders[1:]).drop("__layer", "__break")


def collapse_row_labels(table: DataFrame, *columns: str, indent: str = "  ", target_col: str = "row_label", nest: bool = False) -> DataFrame:
    """Row labels as one column: a stub row for each new outer label, or (``nest``) indented in place."""
    if not isinstance(indent, str):
        raise TypeError("indent: give the text that a level is indented by")
    names = list(columns) or _labels(table)
    if len(names) < (1 if nest else 2):
        raise ValueError("Only one column was given, so there is nothing to collapse" if not nest else "The table has no rowlabel columns")
    if lacking := [c for c in names if c not in table.columns]:
        raise ValueError(f"The table lacks column(s): {', '.join(lacking)}")
    rest = [c for c in table.columns if c not in names]
    if nest:
        text, depth = F.lit(""), F.lit(0)
        for k, c in enumerate(names):
            value = F.trim(F.coalesce(F.col(c), F.lit("")))
            text, depth = F.when(value != "", value).otherwise(text), F.when(value != "", F.lit(k)).otherwise(depth)
        return table.select(F.concat(F.repeat(F.lit(indent), depth), text).alias(target_col), *rest)
    orders = _orders(table)
    frame = table.withColumn("__row", F.row_number().over(Window.orderBy(*orders)) if orders else F.monotonically_increasing_id())
    outer, last = names[:-1], names[-1]
    frame = frame.withColumn("__first", F.row_number().over(Window.partitionBy(*outer).orderBy("__row")) == 1)
    depth = len(outer)
    rows = [F.struct(F.lit(k).alias("k"), F.concat(F.lit(indent * k), F.coalesce(c, F.lit(""))).alias("text")) for k, c in enumerate(outer)]
    own = F.struct(F.lit(depth).alias("k"), F.concat(F.lit(indent * depth), F.coalesce(last, F.lit(""))).alias("text"))
    frame = frame.withColumn("__x", F.explode(F.when(F.col("__first"), F.array(*rows, own)).otherwise(F.array(own))))
    stub = F.col("__x.k") < depth
    texts = {c for c, t in table.dtypes if t == "string"}
    shown = [F.when(stub, F.lit("" if c in texts else None)).otherwise(F.col(c)).alias(c) for c in rest]
    return frame.select("__row", F.col("__x.k").alias("__k"), F.col("__x.text").alias(target_col), *shown).orderBy("__row", "__k").drop("__row", "__k")


def wrap_text(text: str, width: int = 10, tab_width: int = 5) -> str:
    """Wrap a text to a width with hyphens in long words; its indentation is kept on every line (and counts twice)."""
    text = text.replace("\t", " " * tab_width)
    text = re.sub(rf"(\w{{{width - 1}}})(?=\w)", r"\1- ", text)
    lead = len(text) - len(text.lstrip())
    lines = textwrap.wrap(" ".join(text.split()), max(width - 2 * lead, 1) if lead else width - 1, break_long_words=False, break_on_hyphens=False)
    return "\n".join(" " * lead + line for line in lines)


def str_indent_wrap(x: Column, width: int = 10, tab_width: int = 5) -> Column:
    @F.pandas_udf("string")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wrap_text(t, width, tab_width))

    return wrap(x)


def str_extract_num(x: Column, index: int = 1) -> Column:
    """The n-th number in a text."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(f"({NUMBER})")), F.lit(index)).cast("double")


def replace_leading_whitespace(x: Column, replace_with: str = " ") -> Column:
    bare = F.regexp_replace(x, "^ +", "")
    return F.concat(F.repeat(F.lit(replace_with), (F.length(x) - F.length(bare)).cast("int")), bare)


def apply_conditional_format(string: Column, format_group: int, condition: str, replacement: str, full_string: bool = False) -> Column:
    """Replace a format group (or the whole text) where a condition on its number holds; the condition is SQL on ``x``."""
    if not isinstance(format_group, int) or isinstance(format_group, bool):
        raise TypeError("format_group: give the number of a group, as an int")
    if not isinstance(replacement, str):
        raise TypeError("replacement: give a text")
    if not isinstance(full_string, bool):
        raise TypeError("full_string: give True or False")
    names = set(re.findall(r"[A-Za-z_]\w*", condition)) - {"and", "or", "not", "is", "null", "between", "in", "AND", "OR", "NOT", "IS", "NULL", "BETWEEN", "IN"}
    if names != {"x"}:
        raise ValueError("The condition can't be read: it is an expression of x alone")
    groups = F.regexp_extract_all(string, F.lit(r"[^\s\d]*\s*\-?\d+(?:\.\d+)?\S*"), F.lit(0))
    x = F.try_element_at(F.regexp_extract_all(string, F.lit(FORMAT_GROUP), F.lit(1)), F.lit(format_group)).cast("double")
    holds = F.coalesce(F.element_at(F.transform(F.array(x), lambda v: _condition(condition, v)), 1), F.lit(False))
    if full_string:
        return F.when(holds, F.lit(replacement)).otherwise(string)
    own = F.try_element_at(groups, F.lit(format_group))
    # Groups lie one after another, with only other text between: what is before ends where the earlier groups end.
    pattern = rf"^((?:.*?[^\s\d]*\s*\-?\d+(?:\.\d+)?\S*){{{format_group - 1}}}.*?)([^\s\d]*\s*\-?\d+(?:\.\d+)?\S*)(.*)$"
    left, right = F.regexp_extract(string, pattern, 1), F.regexp_extract(string, pattern, 3)
    pad = F.greatest(F.length(own), F.lit(len(replacement)))
    over = pad - F.length(own)
    swapped = F.concat(F.substring(left, F.lit(1), F.length(left) - over), F.lpad(F.lit(replacement), pad, F.lit(" ")), right)
    return F.when(holds, swapped).otherwise(string)


def _condition(text: str, x: Column) -> Column:
    """A condition over a column: Python's operators, with SQL's words for them."""
    parts = re.split(r"\s+(and|or|AND|OR)\s+", text)
    out = None
    for k in range(0, len(parts), 2):
        m = re.fullmatch(r"\s*\(*\s*x\s*(<=|>=|==|=|!=|<>|<|>)\s*(-?[\d.]+)\s*\)*\s*", parts[k])
        if not m:
            raise ValueError("The condition may only compare x with numbers, joined by and / or")
        number = F.lit(float(m[2]))
        test = {"<": x < number, ">": x > number, "<=": x <= number, ">=": x >= number, "=": x == number, "==": x == number, "!=": x != number, "<>": x != number}[m[1]]
        out = test if out is None else (out & test if parts[k - 1].lower() == "and" else out | test)
    return out


def as_display(table: DataFrame, labels: bool = False) -> DataFrame:
    """Without order columns and row ids; columns optionally named by their labels."""
    out = table.orderBy(*_orders(table)) if _orders(table) else table
    kept = [c for c in table.columns if not c.startswith("ord_") and c != "row_id"]
    if not labels:
        return out.select(*kept)
    named = get_data_labels(table)
    return out.select(*[F.col(f"`{c}`").alias(named.get(c) or c) for c in kept])


def get_data_labels(df: DataFrame) -> dict[str, str | None]:
    """The label of each column, from the schema's metadata."""
    return {f.name: (f.metadata or {}).get("label") for f in df.schema.fields}

