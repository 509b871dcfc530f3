"""Count and shift layers: one grouping-sets aggregate, completion, denominators, special rows."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fmt import FStr, format_column, number_column
from tessera.functions.stats import proportion_ci
from tessera.plans.context import Context, keyed, null_safe, once
from tessera.spec import Layer, LayerSettings, classify_by, f_str, formats_of

DEFAULT = f_str("xx (xx.x%)", "n", "pct")
NORMAL, MISSING, SUBJECTS, TOTAL = 0, 1, 2, 3


class Key(NamedTuple):
    """A column that rows are sorted by."""

    name: str
    ascending: bool = True
    nulls_first: bool = True

    def column(self) -> Column:
        c = F.col(self.name)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


@dataclass
class Long:
    """A layer's cells before the pivot.

    ``rows`` has combo columns ``__c1..``, by columns ``__b1..``, target columns ``__t1..``, ``__kind``, ``__depth``, the
    statistics and ``__f1..`` formatted texts.  ``row_keys`` tell rows apart, ``order`` sorts them.
    """

    rows: DataFrame
    combos: list[tuple[str, ...]]
    header: dict[tuple[str, ...], int]
    row_keys: list[str]
    order: list[Key]
    labels: list[Column]
    formats: list[tuple[str, str]]
    numeric: DataFrame
    ord_columns: list[Column]
    by_vars: list[str]
    targets: list[str]


def distinct_count(name: str) -> Column:
    """Distinct values, a missing one counted once."""
    c = F.col(f"`{name}`")
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))


def is_missing(column: str, settings: LayerSettings) -> Column:
    values = [str(v) for v in _list((settings.missing_count or {}).get("missing_values"))]
    c = F.col(column)
    return c.isNull() | F.coalesce(c.isin(values), F.lit(False)) if values else c.isNull()


def _list(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def nested_denoms(settings: LayerSettings, depth: int, cols: Sequence[str]) -> list[str]:
    found = settings.denoms_by
    if found is None:
        return list(cols)
    if isinstance(found, str):
        return [found]
    if found and not isinstance(found[0], str):
        return list(found[min(depth, len(found)) - 1])
    return list(found)


def denominator_frame(ctx: Context, layer: Layer, data: DataFrame, names: dict[str, str], target: str, use_pop: bool) -> DataFrame:
    """Rows that denominators count: population or data, filtered."""
    s = layer.settings
    frame = ctx.pop if use_pop and ctx.pop is not None else data
    if s.denom_where:
        frame = frame.where(s.denom_where)
    have = [v for v in names if v in frame.columns]
    frame = frame.withColumns({names[v]: F.col(f"`{v}`").cast("string") for v in have})
    if target in have:
        t = F.col(names[target])
        if s.denom_ignore:
            frame = frame.where(~F.coalesce(t.isin([str(x) for x in _list(s.denom_ignore)]), F.lit(False)))
        if (s.missing_count or {}).get("denom_exclude"):
            frame = frame.where(~is_missing(names[target], s))
    elif (s.missing_count or {}).get("denom_exclude"):
        warnings.warn(f"denom_exclude has no effect: the population has no column '{target}'", stacklevel=4)
    return frame


def check_denominators(rows: DataFrame, names: dict[str, str], compared: bool) -> None:
    """Warn of cells that count rows over no denominator, and of comparisons whose count exceeds it."""
    def some(test: str) -> str:
        found = rows.where(test).select(*names.values()).distinct().limit(6).collect()
        shown = ["/".join("(missing)" if v is None else v for v in r) for r in found]
        return ", ".join(shown[:5]) + ", ..." * (len(shown) > 5)

    if cells := some("n > 0 and coalesce(total, 0) = 0"):
        warnings.warn(f"Rows are counted where the denominator is zero or missing: {cells}", stacklevel=4)
    if compared and (cells := some("n > total and total > 0")):
        warnings.warn(f"Counts exceed their denominators, so their risk differences are blank: {cells}", stacklevel=4)


def with_denominators(rows: DataFrame, frame: DataFrame, group: list[str], names: dict[str, str], distinct: str | None, known: dict | None = None, tally: Column | None = None) -> DataFrame:
    """Join total (and distinct_total) of the denominators' groups; a group without rows has none.

    ``known`` keeps the denominators of one frame by their groups, so that each is computed once.
    """
    keys = [names[g] for g in group if names[g] in frame.columns and names[g] in rows.columns]
    denominators = known.get(tuple(keys)) if known is not None else None
    if denominators is None:
        sums = [(F.count(F.lit(1)) if tally is None else tally).alias("total")]
        if distinct and distinct in frame.columns:
            sums.append(distinct_count(distinct).alias("distinct_total"))
        denominators = frame.groupBy(*keys).agg(*sums)
        if known is not None:
            denominators = known[tuple(keys)] = once(denominators)
    return null_safe(rows, denominators, keys) if keys else rows.join(F.broadcast(denominators), F.lit(True), "left")


def percent(n: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(n) / F.col(total) * 100)


def stats(rows: DataFrame, s: LayerSettings, formats: list[FStr]) -> DataFrame:
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pct", percent("n", "total"))
    if "distinct_n" in rows.columns:
        rows = rows.withColumn("distinct_n", F.coalesce("distinct_n", F.lit(0)))
        if "distinct_total" in rows.columns:
            rows = rows.withColumn("distinct_pct", percent("distinct_n", "distinct_total"))
    used = {v for f in formats for v in f.vars}
    for prefix in ("", "distinct_"):
        if {f"{prefix}ci_lower", f"{prefix}ci_upper"} & used and f"{prefix}total" in rows.columns:
            low, high = proportion_ci(F.col(f"{prefix}n"), F.col(f"{prefix}total"), s.ci_method, s.ci_level)
            rows = rows.withColumns({f"{prefix}ci_lower": low * 100, f"{prefix}ci_upper": high * 100})
    return rows


def cell(fmt: FStr, rows: DataFrame, s: LayerSettings, ctx: Context) -> Column:
    """The formatted text of a count cell with percent thresholds and the display of zeros."""
    values = [F.col(v) if v in rows.columns else F.lit(None).cast("double") for v in fmt.vars]
    at = next((k for k, v in enumerate(fmt.vars) if v in ("pct", "distinct_pct")), None)
    text = format_column(fmt, values, lt=s.pct_lt, gt=s.pct_gt, threshold_group=at, options=ctx.options)
    counts = [k for k, v in enumerate(fmt.vars) if v in ("n", "distinct_n")]
    if s.zero_count_display == "full" or not counts:
        return text
    k = counts[0]
    short = F.lit("") if s.zero_count_display == "blank" else number_column(values[k], fmt.groups[k], options=ctx.options)
    return F.when(values[k] == 0, short).otherwise(text)


def combo_grid(rows: DataFrame, combos: list[tuple[str, ...]]) -> DataFrame:
    """Each row under every combination of column levels: an explode of literals, no join."""
    if combos == [()]:
        return rows
    array = F.array(*[F.struct(*[F.lit(v).alias(f"__c{k}") for k, v in enumerate(c, 1)]) for c in combos])
    return rows.withColumn("__x", F.explode(array)).select("*", "__x.*").drop("__x")


def level_frame(ctx: Context, data: DataFrame, var: str, key: str) -> DataFrame:
    """Declared levels of a variable, else those that were seen (nulls are no level)."""
    declared = ctx.levels(var)
    if declared is not None:
        return ctx.source.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in declared])).alias(key))
    return data.select(key).where(F.col(key).isNotNull()).distinct()


def cross(frames: list[DataFrame], spark) -> DataFrame:
    out = spark.range(1).select(F.lit(1).alias("__one"))
    for frame in frames:
        out = out.crossJoin(frame)
    return out


def order_key(ctx: Context, data: DataFrame, rows: DataFrame, var: str, key: str, method: str | None = None) -> tuple[DataFrame, list[Key]]:
    """Sort columns of a variable: declared levels, a numeric companion ``<var>N``, or the text itself."""
    declared = ctx.levels(var)
    if declared is not None and method in (None, "byfactor"):
        name = f"__o{key}"
        rows = rows.withColumn(name, F.array_position(F.array(*[F.lit(x) for x in declared]), F.col(key)))
        return rows, [Key(name), Key(key)]
    number = next((x for x in (f"__v{key}", var + "N") if x in data.columns), None)
    if number and method in (None, "byvarn", "byfactor"):
        name = f"__o{key}"
        companion = data.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.col(f"`{number}`").cast("double")).alias(name))
        rows = rows.join(companion, F.col(key) == F.col("__k"), "left").drop("__k")
        return rows, [Key(name), Key(key)]
    return rows, [Key(key)]


def build_count(ctx: Context, layer: Layer) -> Long:
    s, spark, cols = layer.settings, ctx.source.sparkSession, list(ctx.cols)
    data = ctx.data.where(layer.where) if layer.where else ctx.data
    by, texts = classify_by(layer.by, ctx.columns)
    targets, m = list(layer.target), len(layer.target)
    c, b, t = ([f"__{p}{k}" for k in range(1, n + 1)] for p, n in (("c", len(cols)), ("b", len(by)), ("t", m)))
    names = dict(zip([*cols, *by, *targets], [*c, *b, *t], strict=True))
    data = keyed(keyed(keyed(data, cols, "__c"), by, "__b"), targets, "__t")
    stat_columns = dict(s.stat_columns or {})
    formats = list(stat_columns.values()) or [formats_of(layer).get("n_counts") or next(iter(formats_of(layer).values()), DEFAULT)]
    distinct = s.distinct_by

    # Every depth of nesting and the special rows come from one pass over the data.
    aggregates = [ctx.tally().alias("n")]
    if distinct:
        aggregates.append(distinct_count(distinct).alias("distinct_n"))
    special = s.missing_count is not None or s.total_row
    sets = [[*c, *b, *t[:d]] for d in range(1, m + 1)] + ([[*c, *b]] if special else [])
    keys = [*c, *b, *t]
    if special:
        miss = is_missing(t[0], s)
        aggregates += [ctx.tally(miss).alias("n_missing")]
        if distinct:
            d = F.col(f"`{distinct}`")
            null_once = lambda test: F.coalesce(F.max(F.when(test & d.isNull(), 1).otherwise(0)), F.lit(0))
            aggregates += [
                (F.count_distinct(F.when(miss, d)) + null_once(miss)).alias("distinct_missing"),
                (F.count_distinct(F.when(~miss, d)) + null_once(~miss)).alias("distinct_known"),
            ]
    aggregates += [F.min(F.col(f"`{v}N`").cast("double")).alias(f"__v{names[v]}") for v in dict.fromkeys([*by, *targets]) if v + "N" in data.columns]
    if len(sets) > 1:
        depth = F.lit(m) - sum((F.grouping(x) for x in t), F.lit(0))
        grouped = data.groupingSets([[F.col(x) for x in g] for g in sets], *[F.col(x) for x in keys]).agg(*aggregates, depth.cast("int").alias("__depth"))
    else:
        grouped = data.groupBy(*keys).agg(*aggregates).withColumn("__depth", F.lit(1))
    # Levels, pairs, sort keys and cells all come from this one aggregate; denominators are another.
    grouped = once(grouped)
    seen, known = grouped.where(F.col("__depth") == m), {}
    frame = denominator_frame(ctx, layer, data, names, targets[0], True)
    tally = ctx.tally() if ctx.weight in frame.columns else None

    parts = []
    for d in range(1, m + 1):
        if d == 1:
            by_frames = [level_frame(ctx, seen, v, k) for v, k in zip(by, b, strict=True)]
            grid = cross([*by_frames, level_frame(ctx, seen, targets[0], t[0])], spark).drop("__one")
            if s.limit_data_by:
                some = [names[v] for v in _list(s.limit_data_by) if v in names]
                grid = grid.join(seen.select(*some).distinct(), some, "left_semi")
        else:
            grid = seen.select(*t[:d]).where(" and ".join(f"{x} is not null" for x in t[:d])).distinct()
            if b:
                grid = cross([level_frame(ctx, seen, v, k) for v, k in zip(by, b, strict=True)], spark).drop("__one").crossJoin(grid)
        grid = combo_grid(grid, ctx.combos)
        counts = grouped.where(F.col("__depth") == d).select(*c, *b, *t[:d], "n", *(["distinct_n"] if distinct else []))
        rows = grid.join(counts, [*c, *b, *t[:d]], "left")
        if s.missing_count is not None:
            rows = rows.where(~is_missing(t[0], s))
        rows = with_denominators(rows, frame, nested_denoms(s, d, cols), names, distinct, known, tally)
        if s.keep_levels and d == 1 or s.keep_levels and m > 1:
            rows = rows.where(F.col(t[0]).isin([str(x) for x in _list(s.keep_levels)]))
        rows = rows.withColumns({x: F.lit("").cast("string") for x in t[d:]}).withColumns({"__depth": F.lit(d), "__kind": F.lit(NORMAL)})
        parts.append(rows)

    by_grid = combo_grid(cross([level_frame(ctx, seen, v, k) for v, k in zip(by, b, strict=True)], spark).drop("__one") if by else spark.range(1).select(F.lit(1).alias("__one")), ctx.combos).drop("__one")
    if not by and not cols:
        by_grid = spark.range(1).select(F.lit(1).alias("__one"))

    def special_row(kind: int, text: str, n: Column, dn: Column | None) -> DataFrame:
        own = grouped.where("__depth = 0").select(*c, *b, n.alias("n"), *([dn.alias("distinct_n")] if dn is not None else []))
        rows = by_grid.join(own, [*c, *b], "left") if c or b else own
        group = [g for g in nested_denoms(s, 1, cols) if g not in targets]
        rows = with_denominators(rows, frame, group, names, distinct, known, tally)
        labels = {t[0]: F.lit(text)} | {x: F.lit("") for x in t[1:]}
        return rows.withColumns(labels | {"__depth": F.lit(0), "__kind": F.lit(kind)})

    specials = []
    if s.missing_count is not None:
        specials.append(special_row(MISSING, s.missing_count.get("label", "Missing"), F.col("n_missing"), F.col("distinct_missing") if distinct else None))
    if s.missing_subjects and ctx.pop is not None and m == 1:
        specials.append(_missing_subjects(ctx, s, data, by_grid, c, b, cols, by, names, distinct, t, layer))
    if s.total_row:
        known_only = s.missing_count is not None and not s.total_row_count_missings
        n = F.col("n") - F.col("n_missing") if known_only else F.col("n")
        dn = F.col("distinct_known") if known_only else F.col("distinct_n") if distinct else None
        specials.append(special_row(TOTAL, s.total_row_label, n, dn if distinct else None))

    rows = parts[0]
    for part in parts[1:] + specials:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = stats(rows.drop("__one"), s, formats)
    missing_format = (s.missing_count or {}).get("format")
    for k, fmt in enumerate(formats, 1):
        text = cell(fmt, rows, s, ctx)
        if missing_format is not None:
            text = F.when(F.col("__kind") == MISSING, cell(missing_format, rows, s, ctx)).otherwise(text)
        rows = rows.withColumn(f"__f{k}", text)
    # Denominators of other rows than those counted may lack some of them.
    apart = ctx.pop is not None or s.denom_where or s.denom_ignore or (s.missing_count or {}).get("denom_exclude")
    if apart or "bycount" in _list(s.order_count_method):
        rows = once(rows)
    if apart:
        check_denominators(rows, names, bool(s.risk_diff))

    order: list[Key] = []
    for v, k in zip(by, b, strict=True):
        rows, keys_ = order_key(ctx, seen, rows, v, k)
        order += keys_
    place = (s.missing_count or {}).get("sort_value")
    kind = F.col("__kind").cast("double")
    rows = rows.withColumn("__okind", kind if place is None else F.when(kind == MISSING, float(place)).otherwise(kind))
    order.append(Key("__okind"))
    methods = _list(s.order_count_method)
    for d in range(1, m + 1):
        method = methods[min(d, len(methods)) - 1] if methods else None
        if d > 1:
            rows = rows.withColumn(f"__odepth{d}", F.when(F.col("__depth") >= d, 1).otherwise(0))
            order.append(Key(f"__odepth{d}"))
        rows, keys_ = _target_order(ctx, rows, seen, s, d, method, targets, t, b, c)
        if d == 1 and s.outer_sort_position == "desc":
            keys_ = [Key(k.name, not k.ascending, not k.nulls_first) for k in keys_]
        order += keys_
    labels = [F.lit(x) for x in texts] + [F.col(x) for x in b] + [F.col(x) for x in t]
    numeric = rows if m > 1 else rows.where(F.col("__kind") == NORMAL)
    numeric = _numeric(numeric, cols, by, targets, c, b, t)
    ords = [F.col("__depth")] if m > 1 else []
    row_keys = [*b, *t, "__kind", "__depth"]
    return Long(rows, ctx.combos, ctx.header, row_keys, order, labels, [(f"__f{k}", n) for k, n in enumerate(stat_columns or {"": None}, 1)], numeric, ords, by, targets)


def _numeric(rows: DataFrame, cols, by, targets, c, b, t) -> DataFrame:
    named = [F.col(k).alias(v) for v, k in zip([*cols, *by, *targets], [*c, *b, *t], strict=True)]
    wanted = "n distinct_n total distinct_total pct distinct_pct ci_lower ci_upper distinct_ci_lower distinct_ci_upper".split()
    return rows.select(*named, *[x for x in wanted if x in rows.columns])


def _target_order(ctx: Context, rows: DataFrame, data: DataFrame, s: LayerSettings, d: int, method: str | None, targets, t, b, c) -> tuple[DataFrame, list[Key]]:
    key = t[d - 1]
    if method != "bycount":
        return order_key(ctx, data, rows, targets[d - 1], key, method)
    var = s.result_order_var or "n"
    if var not in rows.columns:
        raise ValueError(f"result_order_var '{var}' is not a statistic of this layer")
    counted = rows.where((F.col("__kind") == NORMAL) & (F.col("__depth") == d))
    if s.ordering_cols:
        wanted, known = [str(x) for x in _list(s.ordering_cols)], ctx.col_levels.get(ctx.cols[0], []) if ctx.cols else []
        lacking = [x for x in wanted if x not in known]
        if len(lacking) == len(wanted):
            raise ValueError(f"ordering_cols: no level of '{ctx.cols[0] if ctx.cols else ''}' matches {', '.join(wanted)}")
        if lacking:
            warnings.warn(f"ordering_cols: level(s) not found: {', '.join(lacking)}", stacklevel=3)
        counted = counted.where(F.col(c[0]).isin(wanted))
    name = f"__n{key}"
    sums = counted.groupBy(*b, *t[:d]).agg(F.sum(var).alias(name))
    rows = null_safe(rows, sums, [*b, *t[:d]])
    return rows, [Key(name, False, d > 1), Key(key)]


def _missing_subjects(ctx, s, data, by_grid, c, b, cols, by, names, distinct, t, layer) -> DataFrame:
    """Subjects of the population without a row in the layer's data; without distinct_by, the difference of row counts."""
    pop = keyed(ctx.pop, cols, "__c")
    shared = [v for v in by if v in ctx.pop.columns]
    pop = pop.withColumns({names[v]: F.col(f"`{v}`").cast("string") for v in shared})
    keys = [*c, *[names[v] for v in shared]]
    if distinct and distinct in ctx.pop.columns:
        have = data.select(*keys, F.col(f"`{distinct}`").alias("__id")).distinct()
        lost = pop.select(*keys, F.col(f"`{distinct}`").alias("__id")).distinct().exceptAll(have)
        found = lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("distinct_n", F.col("n"))
    else:
        a = pop.groupBy(*keys).agg(F.count(F.lit(1)).alias("__p"))
        z = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
        found = null_safe(a, z, keys) if keys else a.crossJoin(z)
        found = found.select(*keys, F.greatest(F.col("__p") - F.coalesce("__d", F.lit(0)), F.lit(0)).alias("n"))
    rows = null_safe(by_grid, found, keys) if keys else found
    group = [g for g in nested_denoms(s, 1, cols) if g not in layer.target]
    rows = with_denominators(rows, denominator_frame(ctx, layer, data, names, layer.target[0], True), group, names, distinct)
    return rows.withColumns({t[0]: F.lit(s.missing_subjects_label), "__depth": F.lit(0), "__kind": F.lit(SUBJECTS)})


def build_shift(ctx: Context, layer: Layer) -> Long:
    s, spark, cols = layer.settings, ctx.source.sparkSession, list(ctx.cols)
    data = ctx.data.where(layer.where) if layer.where else ctx.data
    by, texts = classify_by(layer.by, ctx.columns)
    row_var, col_var = layer.target
    b = [f"__b{k}" for k in range(1, len(by) + 1)]
    every = [*cols, col_var]
    c = [f"__c{k}" for k in range(1, len(every) + 1)]
    names = dict(zip([*every, *by, row_var], [*c, *b, "__t1"], strict=True))
    data = keyed(keyed(data, every, "__c"), by, "__b").withColumn("__t1", F.col(f"`{row_var}`").cast("string"))
    declared = ctx.levels(col_var)
    if declared is None:  # levels become columns, so they are named to the driver: one row each
        declared = sorted(r[0] for r in data.select(c[-1]).where(F.col(c[-1]).isNotNull()).distinct().collect())
    combos = [(*x, y) for x in ctx.combos for y in declared]
    group = list(s.denoms_by) if s.denoms_by is not None and not isinstance(s.denoms_by, str) else [s.denoms_by] if s.denoms_by else [*cols, *by, col_var] if s.shift_denom == "column" else cols
    distinct = s.distinct_by
    aggregates = [ctx.tally().alias("n")] + ([distinct_count(distinct).alias("distinct_n")] if distinct else [])
    counts = data.groupBy(*c, *b, "__t1").agg(*aggregates)
    grid = cross([*[level_frame(ctx, data, v, k) for v, k in zip(by, b, strict=True)], level_frame(ctx, data, row_var, "__t1")], spark).drop("__one")
    rows = combo_grid(grid, combos).join(counts, [*c, *b, "__t1"], "left")
    frame = denominator_frame(ctx, layer, data, names, row_var, False)
    rows = with_denominators(rows, frame, group, names, distinct, tally=ctx.tally())
    formats = [formats_of(layer).get("n_counts") or next(iter(formats_of(layer).values()), DEFAULT)]
    rows = stats(rows, s, formats).withColumns({"__kind": F.lit(1), "__depth": F.lit(1)})
    rows = rows.withColumn("__f1", cell(formats[0], rows, s, ctx))
    numeric = _numeric(rows, every, by, [row_var], c, b, ["__t1"])
    header = {x: ctx.header[x[:-1]] for x in combos if x[:-1] in ctx.header}
    if col_var in group and not by:
        have = [v for v in every if v in group]
        counted = {tuple(r[:-1]): r[-1] for r in frame.groupBy(*[names[v] for v in have]).count().collect()}
        at = [every.index(v) for v in have]
        header = {x: counted.get(tuple(x[k] for k in at), 0) for x in combos}
    if s.denom_row:
        totals = rows.groupBy(*c, *b).agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.max(F.length("__f1")).alias("__w"))
        from tessera.functions.fmt import _justify

        text = format_column(s.denom_row_format, [F.col("total")], options=ctx.options) if s.denom_row_format else _justify(F.col("total").cast("string"), F.col("__w"))
        totals = totals.select(*c, *b, F.lit(s.denom_row_label).alias("__t1"), F.lit(0).alias("__kind"), F.lit(0).alias("__depth"), text.alias("__f1"), "total")
        rows = rows.unionByName(totals, allowMissingColumns=True)
    rows, row_order = order_key(ctx, data, rows, row_var, "__t1")
    order = [Key("__kind"), *row_order]
    for v, k in zip(by, b, strict=True):
        rows, keys = order_key(ctx, data, rows, v, k)
        order += keys
    labels = [F.lit(x) for x in texts] + [F.col(x) for x in b] + [F.col("__t1")]
    return Long(rows, combos, header, [*b, "__t1", "__kind", "__depth"], order, labels, [("__f1", "")], numeric, [], by, [row_var])
