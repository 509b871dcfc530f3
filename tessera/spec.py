"""The specification of a table: plain, frozen, serialisable values."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from tessera.functions.fmt import FStr, f_str  # noqa: F401

ORDER_METHODS = ("byfactor", "byvarn", "bycount", "alphabetical")
CI_METHODS = ("clopper_pearson", "wilson", "wald", "agresti_coull", "jeffreys")
COUNT_STATS = (
    "n pct total distinct_n distinct_pct distinct_total ci_lower ci_upper distinct_ci_lower distinct_ci_upper".split()
)
DESC_STATS = "n n_records mean sd median var min max iqr q1 q3 missing total pct".split()


class Label(str):
    """Text that is a row label even where a column has that name."""


def label(text: str) -> Label:
    return Label(text)


def is_label(x: Any) -> bool:
    return isinstance(x, Label)


@dataclass(frozen=True)
class PopData:
    """The population: its column for each column variable of the spec, and a filter (SQL)."""

    cols: Mapping[str, str] | Sequence[str] = ()
    where: str | None = None

    def mapping(self, cols: Sequence[str]) -> dict[str, str]:
        """Population column: spec column."""
        if isinstance(self.cols, Mapping):
            return {pop: spec for spec, pop in self.cols.items()}
        return {pop: spec for pop, spec in zip(self.cols, cols, strict=False)}


def pop_data(cols: Mapping[str, str] | Sequence[str] = (), where: str | None = None) -> PopData:
    return PopData([cols] if isinstance(cols, str) else cols, where)


def is_pop_data(x: Any) -> bool:
    return isinstance(x, PopData)


@dataclass(frozen=True)
class TotalGroup:
    col_var: str
    label: str = "Total"


@dataclass(frozen=True)
class CustomGroup:
    col_var: str
    groups: Mapping[str, Sequence[str]]


def total_group(col_var: str, label: str = "Total") -> TotalGroup:
    return TotalGroup(col_var, label)


def custom_group(col_var: str, **groups: Sequence[str]) -> CustomGroup:
    if not groups:
        raise ValueError("custom_group needs at least one named group of levels")
    return CustomGroup(col_var, dict(groups))


@dataclass(frozen=True)
class AssocTest:
    """A test of association; omnibus (rows of a by group) or pairwise (2x2 counts of each row against a reference).

    ``columns`` names the columns that an omnibus test reads; no others are sent to it.
    """

    fn: Callable[..., Any]
    format: FStr
    label: str | Sequence[str] | None = None
    reference: str | None = None
    comparisons: Sequence[str] | None = None
    pairwise: bool = False
    total_row: bool = False
    columns: Sequence[str] | None = None


def assoc_test(fn, format=None, label=None, reference=None, comparisons=None, pairwise=None, total_row=False, columns=None) -> AssocTest:
    if not callable(fn):
        raise TypeError("assoc_test: 'fn' must be a function")
    if format is not None and not isinstance(format, FStr):
        raise TypeError("assoc_test: 'format' must be an f_str object")
    if not isinstance(total_row, bool):
        raise TypeError("assoc_test: 'total_row' must be True or False")
    if comparisons is not None and (not comparisons or not all(isinstance(c, str) for c in comparisons)):
        raise TypeError("assoc_test: 'comparisons' must be names of levels")
    if reference is not None and comparisons is not None and reference in comparisons:
        raise ValueError("assoc_test: 'reference' can't be one of 'comparisons'")
    pairwise = (reference is not None or comparisons is not None) if pairwise is None else pairwise
    return AssocTest(fn, format or FStr("x.xxx", ("p",)), label, reference, comparisons, pairwise, total_row, columns)


@dataclass(frozen=True)
class LayerSettings:
    """All settings of a layer; those that don't apply to its type are ignored."""

    format_strings: Mapping[str, FStr] | Sequence[FStr] | None = None
    stat_columns: Mapping[str, FStr] | None = None
    denoms_by: Sequence[Any] | None = None
    shift_denom: str = "total"
    denom_row: bool = False
    denom_row_label: str = "n"
    denom_row_format: FStr | None = None
    denom_where: str | None = None
    denom_ignore: Sequence[str] | None = None
    distinct_by: str | None = None
    total_row: bool = False
    total_row_label: str = "Total"
    total_row_count_missings: bool = True
    missing_count: Mapping[str, Any] | None = None
    missing_subjects: bool = False
    missing_subjects_label: str = "Missing"
    keep_levels: Sequence[str] | None = None
    limit_data_by: Sequence[str] | None = None
    custom_summaries: Mapping[str, Any] | None = None
    stats_as_columns: bool = False
    precision_by: Sequence[str] | None = None
    precision_on: str | None = None
    precision_data: Any = None
    precision_cap: Mapping[str, int] | None = None
    order_count_method: str | Sequence[str] | None = None
    ordering_cols: Sequence[str] | None = None
    result_order_var: str = "n"
    outer_sort_position: str | None = None
    risk_diff: Mapping[str, Any] | None = None
    ci_method: str = "clopper_pearson"
    ci_level: float = 0.95
    assoc_test: AssocTest | None = None
    pct_lt: float | None = None
    pct_gt: float | None = None
    zero_count_display: str = "full"
    name: str | None = None


def layer_settings(**values: Any) -> LayerSettings:
    settings = LayerSettings(**values)
    for name, allowed in (("zero_count_display", ("full", "count_only", "blank")), ("shift_denom", ("total", "column")), ("ci_method", CI_METHODS)):
        if getattr(settings, name) not in allowed:
            raise ValueError(f"{name} must be one of: {', '.join(allowed)}")
    return settings


def _tuple(x: Any) -> tuple:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


@dataclass(frozen=True)
class Layer:
    kind: str
    target: tuple[str, ...]
    by: tuple[str, ...] = ()
    where: str | None = None
    settings: LayerSettings = field(default_factory=LayerSettings)
    analyze_fn: Callable[..., Any] | None = None


def group_count(target, by=None, where=None, settings: LayerSettings | None = None) -> Layer:
    """Counts of the levels of one variable, or of nested variables."""
    return Layer("count", _tuple(target), _tuple(by), where, settings or LayerSettings())


def group_desc(target, by=None, where=None, settings: LayerSettings | None = None) -> Layer:
    """Descriptive statistics of one variable, or of several in blocks."""
    return Layer("desc", _tuple(target), _tuple(by), where, settings or LayerSettings())


def group_shift(target: Mapping[str, str], by=None, where=None, settings: LayerSettings | None = None) -> Layer:
    """Counts of a row variable against a column variable."""
    if not isinstance(target, Mapping) or set(target) != {"row", "column"}:
        raise ValueError("group_shift: target must have the names 'row' and 'column'")
    return Layer("shift", (target["row"], target["column"]), _tuple(by), where, settings or LayerSettings())


def group_analyze(target, by=None, where=None, analyze_fn=None, settings: LayerSettings | None = None) -> Layer:
    """A function of the caller, once for each group."""
    if not callable(analyze_fn):
        raise TypeError("group_analyze: 'analyze_fn' must be a function")
    return Layer("analyze", _tuple(target), _tuple(by), where, settings or LayerSettings(), analyze_fn)


def layers(*items: Layer) -> tuple[Layer, ...]:
    for item in items:
        if not isinstance(item, Layer):
            raise TypeError("layers: all arguments must be layers")
    return items


def is_layer(x: Any) -> bool:
    return isinstance(x, Layer)


@dataclass(frozen=True)
class TableSpec:
    cols: tuple[str, ...] = ()
    where: str | None = None
    pop_data: PopData | None = None
    total_groups: tuple[TotalGroup, ...] = ()
    custom_groups: tuple[CustomGroup, ...] = ()
    layers: tuple[Layer, ...] = ()
    settings: Mapping[str, Any] = field(default_factory=dict)
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __repr__(self) -> str:
        lines = [f"table spec: columns {', '.join(self.cols) or 'none'}"]
        if self.where:
            lines.append(f"  where {self.where}")
        if self.pop_data:
            lines.append(f"  population {self.pop_data}")
        for k, layer in enumerate(self.layers, 1):
            name = f" '{layer.settings.name}'" if layer.settings.name else ""
            lines.append(f"  {k}. {layer.kind}{name}: {' > '.join(layer.target)}" + (f" by {', '.join(layer.by)}" if layer.by else ""))
        return "\n".join(lines)


def table_spec(cols=None, where=None, pop_data=None, total_groups=(), custom_groups=(), layers=(), settings=None, levels=None) -> TableSpec:
    """A table: column variables, filters, population, extra column groups and layers.

    ``levels`` orders and completes the levels of variables; a column's schema metadata may name ``levels`` as well.
    """
    if isinstance(layers, Layer):
        layers = (layers,)
    groups = tuple(total_groups) if not isinstance(total_groups, TotalGroup) else (total_groups,)
    customs = tuple(custom_groups) if not isinstance(custom_groups, CustomGroup) else (custom_groups,)
    return TableSpec(_tuple(cols), where, pop_data, groups, customs, tuple(layers), settings or {}, levels or {})


def is_spec(x: Any) -> bool:
    return isinstance(x, TableSpec)


# --------------------------------------------------------------------------- validation


def formats_of(layer: Layer) -> dict[str, FStr]:
    """The layer's formats by row or column name."""
    found = layer.settings.format_strings
    if found is None:
        return {}
    if isinstance(found, FStr):
        return {"1": found}
    return dict(found) if isinstance(found, Mapping) else {str(k): f for k, f in enumerate(found, 1)}


def validate_spec(spec: Any) -> None:
    """Structural checks that need no data."""
    if not is_spec(spec):
        raise TypeError("'spec' must be a table spec")
    if not all(isinstance(c, str) for c in spec.cols):
        raise TypeError("'cols' must be names of columns")
    if not spec.layers:
        raise ValueError("A spec needs at least one layer")
    named = [tuple(x.settings.stat_columns or ()) for x in spec.layers]
    if any(named):
        if len(set(named)) > 1 or any(x.kind != "count" for x in spec.layers):
            raise ValueError("stat_columns: all layers must be count layers with identical stat_columns names")
    shapes = {"shift" if x.kind == "shift" else "stats" if x.kind == "desc" and x.settings.stats_as_columns else "standard" for x in spec.layers}
    if len(shapes) > 1:
        raise ValueError("Layers with different column layouts (shift, stats_as_columns, standard) can't be mixed in one table")
    for k, layer in enumerate(spec.layers, 1):
        _validate_layer(layer, k, spec)


def _validate_layer(layer: Layer, k: int, spec: TableSpec) -> None:
    s, at = layer.settings, f"Layer {k}: "
    if not layer.target or not all(isinstance(t, str) for t in layer.target):
        raise ValueError(at + "target variables must be names of columns")
    for group in (s.format_strings, s.stat_columns):
        values = [] if group is None else [group] if isinstance(group, FStr) else group.values() if isinstance(group, Mapping) else group
        if not all(isinstance(f, FStr) for f in values):
            raise TypeError(at + "formats must be f_str objects")
    if s.stat_columns is not None:
        names = list(s.stat_columns)
        if not names or not all(names):
            raise ValueError(at + "stat_columns names can't be empty")
        if any(" | " in n or "(N=" in n for n in names):
            raise ValueError(at + "stat_columns names can't contain ' | ' or '(N='")
        if s.format_strings is not None:
            warnings.warn(at + "stat_columns replaces format_strings", stacklevel=4)
    if s.pct_lt is not None and not s.pct_lt > 0:
        raise ValueError(at + "pct_lt must be above 0")
    if s.pct_gt is not None and not s.pct_gt < 100:
        raise ValueError(at + "pct_gt must be below 100")
    if s.outer_sort_position not in (None, "asc", "desc"):
        raise ValueError(at + "outer_sort_position must be 'asc' or 'desc'")
    methods = _tuple(s.order_count_method)
    if any(m not in ORDER_METHODS for m in methods):
        raise ValueError(at + f"order_count_method must be one of: {', '.join(ORDER_METHODS)}")
    if not 0 < s.ci_level < 1:
        raise ValueError(at + "ci_level must be between 0 and 1")
    if s.risk_diff is not None and len(layer.target) > 1 and layer.kind == "count":
        raise ValueError(at + "risk_diff isn't supported for nested count layers")
    if s.denom_row_format is not None and len(s.denom_row_format.groups) != 1:
        raise ValueError(at + "denom_row_format must have exactly one format group")
    if s.assoc_test is not None:
        if not isinstance(s.assoc_test, AssocTest):
            raise TypeError(at + "assoc_test must be an assoc_test object")
        if s.assoc_test.pairwise and (layer.kind != "count" or not spec.cols):
            raise ValueError(at + "a pairwise assoc_test needs a count layer and a column variable")
    if s.missing_count is not None:
        unknown = set(s.missing_count) - {"missing_values", "sort_value", "label", "format", "denom_exclude"}
        if unknown:
            raise ValueError(at + f"unknown missing_count name(s): {', '.join(sorted(unknown))}")
        if not isinstance(s.missing_count.get("denom_exclude", False), bool):
            raise TypeError(at + "missing_count denom_exclude must be True or False")
    known = set(COUNT_STATS) if layer.kind in ("count", "shift") else set(DESC_STATS) | set(s.custom_summaries or ())
    if layer.kind in ("count", "shift", "desc"):
        from tessera.options import current_options

        known |= set(current_options().custom_summaries) if layer.kind == "desc" else set()
        used = [v for f in [*formats_of(layer).values(), *(s.stat_columns or {}).values()] for v in f.vars]
        if odd := sorted({v for v in used if v not in known}):
            warnings.warn(at + f"unknown statistic(s) in a format: {', '.join(odd)}", stacklevel=4)


def classify_by(by: Sequence[str], columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """By entries that are columns of the data, and those that are label texts."""
    data = [b for b in by if not is_label(b) and b in columns]
    return data, [str(b) for b in by if b not in data or is_label(b)]


def validate_data(spec: TableSpec, columns: Sequence[str]) -> None:
    """Columns that the spec names must exist; denominators group by variables of their layer."""
    for c in spec.cols:
        if c not in columns:
            raise ValueError(f"Column variable '{c}' not found in data")
    for k, layer in enumerate(spec.layers, 1):
        for t in layer.target:
            if t not in columns:
                raise ValueError(f"Layer {k}: target variable '{t}' not found in data")
        if layer.settings.distinct_by and layer.settings.distinct_by not in columns:
            raise ValueError(f"Layer {k}: distinct_by variable '{layer.settings.distinct_by}' not found in data")
        data, _ = classify_by(layer.by, columns)
        allowed = {*spec.cols, *data, *(layer.target if layer.kind in ("count", "shift") else ())}
        groups = layer.settings.denoms_by or ()
        flat = [v for g in groups for v in (g if not isinstance(g, str) else (g,))] if not isinstance(groups, str) else [groups]
        if bad := [v for v in flat if v not in allowed]:
            raise ValueError(f"Layer {k}: denoms_by variable(s) not in the layer's grouping variables: {', '.join(bad)}")
