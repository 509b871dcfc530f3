"""Declarative summary tables on Spark: a specification becomes lazy DataFrame plans and a formatted table."""

from tessera.functions.fmt import FStr, apply_formats, f_str
from tessera.functions.post import (
    apply_conditional_format,
    apply_row_masks,
    as_display,
    collapse_row_labels,
    get_data_labels,
    replace_leading_whitespace,
    str_extract_num,
    str_indent_wrap,
)
from tessera.functions.stats import fisher_exact_2x2, proportion_ci, proportion_ci_values
from tessera.options import Options, current_options, set_options
from tessera.plans.build import BuildResult, build, generate_row_ids, header_n, numeric_data, stats_data
from tessera.plans.lineage import AntiJoin, Meta, cell_metadata, meta_result, meta_subset
from tessera.sources.ard import from_ard, to_ard
from tessera.sources.serialize import read_spec, register, trust, write_spec
from tessera.spec import (
    AssocTest,
    CustomGroup,
    Label,
    Layer,
    LayerSettings,
    PopData,
    TableSpec,
    TotalGroup,
    assoc_test,
    custom_group,
    group_analyze,
    group_count,
    group_desc,
    group_shift,
    is_label,
    is_layer,
    is_pop_data,
    is_spec,
    label,
    layer_settings,
    layers,
    pop_data,
    table_spec,
    total_group,
)

__all__ = [name for name in dir() if not name.startswith("_")]
