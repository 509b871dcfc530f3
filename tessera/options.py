"""Options of a session: immutable values with a module default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    ibm_rounding: bool = False
    quantile_type: int = 7
    precision_cap: Mapping[str, int] | None = None
    custom_summaries: Mapping[str, Any] = field(default_factory=dict)
    scipen: int = 9999


_current = Options()


def current_options() -> Options:
    return _current


def set_options(**changes: Any) -> Options:
    """Change the default options; returns the old ones.  Unknown names are errors."""
    global _current
    known = {f.name for f in fields(Options)}
    if unknown := sorted(set(changes) - known):
        raise ValueError(f"Unknown option(s): {', '.join(unknown)}. Valid options: {', '.join(sorted(known))}")
    if "quantile_type" in changes and changes["quantile_type"] not in range(1, 10):
        raise ValueError("quantile_type must be between 1 and 9")
    old, _current = _current, replace(_current, **changes)
    return old
