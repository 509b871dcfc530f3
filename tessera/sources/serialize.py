"""Specifications as JSON or YAML.

Formats, labels, group and test objects carry a type mark; what equals a field's default is left out.  Functions are
written by name, ``module:name`` or as registered.  On reading, a name is looked up in the registry, and in a
module only below the prefixes that the caller trusts (:func:`trust`, or ``modules=``); nothing is evaluated from text.
"""

from __future__ import annotations

import importlib
import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import MISSING, Field, fields
from pathlib import Path
from typing import Any

from tessera.functions.fmt import FStr
from tessera.spec import AssocTest, CustomGroup, Label, Layer, LayerSettings, PopData, TableSpec, TotalGroup

_registry: dict[str, Callable[..., Any]] = {}
_trusted: set[str] = {"tessera.functions"}
_TYPES = {c.__name__: c for c in (TableSpec, Layer, LayerSettings, PopData, TotalGroup, CustomGroup, AssocTest)}


def register(name: str, fn: Callable[..., Any]) -> Callable[..., Any]:
    """Make a function known to specs under a name."""
    _registry[name] = fn
    return fn


def encode(x: Any) -> Any:
    if isinstance(x, FStr):
        return {"_type": "f_str", "format_string": x.format_string, "vars": list(x.vars), "empty": x.empty}
    if isinstance(x, Label):
        return {"_type": "label", "value": str(x)}
    if type(x).__name__ in _TYPES:
        kept = [f.name for f in fields(x) if not _is_default(f, getattr(x, f.name))]
        return {"_type": type(x).__name__} | {name: encode(getattr(x, name)) for name in kept}
    if isinstance(x, Mapping):
        return {str(k): encode(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [encode(v) for v in x]
    if callable(x):
        name = next((k for k, f in _registry.items() if f is x), None)
        if name is None:
            name = f"{x.__module__}:{x.__qualname__}"
            if "<" in name:
                raise ValueError("Functions of a spec must be importable, or registered with register(name, fn)")
            _registry.setdefault(name, x)  # what this process has written, it may read
        return {"_fn": name}
    if hasattr(x, "toPandas"):
        return {"_type": "frame", "rows": [r.asDict() for r in x.collect()]}
    return x


def _is_default(f: Field, value: Any) -> bool:
    if f.default_factory is not MISSING:
        return type(value) is type(f.default_factory()) and value == f.default_factory()
    return f.default is not MISSING and (value is f.default or type(value) is type(f.default) and value == f.default)


def trust(*prefixes: str) -> None:
    """Let specs name functions of these modules and of modules below them."""
    _trusted.update(prefixes)


def _function(name: str) -> Callable[..., Any]:
    if name in _registry:
        return _registry[name]
    module, _, path = name.partition(":")
    if not path or not any(module == p or module.startswith(f"{p}.") for p in _trusted):
        raise ValueError(f"Function '{name}' is neither registered nor of a trusted module")
    found: Any = importlib.import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


def decode(x: Any) -> Any:
    if isinstance(x, list):
        return tuple(decode(v) for v in x)
    if not isinstance(x, dict):
        return x
    if "_fn" in x:
        return _function(x["_fn"])
    kind = x.get("_type")
    if kind == "f_str":
        return FStr(x["format_string"], tuple(x["vars"]), x.get("empty"))
    if kind == "label":
        return Label(x["value"])
    if kind == "frame":
        import pandas as pd

        return pd.DataFrame(x["rows"])
    if kind in _TYPES:
        cls = _TYPES[kind]
        known = {f.name for f in fields(cls)}
        if odd := sorted(set(x) - known - {"_type"}):
            warnings.warn(f"Unknown field(s) of {kind} ignored: {', '.join(odd)}", stacklevel=3)
        return cls(**{k: decode(v) for k, v in x.items() if k in known})
    return {k: decode(v) for k, v in x.items()}


def write_spec(spec: TableSpec, path: str) -> None:
    """Write a spec to .json, .yaml or .yml."""
    data, kind = encode(spec), Path(path).suffix.lower()
    if kind == ".json":
        text = json.dumps(data, indent=2, ensure_ascii=False)
    elif kind in (".yaml", ".yml"):
        text = _yaml().safe_dump(data, sort_keys=False, allow_unicode=True)
    else:
        raise ValueError(f"Unsupported file extension: '{kind}'")
    Path(path).write_text(text)


def read_spec(path: str, modules: Sequence[str] = ()) -> TableSpec:
    """Read a spec from .json, .yaml or .yml; ``modules`` are further prefixes of modules whose functions it may name."""
    trust(*modules)
    kind = Path(path).suffix.lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ValueError(f"Unsupported file extension: '{kind}'")
    text = Path(path).read_text()
    found = decode(json.loads(text) if kind == ".json" else _yaml().safe_load(text))
    if not isinstance(found, TableSpec):
        raise ValueError(f"'{path}' does not hold a table spec")
    return found


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML specs need the 'yaml' package; JSON specs don't") from e
    return yaml
