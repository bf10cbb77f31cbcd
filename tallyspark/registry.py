"""Named analyses: a table and parameters in, named result tables out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_CATALOG: dict[str, dict] = {}


@dataclass
class Result:
    """Result tables of one analysis, with plain-text warnings about the input."""

    tables: dict[str, DataFrame]
    warnings: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def analysis(name: str, title: str = "", group: str = "") -> Callable:
    """Register ``f(df, **params) -> Result | DataFrame`` under a name; users extend the engine with it too."""

    def wrap(fn: Callable) -> Callable:
        if name in _CATALOG and _CATALOG[name]["fn"].__module__ != fn.__module__:
            raise ValueError(f"analysis {name!r} is already registered")
        _CATALOG[name] = {"fn": fn, "title": title or name, "group": group}
        return fn

    return wrap


def catalog() -> dict[str, dict]:
    from tallyspark import operators  # noqa: F401  (imports register the built-in analyses)
    from tallyspark.operators import load_all

    load_all()
    return dict(_CATALOG)


def run(name: str, df: DataFrame, params: dict | None = None) -> Result:
    known = catalog()
    if name not in known:
        raise KeyError(f"unknown analysis {name!r}; known: {sorted(known)}")
    out = known[name]["fn"](df, **(params or {}))
    return out if isinstance(out, Result) else Result({name: out})


def run_steps(df: DataFrame, steps: str | Iterable[dict]) -> list[Result]:
    """Replay a list of ``{"analysis": name, "params": {...}}`` steps, given as a list or as JSON text."""
    todo = json.loads(steps) if isinstance(steps, str) else list(steps)
    if isinstance(todo, dict):
        todo = [todo]
    return [run(s["analysis"], df, s.get("params")) for s in todo]
