"""A layered build: models in dependency order, each gated by its tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from .quality import Test, run_suite, suite_failed


@dataclass
class Model:
    """``build`` gets the frames of ``refs`` by name; ``tests`` gets the built frame and those."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    refs: tuple[str, ...] = ()
    tests: Callable[[DataFrame, dict[str, DataFrame]], list[Test]] | None = None


@dataclass
class Build:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    summaries: dict[str, DataFrame] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def _wanted(models: dict[str, Model], select: list[str] | None) -> set[str]:
    todo, wanted = list(select or models), set()
    while todo:
        if (name := todo.pop()) in models and name not in wanted:
            wanted.add(name)
            todo += models[name].refs
    return wanted


def build_models(spark: SparkSession, sources: dict[str, DataFrame], models: list[Model], select: list[str] | None = None, schema: str | None = None) -> Build:
    """Build ``select`` (or all) and what they need. A model whose tests fail with severity error is told in
    ``failed``, and what depends on it in ``skipped``. With ``schema``, models are saved as its tables and read back.
    """
    by_name = {m.name: m for m in models}
    if unknown := [r for m in models for r in m.refs if r not in by_name and r not in sources]:
        raise ValueError(f"unknown reference {unknown[0]}")
    wanted, out = _wanted(by_name, select), Build(frames=dict(sources))
    for name in TopologicalSorter({m.name: set(m.refs) & set(by_name) for m in models}).static_order():
        if name not in wanted:
            continue
        model = by_name[name]
        if any(r in out.failed or r in out.skipped for r in model.refs):
            out.skipped.append(name)
            continue
        refs = {r: out.frames[r] for r in model.refs}
        frame = model.build(refs)
        if schema:
            frame.write.mode("overwrite").saveAsTable(f"{schema}.{name}")
            frame = spark.table(f"{schema}.{name}")
        out.frames[name] = frame
        if model.tests:
            out.summaries[name] = run_suite(frame, model.tests(frame, refs))
            if suite_failed(out.summaries[name]):
                out.failed.append(name)
    return out
