"""Declarative jobs: one source, transforms in order, one sink, as YAML.

Everything a spec names is checked and built before any data is read. Text of
a spec only ever becomes literals and column names, never an expression.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import yaml
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions.values import parse_bool
from quire.operators.transforms import Cast, Clause, Drop, Filter, Rename, Select, Transform
from quire.session import configure
from quire.sinks.tabular import CsvSink, ParquetSink, Sink, TableSink
from quire.sources.tabular import CsvSource, JdbcSource, ParquetSource, Source


class _SpecLoader(yaml.SafeLoader):
    """Scalars stay text, except null; a repeated key is an error."""

    yaml_implicit_resolvers = {
        first: [r for r in resolvers if r[0] == "tag:yaml.org,2002:null"]
        for first, resolvers in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }

    def construct_mapping(self, node, deep=False):
        keys = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)]
        if len(keys) != len(set(keys)):
            raise ValueError(f"repeated key in {sorted(keys)}")
        return super().construct_mapping(node, deep)


# ---- what a spec may hold -------------------------------------------------------
@dataclass(frozen=True)
class Shape:
    """A kind of value: how it is called, which values are of it, what becomes of one."""

    wanted: str
    fits: Callable[[object], bool]
    made: Callable[[object], object]


def _cell(value: object) -> bool:
    return not isinstance(value, (Mapping, list, tuple))


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _all_of(kind: type | tuple, least: int, part: Callable[[object], bool]) -> Callable[[object], bool]:
    """Whether a value is a collection of that kind whose parts (keys and values of a map) all pass."""
    def fits(value: object) -> bool:
        if not isinstance(value, kind) or len(value) < least:
            return False
        return all(map(part, [*value, *value.values()] if isinstance(value, Mapping) else value))

    return fits


def _clause(parts: Mapping) -> Clause:
    return Clause(_text(parts.get("col")), _text(parts.get("op")), parts.get("value"))


TEXT = Shape("a text", _cell, _text)
NAME = Shape("a text that is not empty", lambda v: _cell(v) and _text(v) != "", _text)
FLAG = Shape("true or false", lambda v: _cell(v) and parse_bool(_text(v)) is not None, lambda v: parse_bool(_text(v)))
NAMES = Shape("a list of names", _all_of((list, tuple), 1, _cell), lambda v: [_text(x) for x in v])
PAIRS = Shape("a map of names to texts", _all_of(Mapping, 1, _cell), lambda v: {_text(k): _text(x) for k, x in v.items()})
CLAUSES = Shape("a list of maps", _all_of((list, tuple), 1, lambda x: isinstance(x, Mapping)), lambda v: [_clause(x) for x in v])
PART = Shape("a map with a type", lambda v: isinstance(v, Mapping) and "type" in v, dict)
PARTS = Shape("a list of maps with a type", _all_of((list, tuple), 0, PART.fits), list)

_NEEDED = object()


def checked(what: str, spec: Mapping, keys: Mapping[str, tuple[Shape, object]]) -> dict[str, object]:
    """The named keys of a spec in their final form; an absent or null key has its default, if it has one."""
    found = {}
    for key, (shape, default) in keys.items():
        value = spec.get(key)
        if value is None and default is not _NEEDED:
            found[key] = default
        elif value is not None and shape.fits(value):
            found[key] = shape.made(value)
        else:
            raise ValueError(f"{what}: {key} should be {shape.wanted}, not {value!r}")
    return found


def _needs(shape: Shape) -> tuple[Shape, object]:
    return shape, _NEEDED


_PATH = {"path": _needs(NAME)}
_JDBC = {"query": _needs(NAME)} | {key: (TEXT, "") for key in (
    "connection_string", "connection_string_env", "partition_column", "lower_bound", "upper_bound", "num_partitions")}
_TABLE = _PATH | {"table": (TEXT, "Extract"), "mode": (TEXT, "replace")}


def _type(make: Callable, keys: Mapping[str, tuple[Shape, object]], unused: tuple[str, ...] = ()) -> Callable:
    """Builder of a type from the keys it reads; ``unused`` ones may be given and change nothing."""
    def build(spec: Mapping):
        given = checked(str(spec.get("type")), spec, {**keys, **{key: (TEXT, "") for key in unused}})
        return make(**{key: value for key, value in given.items() if key not in unused})

    return build


# Types a spec may name; API users can add their own, as functions of the spec.
SOURCES: dict[str, Callable[[Mapping], Source]] = {
    "csv": _type(
        CsvSource, _PATH | {"has_header": (FLAG, True), "separator": (TEXT, ","), "multiline": (FLAG, True)},
        unused=("encoding",)),
    "parquet": _type(ParquetSource, _PATH),
    "jdbc": _type(JdbcSource, _JDBC),
    "mssql": _type(JdbcSource, _JDBC),
}
TRANSFORMS: dict[str, Callable[[Mapping], Transform]] = {
    "cast": _type(Cast, {"columns": _needs(PAIRS)}),
    "rename": _type(Rename, {"columns": _needs(PAIRS)}),
    "select": _type(Select, {"columns": _needs(NAMES)}),
    "drop": _type(Drop, {"columns": _needs(NAMES)}),
    "filter": _type(Filter, {"where": _needs(CLAUSES)}),
}
SINKS: dict[str, Callable[[Mapping], Sink]] = {
    "csv": _type(CsvSink, _PATH | {"separator": (TEXT, ",")}),
    "parquet": _type(ParquetSink, _PATH),
    "table": _type(TableSink, _TABLE),
    "hyper": _type(TableSink, _TABLE),  # name of the table sink in existing specs
}
PIPELINE = {"name": _needs(NAME), "source": _needs(PART), "sink": _needs(PART), "transforms": (PARTS, [])}


def _build(registry: Mapping[str, Callable], what: str, spec: Mapping):
    kind = _text(spec["type"])
    if kind not in registry:
        raise ValueError(f"{what}: there is no type {kind!r}, only {', '.join(registry)}")
    return registry[kind](spec)


# ---- the pipeline ---------------------------------------------------------------
@dataclass(frozen=True)
class PipelineResult:
    name: str
    rows_in: int
    rows_out: int
    duration_seconds: float
    columns: list[str]


@dataclass(frozen=True)
class Pipeline:
    name: str
    source: Source
    sink: Sink
    transforms: list[Transform] = field(default_factory=list)

    @classmethod
    def from_yaml(cls, text: str) -> Pipeline:
        """Pipeline of a spec; raises ``ValueError`` for anything wrong with it."""
        try:
            spec = yaml.load(text, Loader=_SpecLoader)  # noqa: S506 - a safe loader
        except yaml.YAMLError as problem:
            raise ValueError(f"not valid YAML: {problem}") from problem
        if not isinstance(spec, Mapping):
            raise ValueError("a pipeline must be a map")
        unknown = set(spec) - set(PIPELINE)
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(map(str, unknown)))}")
        parts = checked("pipeline", spec, PIPELINE)
        return cls(
            parts["name"],
            _build(SOURCES, "source", parts["source"]),
            _build(SINKS, "sink", parts["sink"]),
            [_build(TRANSFORMS, "transform", step) for step in parts["transforms"]],
        )

    @classmethod
    def from_file(cls, path: str) -> Pipeline:
        """Pipeline of a spec file; relative paths in it start at its folder."""
        with open(path, encoding="utf-8") as stream:
            pipeline = cls.from_yaml(stream.read())
        base = os.path.dirname(os.path.abspath(path))
        return replace(
            pipeline, source=_rooted(pipeline.source, base), sink=_rooted(pipeline.sink, base))

    def plan(self, rows: DataFrame) -> DataFrame:
        """The transforms applied, nothing run."""
        return reduce(lambda frame, step: step.apply(frame), self.transforms, rows)

    def run(self, spark: SparkSession) -> PipelineResult:
        """Read, transform and write in one job."""
        configure(spark)
        start = time.monotonic()
        rows = self.source.read(spark)
        before, after = Observation(), Observation()
        if self.source.counts_cheaply:
            # From file footers. Counting inside the job would keep filters from
            # reaching the scan.
            rows_in = rows.count()
        else:
            rows = rows.observe(before, F.count(F.lit(1)).alias("n"))
            rows_in = None
        out = self.plan(rows)
        columns = out.columns
        out = out.observe(after, F.count(F.lit(1)).alias("n"))
        self.sink.write(out)
        rows_out = _observed(after)
        if rows_in is None:
            rows_in = _observed(before)
        # A plan found to be empty before it ran is replaced as a whole, counts
        # included: nothing came out, and what went in has to be counted.
        if rows_in is None:
            rows_in = self.source.read(spark).count()
        return PipelineResult(self.name, rows_in, rows_out or 0, time.monotonic() - start, columns)


def _observed(observation: Observation) -> int | None:
    try:
        return observation.get["n"]
    except (Py4JError, KeyError):
        return None


def validate(text: str) -> Pipeline:
    """Check a spec completely without reading data."""
    return Pipeline.from_yaml(text)


def validate_file(path: str) -> Pipeline:
    return Pipeline.from_file(path)


def _rooted(end, base: str):
    path = getattr(end, "path", "")
    if not path or "://" in path or os.path.isabs(path):
        return end
    return replace(end, path=os.path.join(base, path))
