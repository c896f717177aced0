"""Rules, their registry, and the job that runs them over an estate.

A rule states conditions on one child row (``row_rule``: a connection, a field
or the workbook itself), on the rows of a fold over a workbook's own arrays
(``fold_rule``), or builds its own frame (``set_rule``). All row and fold rules
share one scan of the estate: each workbook yields the rows of all kinds the
chosen rules look at in one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schema
from quire.plans.audit.config import GovernanceConfig
from quire.sources.workbooks import readable

SEVERITIES = ("info", "warn", "error")  # in rising order


@dataclass(frozen=True)
class RuleMeta:
    id: str
    title: str
    severity: str
    description: str
    pack: str | None = None


@dataclass(frozen=True)
class Hit:
    """One way a row can violate a rule, as expressions over that row."""

    when: Column
    message: Column
    location: Column
    remediation: str | None = None
    properties: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """``hits`` for a row rule on ``grain`` or over the rows of a ``fold``, or ``frame`` for a set rule.

    A row rule names the child columns it reads, and may derive a column from
    them that its hits use more than once. A fold takes the workbook rows and a name and adds an array of structs under
    that name. A set rule returns ``workbook_path, message, location, remediation,
    properties``; the columns that tell the rule are added to it.
    """

    meta: RuleMeta
    grain: str | None = None
    columns: Sequence[str] = ()
    hits: Callable[[GovernanceConfig], Sequence[Hit]] | None = None
    derive: Callable[[GovernanceConfig], Mapping[str, Column]] | None = None
    frame: Callable[[DataFrame, GovernanceConfig], DataFrame] | None = None
    fold: Callable[[DataFrame, str], DataFrame] | None = None


def row_rule(
    meta: RuleMeta, grain: str, columns: Sequence[str],
    hits: Callable[[GovernanceConfig], Sequence[Hit]],
    derive: Callable[[GovernanceConfig], Mapping[str, Column]] | None = None,
) -> Rule:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain '{grain}', known are: {', '.join(GRAINS)}")
    return Rule(meta, grain=grain, columns=tuple(columns), hits=hits, derive=derive)


def set_rule(meta: RuleMeta, frame: Callable[[DataFrame, GovernanceConfig], DataFrame]) -> Rule:
    return Rule(meta, frame=frame)


def fold_rule(
    meta: RuleMeta, fold: Callable[[DataFrame, str], DataFrame],
    hits: Callable[[GovernanceConfig], Sequence[Hit]],
) -> Rule:
    return Rule(meta, hits=hits, fold=fold)


# What a row rule can look at: the workbook itself or one kind of its children.
GRAINS = ("workbook", *schema.CHILD_COLUMNS)


def _kinds(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules that look at the same kind of row: one list per grain and per fold."""
    by_grain = [[rule for rule in rules if rule.grain == grain] for grain in GRAINS]
    return [kind for kind in by_grain if kind] + [[rule] for rule in rules if rule.fold is not None]


def _rows(estate: DataFrame, kinds: Sequence[Sequence[Rule]]) -> DataFrame:
    """``path, kind`` and the columns of all kinds: one row for each row of each kind, from one scan."""
    rows = readable(estate)
    # Per kind: how many rows, and the array of each of its columns.
    parts: list[tuple[Column, dict[str, Column]]] = []
    kinds_of: dict[str, T.DataType] = {}
    for number, rules in enumerate(kinds):
        if rules[0].fold is not None:
            folded = f"_fold{number}"
            rows = rules[0].fold(rows, folded)
            types = rows.schema[folded].dataType.elementType
            parts.append((F.size(folded), {c: F.col(folded)[c] for c in types.names}))
        else:
            grain, columns = rules[0].grain, list(dict.fromkeys(c for rule in rules for c in rule.columns))
            whole = schema.WORKBOOK if grain == "workbook" else schema.CHILD_COLUMNS[grain]
            types = T.StructType([whole[c] for c in columns])
            if grain == "workbook":
                parts.append((F.lit(1), {c: F.array(c) for c in columns}))
            else:
                parts.append((F.size(F.col(f"{grain}.{columns[0]}")), {c: F.col(f"{grain}.{c}") for c in columns}))
        for column in types:
            if kinds_of.setdefault(column.name, column.dataType) != column.dataType:
                raise ValueError(f"rules take '{column.name}' for two types")

    # Column by column: whole arrays are put one behind the other, so that no row of a kind is built one by one.
    def joined(name: str) -> Column:
        pieces, gap = [], []
        for size, own in parts:
            if name not in own:
                gap.append(size)
                continue
            if gap:
                pieces.append(F.array_repeat(F.lit(None).cast(kinds_of[name]), reduce(Column.__add__, gap)))
                gap = []
            pieces.append(own[name])
        return F.concat(*pieces)  # what is missing at the end is null by the zip

    kind = F.concat(*[F.array_repeat(F.lit(number), size) for number, (size, _) in enumerate(parts)])
    zipped = [kind.alias("kind"), *(joined(name).alias(name) for name in kinds_of)]
    return rows.select("path", F.explode(F.arrays_zip(*zipped)).alias("r")).select("path", "r.*")


def _properties(values: Mapping[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _head(meta: RuleMeta) -> list[Column]:
    return [
        F.lit(meta.id).alias("rule_id"), F.lit(meta.severity).alias("severity"),
        F.lit(meta.title).alias("title"),
    ]


def _by_rule(hits: Sequence[Hit], value: Callable[[Hit], Column]) -> Column:
    """The value of the hit whose place in ``hits`` the column ``hit`` holds."""
    chosen = F.when(F.col("hit") == 0, value(hits[0]))
    for place, hit in enumerate(hits[1:], 1):
        chosen = chosen.when(F.col("hit") == place, value(hit))
    return chosen


def _row_findings(estate: DataFrame, rules: Sequence[Rule], config: GovernanceConfig) -> DataFrame:
    kinds = _kinds(rules)
    found = [(number, rule.meta, hit) for number, kind in enumerate(kinds) for rule in kind for hit in rule.hits(config)]
    metas, hits = [meta for _, meta, _ in found], [hit for _, _, hit in found]
    rows = _rows(estate, kinds)
    derived = {k: F.when(F.col("kind") == number, v) for number, kind in enumerate(kinds) for rule in kind if rule.derive
               for k, v in rule.derive(config).items()}
    rows = rows.withColumns(derived) if derived else rows
    # One pass for all of them: each row yields the numbers of the hits it scores. Texts are made from these numbers
    # only, above the explode, so that Catalyst drops those that nothing asks for.
    numbers = F.lit(None).cast("array<int>")
    for number in range(len(kinds)):
        own = [F.when(hit.when, F.lit(place)) for place, (of, _, hit) in enumerate(found) if of == number]
        # A row is tested for the hits of its own kind only.
        numbers = F.when(F.col("kind") == number, F.array_compact(F.array(*own))).otherwise(numbers)

    def told(field: str) -> Column:
        texts = {place: getattr(meta, field) for place, meta in enumerate(metas)}
        return F.element_at(F.array(*[F.lit(texts[place]) for place in sorted(texts)]), F.col("hit") + 1).alias(field)

    # Outer, then drop the nulls: the plain form would add a filter that
    # evaluates every condition a second time.
    return (
        rows
        .select("*", F.explode_outer(numbers).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(
            told("id").alias("rule_id"), told("severity"), told("title"),
            _by_rule(hits, lambda hit: hit.message).alias("message"),
            F.col("path").alias("workbook_path"),
            _by_rule(hits, lambda hit: hit.location).alias("location"),
            _by_rule(hits, lambda hit: F.lit(hit.remediation).cast("string")).alias("remediation"),
            _by_rule(hits, lambda hit: _properties(hit.properties)).alias("properties"),
        )
    )


class Registry:
    """Known rules in the order they were registered."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self._rules: dict[str, Rule] = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> Rule:
        if rule.meta.id in self._rules:
            raise ValueError(f"a rule with id '{rule.meta.id}' is registered already")
        if rule.meta.severity not in SEVERITIES:
            raise ValueError(f"unknown severity '{rule.meta.severity}'")
        self._rules[rule.meta.id] = rule
        return rule

    @property
    def rules(self) -> list[Rule]:
        return list(self._rules.values())

    @property
    def known_packs(self) -> list[str]:
        packs: dict[str, str] = {}
        for rule in self.rules:
            if rule.meta.pack:
                packs.setdefault(rule.meta.pack.lower(), rule.meta.pack)
        return ["all", *(packs[key] for key in sorted(packs))]

    def for_pack(self, pack: str | None = None) -> list[Rule]:
        """Rules of a pack; none, empty or ``all`` means every rule."""
        if not pack or pack.lower() == "all":
            return self.rules
        chosen = [r for r in self.rules if (r.meta.pack or "").lower() == pack.lower()]
        if not chosen:
            raise ValueError(f"unknown rule pack '{pack}', known are: {', '.join(self.known_packs)}")
        return chosen

    def run(
        self, estate: DataFrame, pack: str | None = None, config: GovernanceConfig | None = None,
        only: Iterable[str] | None = None,
    ) -> DataFrame:
        """Findings of all selected rules over all workbooks."""
        config = config or GovernanceConfig()
        chosen = self.for_pack(pack)
        if only is not None:
            wanted = set(only)
            chosen = [rule for rule in chosen if rule.meta.id in wanted]
        frames = []
        in_row = [rule for rule in chosen if rule.frame is None]
        if in_row:
            frames.append(_row_findings(estate, in_row, config))
        for rule in chosen:
            if rule.frame is not None:
                frames.append(
                    rule.frame(estate, config)
                    .select(*_head(rule.meta), *schema.FINDING_COLUMNS[3:])
                )
        if not frames:
            return estate.sparkSession.createDataFrame([], schema.FINDING)
        return reduce(DataFrame.unionByName, frames)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """Rule id, severity, pack and title, by id."""
        rows = [(r.meta.id, r.meta.severity, r.meta.pack, r.meta.title) for r in self.rules]
        return spark.createDataFrame(
            rows, "rule_id string, severity string, pack string, title string"
        ).orderBy("rule_id")


def default_registry() -> Registry:
    """All shipped rules."""
    from quire.plans.audit import governance, hygiene

    return Registry([*hygiene.RULES, *governance.RULES])
