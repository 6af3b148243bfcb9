"""Rules as columns over feature tables, and the registry that holds them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.schemas import EVIDENCE

if TYPE_CHECKING:
    from wiretide.plans.features import Features


@dataclass(frozen=True)
class Rule:
    """A detection rule.

    ``finding`` gives a struct column over the feature table ``source``, NULL where the rule does
    not fire; all such rules of one table run in one pass. ``plan`` is the free form: any function
    from features to a DataFrame of findings.
    """

    rule_id: str
    rule_name: str
    source: str | None = None
    finding: Callable[[], Column] | None = None
    plan: Callable[[Features], DataFrame] | None = None
    version: str = "1.0.0"

    def column(self) -> Column:
        """The finding column, built once per process: a stream plans it for every batch."""
        return _finding_column(self.finding)


@lru_cache(maxsize=256)
def _finding_column(finding: Callable[[], Column]) -> Column:
    return finding()


class RuleRegistry:
    """Rules by id, in order of first registration."""

    def __init__(self, rules: Sequence[Rule] = ()) -> None:
        self._rules: dict[str, Rule] = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> None:
        if not rule.rule_id:
            raise ValueError(f"rule {rule.rule_name!r} has an empty id")
        self._rules[rule.rule_id] = rule

    def get(self, rule_id: str) -> Rule | None:
        return self._rules.get(rule_id)

    def get_all(self) -> list[Rule]:
        return list(self._rules.values())

    def clear(self) -> None:
        self._rules.clear()

    def __len__(self) -> int:
        return len(self._rules)


def evidence(
    key: str,
    value: Column,
    threshold: object,
    unit: str | None = None,
    when: Column | None = None,
) -> Column:
    """One piece of evidence; value and threshold are text because their types vary."""
    item = F.struct(
        F.lit(key).alias("key"),
        value.cast("string").alias("value"),
        F.lit(str(threshold)).alias("threshold"),
        F.lit(unit).cast("string").alias("unit"),
    ).cast(EVIDENCE)
    return item if when is None else F.when(when, item)


def make_finding(
    fires: Column,
    *,
    entity: Column,
    subject: Column,
    raw: Column,
    confidence: Column,
    title: Column,
    description: Column,
    recommendation: Column,
    evidences: Sequence[Column],
    entities: Column,
    start: Column,
    end: Column,
    snapshot: Mapping[str, Column],
    severity: Column | None = None,
    shown_digits: int | None = None,
) -> Column:
    """The finding struct, or NULL where ``fires`` is not true.

    The engine derives the risk score from ``raw``, and the severity too unless it is given.
    ``shown_digits`` rounds the published raw score.
    """
    pairs = [x for name, value in snapshot.items() for x in (F.lit(name), value.cast("double"))]
    return F.when(
        fires,
        F.struct(
            entity.alias("entity"),
            subject.alias("subject"),
            (F.lit(None) if severity is None else severity).cast("int").alias("own_severity"),
            confidence.cast("int").alias("confidence_code"),
            raw.alias("raw"),
            F.lit(shown_digits).cast("int").alias("shown_digits"),
            title.alias("title"),
            description.alias("description"),
            recommendation.alias("recommendation"),
            F.filter(F.array(*evidences), lambda e: e.isNotNull()).alias("evidences"),
            entities.cast("array<string>").alias("affected_entities"),
            start.cast("timestamp").alias("timestamp_start"),
            end.cast("timestamp").alias("timestamp_end"),
            F.create_map(*pairs).alias("feature_snapshot"),
        ),
    )
