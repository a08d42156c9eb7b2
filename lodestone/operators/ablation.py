"""Ablation patches as projections over topic assignments: experiments are rows, nothing is mutated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topics import GENERIC


@dataclass(frozen=True)
class Patch:
    null_entity: bool = False
    null_category: bool = False
    null_topics: bool = False
    skip_ner: bool = False
    empty_patterns: bool = False
    skip_cluster: bool = False
    skip_rules: bool = False
    null_generic: bool = False
    null_low_confidence: bool = False
    threshold: float = 0.5

    @property
    def needs_rerun(self) -> bool:
        return self.skip_ner or self.empty_patterns or self.skip_cluster or self.skip_rules

    @property
    def label(self) -> str:
        names = {
            "no_entity": self.null_entity, "no_category": self.null_category, "no_topics": self.null_topics, "skip_ner": self.skip_ner,
            "empty_patterns": self.empty_patterns, "skip_cluster": self.skip_cluster, "skip_rules": self.skip_rules,
            "no_generic_entity": self.null_generic, f"low_conf_{str(self.threshold).replace('.', '')}": self.null_low_confidence,
        }
        return "+".join(n for n, on in names.items() if on) or "baseline"

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows: (id, topic, topic_probability, ner_category, ner_primary_entity, ...)."""
        entity, category, topic = F.col("ner_primary_entity"), F.col("ner_category"), F.col("topic")
        if self.null_entity or self.skip_ner:
            entity = F.lit(None).cast("string")
        if self.null_generic:
            entity = F.when(~F.coalesce(entity.isin(GENERIC), F.lit(False)), entity)
        if self.null_category or self.skip_ner:
            category = F.lit("OTHER")
        if self.null_topics:
            topic = F.lit(-1)
        if self.null_low_confidence:
            topic = F.when(F.coalesce("topic_probability", F.lit(1.0)) < self.threshold, -1).otherwise(topic)
        return rows.withColumns({"ner_primary_entity": entity, "ner_category": category, "topic": topic.cast("int")})


SUITE = [Patch(), Patch(null_entity=True), Patch(null_category=True), Patch(null_topics=True), Patch(null_generic=True), Patch(null_low_confidence=True, threshold=0.4), Patch(null_low_confidence=True)]
RERUN_SUITE = [Patch(skip_ner=True), Patch(skip_cluster=True), Patch(skip_rules=True)]


def experiments(rows: DataFrame, patches: list[Patch]) -> DataFrame:
    """All patched assignments in one table, by experiment."""
    return reduce(DataFrame.unionByName, [p.apply(rows).withColumn("experiment", F.lit(p.label)) for p in patches])
