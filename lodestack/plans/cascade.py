"""Ordered rules: the first whose condition holds decides.

Rules are data.  Conditions are plain SQL over the columns at hand, so a cascade compiles to one ``when`` chain for
Spark and to ``CASE`` text for any other engine.  Shared terms are computed in a projection before the chain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cascade:
    """``outputs`` named columns decided by ``rules``: condition, then a SQL expression for each output."""

    outputs: tuple[str, ...]
    rules: tuple[tuple[str, ...], ...]
    default: tuple[str, ...]
    terms: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and the outputs."""
        layers = df
        for name, sql in self.terms.items():
            layers = layers.withColumn(name, F.expr(sql))
        chosen = None
        for condition, *values in self.rules:
            value = F.struct(*[F.expr(v).alias(n) for n, v in zip(self.outputs, values)])
            chosen = F.when(F.expr(condition), value) if chosen is None else chosen.when(F.expr(condition), value)
        chosen = chosen.otherwise(F.struct(*[F.expr(v).alias(n) for n, v in zip(self.outputs, self.default)]))
        kept = [c for c in df.columns if c not in self.outputs]
        return layers.withColumn("decided_", chosen).select(*kept, *[F.col("decided_")[n].alias(n) for n in self.outputs])

    def sql(self, relation: str, keep: str) -> str:
        """A query with columns ``keep`` and the outputs over ``relation``."""
        inner = relation
        for name, sql in self.terms.items():
            inner = f"(SELECT *, {sql} AS {name} FROM {inner})"
        columns = []
        for i, n in enumerate(self.outputs):
            arms = " ".join(f"WHEN {r[0]} THEN {r[1 + i]}" for r in self.rules)
            columns.append(f"CASE {arms} ELSE {self.default[i]} END AS {n}")
        return f"SELECT {keep}, {', '.join(columns)} FROM {inner}"


def q(*words: str) -> tuple[str, ...]:
    """Quoted words."""
    return tuple(f"'{w}'" for w in words)


def rule(condition: str, *words: str) -> tuple[str, ...]:
    """A rule whose outputs are words."""
    return (condition, *q(*words))
