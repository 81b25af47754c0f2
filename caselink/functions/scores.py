"""Column helpers shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(col: Column | str, table: dict) -> Column:
    """The table's value for a column, null for other keys."""
    col = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def band(score: Column, bands: dict[str, float]) -> Column:
    """The first band whose bound lies above the score; the last one beyond all."""
    names = list(bands)
    out = None
    for name in names:
        out = F.when(score < bands[name], name) if out is None else out.when(score < bands[name], name)
    return out.otherwise(names[-1])


def band_sql(score: str, bands: dict[str, float]) -> str:
    names = list(bands)
    return "CASE " + " ".join(f"WHEN {score} < {bands[n]} THEN '{n}'" for n in names) + f" ELSE '{names[-1]}' END"


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that aren't null, their weights renormalised; null without any."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return F.when(weight > 0, total / weight)
