"""Calibration of scores: one way to fit and to apply identity, Platt, temperature and isotonic calibrators.

All fits look at the different scores with their counts, not at rows. Isotonic regression is the lower convex hull of the
running (rows, positives) points: every range of scores keeps only its own hull, and the hull of these hulls is the whole
one, so neither the rows nor the scores meet in one task. Its knots are a table of intervals, and a score finds its
interval by a bucket join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.operators.metrics import by_score, calibration_error, fit_temperature
from caselink.session import durable

METHODS = ("identity", "platt", "temperature", "isotonic")
GRID = 4096
INTERVALS = "lo double, hi double, y_lo double, y_hi double"


def _cumulative(scores: DataFrame) -> DataFrame:
    """(proba, w, s): rows and positives up to each score, over 1,024 ranges first and then inside each."""
    cut = scores.select("proba", (F.col("pos") + F.col("neg")).alias("n"), "pos", F.floor(F.col("proba") * 1024).alias("cell"))
    cells = cut.groupBy("cell").agg(F.sum("n").alias("n0"), F.sum("pos").alias("p0"))
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n0").over(below), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("p0").over(below), F.lit(0.0)).alias("p0"))
    inside = Window.partitionBy("cell").orderBy("proba").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(cells, "cell").select("proba", (F.col("n0") + F.sum("n").over(inside)).cast("long").alias("w"), (F.col("p0") + F.sum("pos").over(inside)).cast("long").alias("s"))


def _hull(points: Iterator[tuple], start: list | None = None) -> list[list]:
    """The lower convex hull of (proba, w, s, next) points that come by w; ``next`` is the score after a point's own."""
    held = start or []
    for p in points:
        if held and held[-1][3] is None:
            held[-1][3] = p[0]
        while len(held) >= 2 and (held[-1][2] - held[-2][2]) * (p[1] - held[-2][1]) >= (p[2] - held[-2][2]) * (held[-1][1] - held[-2][1]):
            held.pop()
        held.append(list(p))
    return held


def _partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[list] = []
    for part in parts:
        for p, w, s in zip(part["proba"].tolist(), part["w"].tolist(), part["s"].tolist(), strict=True):
            held = _hull(iter([(p, w, s, None)]), held)
    yield pd.DataFrame(held, columns=["proba", "w", "s", "next"]).astype({"proba": float, "w": "int64", "s": "int64", "next": float})


def _intervals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = ((p, w, s, None if n is None or n != n else n) for part in parts for p, w, s, n in zip(part["proba"].tolist(), part["w"].tolist(), part["s"].tolist(), part["next"].tolist(), strict=True))
    # the last point of a range doesn't know the first score of the next range; that is the point after it
    held = _hull(rows, [[float("-inf"), 0, 0, None]])
    out, low = [], float("-inf")
    for a, b in zip(held, held[1:], strict=False):
        first, last, y = a[3], b[0], (b[2] - a[2]) / (b[1] - a[1])
        out.append([low, first, out[-1][3] if out else y, y])
        out.append([first, last, y, y])
        low = last
    if out:
        out.append([low, float("inf"), out[-1][3], out[-1][3]])
    yield pd.DataFrame([r for r in out if r[0] < r[1]], columns=["lo", "hi", "y_lo", "y_hi"]).astype(float)


def isotonic_intervals(df: DataFrame) -> DataFrame:
    """(lo, hi, y_lo, y_hi): what a score in [lo, hi) becomes: the block's positive rate, between two blocks what lies on
    the line between them, beyond the ends what the ends have."""
    points = _cumulative(durable(by_score(df.where("proba is not null and label is not null")), "isotonic-scores"))
    hulls = points.repartitionByRange("proba").sortWithinPartitions("proba").mapInPandas(_partial, "proba double, w long, s long, next double")
    # a convex chain of whole-number steps over n rows has at most about 3 * n ** (2 / 3) corners: these meet in one task
    return durable(durable(hulls, "isotonic-hulls").repartition(1).sortWithinPartitions("w").mapInPandas(_intervals, INTERVALS), "isotonic-intervals")


def fit_platt(df: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic curve of a * score + b with the least log loss plus a * a / 2, by Newton steps over sums."""
    scores = durable(by_score(df.where("proba is not null and label is not null")), "platt-scores")
    a = b = 0.0
    p, n = F.col("proba"), F.col("pos") + F.col("neg")
    for _ in range(rounds):
        z = 1 / (1 + F.exp(-(F.lit(a) * p + F.lit(b))))
        err, bend = n * z - F.col("pos"), n * z * (1 - z)
        r = scores.agg(F.sum(err * p).alias("ga"), F.sum(err).alias("gb"), F.sum(bend * p * p).alias("aa"), F.sum(bend * p).alias("ab"), F.sum(bend).alias("bb")).first()
        if r.gb is None:
            return 1.0, 0.0
        ga, aa = r.ga + a, r.aa + 1
        det = aa * r.bb - r.ab * r.ab
        if det <= 1e-12 * aa:
            break
        da, db = (r.bb * ga - r.ab * r.gb) / det, (aa * r.gb - r.ab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-11 * (1 + abs(a) + abs(b)):
            break
    return a, b


@dataclass
class Calibrator:
    """A fitted method: ``apply`` replaces the score column by the calibrated score, rounded to six places."""

    method: str
    values: dict[str, float] = field(default_factory=dict)
    intervals: DataFrame | None = None

    def apply(self, df: DataFrame, col: str = "proba") -> DataFrame:
        p = F.col(col)
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        if self.method == "identity":
            out = inside
        elif self.method == "platt":
            out = 1 / (1 + F.exp(-(self.values["a"] * p + self.values["b"])))
        elif self.method == "temperature":
            clip = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
            out = 1 / (1 + F.exp(-F.log(clip / (1 - clip)) / self.values["t"]))
        else:
            return self._looked_up(df, col)
        return df.withColumn(col, F.when(p.isNotNull(), F.round(out, 6)))

    def _looked_up(self, df: DataFrame, col: str) -> DataFrame:
        place = lambda c: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * GRID).cast("int")
        ranges = self.intervals.withColumn("bucket", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))))
        asked = df.select(F.col(col).alias("asked")).where("asked is not null").distinct().withColumn("bucket", place(F.col("asked")))
        share = F.when(F.col("y_lo") == F.col("y_hi"), F.col("y_lo")).otherwise(F.col("y_lo") + (F.col("y_hi") - F.col("y_lo")) * (F.col("asked") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        found = asked.join(ranges, "bucket").where("lo <= asked and asked < hi").select("asked", F.round(share, 6).alias("answer"))
        return df.join(found, F.col(col) == F.col("asked"), "left").withColumn(col, F.coalesce("answer", F.when(F.col(col).isNotNull(), F.col(col)))).drop("asked", "answer")


def fit_calibrator(df: DataFrame, method: str) -> Calibrator:
    """A calibrator of (label, proba)."""
    if method == "platt":
        a, b = fit_platt(df)
        return Calibrator(method, {"a": a, "b": b})
    if method == "temperature":
        return Calibrator(method, {"t": fit_temperature(df).first().temperature or 1.0})
    if method == "isotonic":
        return Calibrator(method, intervals=isotonic_intervals(df))
    if method != "identity":
        raise ValueError(f"{method} is none of {METHODS}")
    return Calibrator(method)


def auto_recalibrate(df: DataFrame, check: DataFrame | None = None, methods: tuple[str, ...] = METHODS, least_gain: float = 0.002) -> DataFrame:
    """(method, ece, mce, brier, chosen): every method fitted on ``df`` and scored on ``check``. The least (ECE, Brier)
    is chosen if its ECE is lower than that of the scores as they are by ``least_gain``, else identity. Without ``check``
    the methods are scored on the rows they were fitted on, where isotonic is sure to look best."""
    out = None
    for method in methods:
        held = fit_calibrator(df, method).apply((check if check is not None else df).select(F.col("label").cast("double").alias("label"), "proba"))
        one = calibration_error(held).join(held.agg(F.round(F.avg((F.col("proba") - F.col("label")) ** 2), 6).alias("brier"))).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    every = Window.partitionBy()  # a row a method
    base = F.max(F.when(F.col("method") == "identity", F.col("ece"))).over(every)
    least = F.min(F.struct("ece", "brier", "method")).over(every)
    better = base - least["ece"] >= least_gain
    return out.select("method", "ece", "mce", "brier", F.when(better, F.col("method") == least["method"]).otherwise(F.col("method") == "identity").alias("chosen"))
