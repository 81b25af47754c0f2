"""Calibrators against their definitions, and cross-validation against hand-made folds."""

import math
import random

import numpy as np
import pytest

from caselink.operators import calibrate as cal
from caselink.operators import metrics as op
from caselink.operators.curate import stratified_kfold


def pooled(rows):
    """Isotonic regression by pooling neighbours that violate the order: {score: value}."""
    by = {}
    for p, y in rows:
        by.setdefault(p, []).append(y)
    blocks = []
    for p in sorted(by):
        blocks.append([sum(by[p]), len(by[p]), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return {p: s / n for s, n, ps in blocks for p in ps}


@pytest.mark.parametrize("kind", ["spread", "coarse", "reversed", "one score", "perfect"])
def test_isotonic_equals_pooling(spark, kind):
    r = random.Random(7)
    p = [r.random() for _ in range(700)]
    p = [round(x, 1) for x in p] if kind == "coarse" else [0.25] * 50 if kind == "one score" else p
    rows = [(x, int(r.random() < (1 - x if kind == "reversed" else x))) for x in p] if kind != "perfect" else [(x, int(x > 0.5)) for x in p]
    want = pooled(rows)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id int, proba double, label int").repartition(6)
    c = cal.fit_calibrator(df, "isotonic")
    got = {r.id: r.proba for r in c.apply(df).collect()}
    assert all(abs(got[i] - want[x]) < 1e-6 for i, (x, _) in enumerate(rows)) and len(got) == len(rows)
    xs = sorted(want)
    asked = [0.0, 1.0, None, *(r.random() for _ in range(200))]
    new = {r.id: r.proba for r in c.apply(spark.createDataFrame(list(enumerate(asked)), "id int, proba double")).collect()}
    assert new[2] is None and all(abs(new[i] - np.interp(a, xs, [want[x] for x in xs])) < 1e-6 for i, a in enumerate(asked) if a is not None)


def test_platt_and_temperature(spark):
    r = random.Random(2)
    rows = [(i, x, int(r.random() < 1 / (1 + math.exp(-(6 * x - 2))))) for i, x in enumerate(r.random() for _ in range(900))]
    df = spark.createDataFrame(rows, "id int, proba double, label int")
    x, y = np.array([a for _, a, _ in rows]), np.array([b for _, _, b in rows])
    a, b = cal.fit_platt(df)
    z = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((z - y) * x).sum() + a) < 1e-6 and abs((z - y).sum()) < 1e-6  # the gradient of the penalised loss is gone
    got = {r.id: r.proba for r in cal.fit_calibrator(df, "platt").apply(df).collect()}
    assert max(abs(got[i] - z[i]) for i in got) < 1e-6
    t = cal.fit_calibrator(df, "temperature")
    loss = lambda u: np.mean(np.log1p(np.exp(np.where(y == 1, -1, 1) * np.log(x / (1 - x)) / u)))
    grid = [0.1 + 4.9 * i / 199 for i in range(200)]
    assert abs(t.values["t"] - min(grid, key=loss)) < 1e-5
    assert cal.fit_calibrator(df, "identity").apply(spark.createDataFrame([(1.5,), (None,), (0.25,)], "proba double")).collect()[0].proba == 1.0
    with pytest.raises(ValueError):
        cal.fit_calibrator(df, "odd")


def test_choice_on_other_rows(spark):
    r = random.Random(4)
    make = lambda n: spark.createDataFrame([(x, int(r.random() < x * x)) for x in (r.random() for _ in range(n))], "proba double, label int")
    got = {x.method: x for x in cal.auto_recalibrate(make(4000), make(4000)).collect()}
    assert set(got) == set(cal.METHODS) and sum(x.chosen for x in got.values()) == 1 and got["isotonic"].ece > 0
    assert got["isotonic"].chosen and not got["identity"].chosen
    good = lambda n: spark.createDataFrame([(x, int(r.random() < x)) for x in (r.random() for _ in range(n))], "proba double, label int")
    assert [x.method for x in cal.auto_recalibrate(good(20000), good(20000), least_gain=0.02).collect() if x.chosen] == ["identity"]
    assert cal.auto_recalibrate(make(0), make(50)).count() == 4


def test_cross_validation_equals_folds_by_hand(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    r = random.Random(1)
    rows = [(str(i), float(r.random() < 0.3 + 0.4 * (a > 0.5)), a, r.random()) for i, a in enumerate(r.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "url string, label double, a double, b double").coalesce(1)
    folds, summary = op.cross_validate(df, ["a", "b"], 4, ("tree", "svm"))
    got = {(f.model, f.fold): f for f in folds.collect()}
    assert set(got) == {(m, i) for m in ("tree", "svm") for i in range(4)}
    packed = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(stratified_kfold(df, 4)).cache()
    f1 = []
    for i in range(4):
        rows = DecisionTreeClassifier(seed=42).fit(packed.where(f"fold <> {i}")).transform(packed.where(f"fold = {i}")).select("label", "prediction", "probability").collect()
        tp, fp, fn = (sum(r.label == y and r.prediction == p for r in rows) for y, p in ((1, 1), (0, 1), (1, 0)))
        pos, neg = [r.probability[1] for r in rows if r.label == 1], [r.probability[1] for r in rows if r.label == 0]
        f1.append(2 * tp / (2 * tp + fp + fn))
        x = got["tree", i]
        assert (x.tp, x.fp, x.fn) == (tp, fp, fn) and abs(x.f1 - f1[-1]) < 1e-6
        assert abs(x.roc_auc - np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])) < 1e-6
    s = {x.model: x for x in summary.collect()}
    assert s["tree"].folds == 4 and abs(s["tree"].f1_mean - np.mean(f1)) < 1e-5 and abs(s["tree"].f1_std - np.std(f1)) < 1e-5
