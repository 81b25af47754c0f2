"""Classifier metrics, curves, calibration and gold-table scores.

Ranks and running counts are taken over distinct scores, never over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def safe(a, b):
    return F.when(b != 0, a / b).otherwise(0.0)


def _counted(df: DataFrame, by: tuple[str, ...], bins: int) -> DataFrame:
    p = F.least(F.greatest(F.col("proba"), F.lit(1e-7)), F.lit(1 - 1e-7))
    t, f = F.col("label") == 1, F.col("label") == 0
    place = F.least(F.floor(F.col("proba") * bins), F.lit(bins - 1))
    inside = [F.abs(F.sum(F.when(place == i, F.col("proba") - F.col("label")))) for i in range(bins)]
    return df.groupBy(*by).agg(
        F.count_if(t & (F.col("pred") == 1)).alias("tp"), F.count_if(f & (F.col("pred") == 1)).alias("fp"), F.count_if(f & (F.col("pred") == 0)).alias("tn"), F.count_if(t & (F.col("pred") == 0)).alias("fn"),
        F.avg(-F.when(t, F.log(p)).otherwise(F.log(1 - p))).alias("ll"), F.avg((F.col("proba") - F.col("label")) ** 2).alias("br"),
        (sum((F.coalesce(x, F.lit(0.0)) for x in inside[1:]), F.coalesce(inside[0], F.lit(0.0))) / F.count("proba")).alias("ce"))


def grouped_metrics(df: DataFrame, by: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """From (label, pred, proba), a row for each group ``by``: counts and rates, ROC-AUC (0.5 without both classes), average
    precision (0 without positives), log loss (clipped at 1e-7), Brier score and expected calibration error. One pass over
    the rows and one over their different scores serve all groups."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    out = _counted(df, by, bins).withColumns({"accuracy": safe(tp + tn, tp + fp + tn + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "fpr": safe(fp, fp + tn), "fnr": safe(fn, fn + tp)})
    out = out.withColumns({"f1": safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "mcc": safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    r = running(by_score(df, by), by)
    areas = r.groupBy(*by).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    roc, pr = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5), F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0)
    areas = areas.select(*by, roc.alias("roc_auc"), pr.alias("pr_auc"))
    out = out.join(areas, list(by)) if by else out.join(areas)
    return out.select(*by, "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in RATES), F.round("ll", 6).alias("log_loss"), F.round("br", 6).alias("brier"), F.round("ce", 6).alias("ece"))


RATES = ("accuracy", "precision", "recall", "f1", "mcc", "fpr", "fnr", "roc_auc", "pr_auc")


def binary_metrics(df: DataFrame, bins: int = 10) -> DataFrame:
    """``grouped_metrics`` of all rows: one row."""
    return grouped_metrics(df, (), bins)


def by_score(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(proba, pos, neg) per distinct score."""
    return df.groupBy(*by, "proba").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))


def running(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives at or above each score: over 1,024 score ranges first, then inside each."""
    cut = scores.withColumn("_cell", F.floor(F.col("proba") * 1024))
    cells = cut.groupBy(*by, "_cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.partitionBy(*by).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "_cell", F.coalesce(F.sum("p").over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0.0)).alias("n0"))
    inside = Window.partitionBy(*by, "_cell").orderBy(F.col("proba").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(cells, [*by, "_cell"]).select(*by, "proba", "pos", "neg", (F.col("p0") + F.sum("pos").over(inside)).alias("tp"), (F.col("n0") + F.sum("neg").over(inside)).alias("fp"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney with ties counted half; 0.5 when a class is absent."""
    r = running(by_score(df))
    s = r.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5), 6).alias("roc_auc"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Average precision over distinct thresholds; 0 without positives."""
    r = running(by_score(df))
    s = r.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"), F.sum("pos").alias("p"))
    return s.select(F.round(F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0), 6).alias("pr_auc"))


def curve_points(df: DataFrame) -> DataFrame:
    """ROC and precision-recall points per distinct score."""
    r = running(by_score(df))
    n = r.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return r.join(n).select("proba", F.round(safe(F.col("tp"), F.col("P")), 6).alias("tpr"), F.round(safe(F.col("fp"), F.col("N")), 6).alias("fpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed: count, mean score, positive rate and gap."""
    b = F.least(F.floor(F.col("proba") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("proba"), 6).alias("mean_proba"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"), F.round(F.abs(F.avg("proba") - F.avg(F.col("label").cast("double"))), 6).alias("gap"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error."""
    r = reliability(df, bins)
    return r.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.max("gap").alias("mce"))


def fit_temperature(df: DataFrame, lo: float = 0.1, hi: float = 5.0, steps: int = 200) -> DataFrame:
    """The temperature of a fixed grid with the least log loss, from one pass that sums the loss of every grid value."""
    p = F.least(F.greatest(F.col("proba"), F.lit(1e-7)), F.lit(1 - 1e-7))
    grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    z = F.log(p / (1 - p))
    loss = lambda t: F.log1p(F.exp(F.when(F.col("label") == 1, -F.col("_z")).otherwise(F.col("_z")) / t))
    sums = df.withColumn("_z", z).agg(F.array(*(F.struct(F.round(F.avg(loss(t)), 9).alias("loss"), F.lit(round(t, 6)).alias("temperature")) for t in grid)).alias("g"))
    return sums.select(F.array_min("g").alias("m")).select("m.temperature", "m.loss")


def error_analysis(df: DataFrame, k: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The k most confident mistakes."""
    wrong = df.where("label <> pred").withColumn("kind", F.when(F.col("pred") == 1, "false_positive").otherwise("false_negative")).withColumn("confidence", F.round(F.abs(F.col("proba") - 0.5) * 2, 6))
    return wrong.orderBy(F.col("confidence").desc(), id_col).limit(k).select(id_col, "kind", "confidence")


def rank_models(metrics: DataFrame) -> DataFrame:
    order = [F.col(c).desc() for c in ("f1", "roc_auc", "recall", "precision")]
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(*order, "model")))


def candidate_models(names: tuple[str, ...] = ("logistic", "tree", "forest", "boosted", "bayes", "svm")) -> dict:
    from pyspark.ml import classification as C

    made = {"logistic": lambda: C.LogisticRegression(maxIter=30), "tree": lambda: C.DecisionTreeClassifier(seed=42), "forest": lambda: C.RandomForestClassifier(numTrees=20, seed=42), "boosted": lambda: C.GBTClassifier(maxIter=10, seed=42),
            "bayes": lambda: C.NaiveBayes(modelType="gaussian"), "svm": lambda: C.LinearSVC(maxIter=30)}
    return {n: made[n]() for n in names}


def train_compare(train: DataFrame, validation: DataFrame, features: list[str], names: tuple[str, ...] = ("logistic", "tree", "forest", "boosted", "bayes", "svm")) -> DataFrame:
    """Validation metrics of each candidate family."""
    from pyspark.ml.feature import VectorAssembler

    pack = VectorAssembler(inputCols=features, outputCol="features")
    train, validation = pack.transform(train), pack.transform(validation)
    out = None
    for name, model in candidate_models(names).items():
        scored = model.fit(train).transform(validation).select("label", F.col("prediction").cast("int").alias("pred"), F.col("prediction").alias("proba"))
        one = binary_metrics(scored).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def cross_validate(df: DataFrame, features: list[str], k: int = 5, names: tuple[str, ...] = ("logistic", "tree"), at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(folds, summary): metrics of each model on each of the stratified folds it wasn't fitted on, and their mean and
    population deviation by model.

    The features are packed and the folds dealt once and written; the fits of all models and folds run ``at_once`` at a
    time over that table, and one grouped pass measures all of them.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from caselink.operators.curate import stratified_kfold
    from caselink.session import durable

    dealt = durable(stratified_kfold(df, k), "folds")
    packed = VectorAssembler(inputCols=features, outputCol="features").transform(dealt).select("label", "fold", "features")

    def fitted(task: tuple[str, int]) -> DataFrame:
        name, i = task
        got = candidate_models((name,))[name].fit(packed.where(F.col("fold") != i)).transform(packed.where(F.col("fold") == i))
        proba = vector_to_array("probability")[1] if "probability" in got.columns else F.col("prediction")
        return got.select(F.lit(name).alias("model"), "fold", "label", F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))

    tasks = [(n, i) for n in names for i in range(k)]
    with ThreadPool(at_once) as pool:
        scored = pool.map(fitted, tasks)
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    folds = grouped_metrics(durable(every, "fold-scores"), ("model", "fold"))
    return folds, fold_summary(folds)


def fold_summary(folds: DataFrame, by: str = "model", columns: tuple[str, ...] = ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc")) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.groupBy(by).agg(F.count("*").alias("folds"), *(x for c in columns for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))))


def tune(train: DataFrame, features: list[str], depths: tuple[int, ...] = (2, 4, 6, 8, 10)) -> DataFrame:
    """Grid search of a tree's depth by F1 on a held-out quarter."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    tree = DecisionTreeClassifier(seed=42)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    fitted = TrainValidationSplit(estimator=tree, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), trainRatio=0.75, seed=42).fit(VectorAssembler(inputCols=features, outputCol="features").transform(train))
    return train.sparkSession.createDataFrame([(d, float(m)) for d, m in zip(depths, fitted.validationMetrics, strict=True)], "max_depth int, f1 double")


def entity_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per type: true and false positives, misses, precision, recall and F1 over distinct (item, type, value)."""
    keys = ["item_id", "entity_type", "value"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(pred.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full")
    s = both.groupBy("entity_type").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    s = s.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("f1", F.round(safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def entity_prf_summary(scores: DataFrame) -> DataFrame:
    """One row over the types of ``entity_prf``: counts, precision, recall and F1 of all together, and the mean F1."""
    own = safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = scores.agg(F.count("*").alias("types"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), F.coalesce(F.avg(own), F.lit(0.0)).alias("macro_f1"))
    return s.select("types", "tp", "fp", "fn", F.round(safe(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(own, 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """From (id, expected, found): errors and rates of characters and words of each sample, in composed form (NFC), lower
    case, with single spaces. An empty reference counts by what was found instead: all of it is wrong. Nulls are empty."""
    import unicodedata
    from collections.abc import Iterator

    import pandas as pd

    from caselink.functions.distance import edit_distance

    def fold(text: str | None) -> str:
        return " ".join(unicodedata.normalize("NFC", text or "").lower().split())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, e, f in zip(part["id"], part["expected"], part["found"], strict=True):
                e, f = fold(e), fold(f)
                ew, fw = e.split(), f.split()
                rows.append((i, edit_distance(e, f), len(e), len(f), edit_distance(ew, fw), len(ew), len(fw)))
            yield pd.DataFrame(rows, columns=["id", "char_errors", "chars", "_f", "word_errors", "words", "_w"])

    kind = pairs.schema["id"].dataType.simpleString()
    rows = pairs.select("id", "expected", "found").mapInPandas(run, f"id {kind}, char_errors long, chars long, _f long, word_errors long, words long, _w long")
    rate = lambda n, own, other: F.round(safe(F.col(n), F.when(F.col(own) > 0, F.col(own)).otherwise(F.col(other))), 6)
    return rows.select("id", "char_errors", "chars", rate("char_errors", "chars", "_f").alias("cer"), "word_errors", "words", rate("word_errors", "words", "_w").alias("wer"))


def error_summary(rates: DataFrame) -> DataFrame:
    """One row over all samples of ``error_rates``: rates and accuracies weighted by length, and least, largest, mean and
    median of the samples' own rates."""
    micro = lambda n, d: F.coalesce(safe(F.sum(n), F.sum(d)), F.lit(0.0))
    spread = [x for c in ("cer", "wer") for x in (F.round(F.min(c), 4).alias(f"{c}_min"), F.round(F.max(c), 4).alias(f"{c}_max"), F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.median(c), 4).alias(f"{c}_median"))]
    s = rates.agg(F.count("*").alias("samples"), micro("char_errors", "chars").alias("cer"), micro("word_errors", "words").alias("wer"), *spread)
    accuracy = {f"{k}_accuracy": F.round(F.greatest(F.lit(0.0), 1 - F.col(c)), 4) for k, c in (("char", "cer"), ("word", "wer"))}
    return s.withColumns(accuracy).withColumns({c: F.round(c, 4) for c in ("cer", "wer")})


def preservation_rate(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Share of gold strings that stand in their text."""
    hit = F.contains(F.col("text"), F.col("value"))
    return gold.join(texts, "item_id").groupBy("entity_type").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("preserved"))


def pair_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of unordered pairs."""
    un = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = un(gold).withColumn("g", F.lit(1)).join(un(pred).withColumn("p", F.lit(1)), ["a", "b"], "full")
    s = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return s.withColumns({"precision": F.round(safe(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6)})


def order_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per case: share of item pairs in gold order among common items, tau, and whether all are; 1 without pairs."""
    both = gold.join(pred.withColumnRenamed("rank", "found"), ["case_id", "item_id"])
    x, y = both.select("case_id", F.col("rank").alias("r1"), F.col("found").alias("f1")), both.select("case_id", F.col("rank").alias("r2"), F.col("found").alias("f2"))
    s = x.join(y, "case_id").where("r1 < r2").groupBy("case_id").agg(F.avg((F.col("f1") < F.col("f2")).cast("double")).alias("a"), F.count("*").alias("pairs"))
    cases = both.select("case_id").distinct()
    a = F.coalesce("a", F.lit(1.0))
    return cases.join(s, "case_id", "left").select("case_id", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.round(a, 6).alias("accuracy"), F.round(2 * a - 1, 6).alias("tau"), (a == 1).alias("exact"))


def timestamp_error(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean and median absolute error in seconds, shares within bounds, and how many are unresolved."""
    e = F.abs(F.unix_micros("ts") - F.unix_micros("found")) / 1e6
    rows = gold.join(pred.select("item_id", F.col("ts").alias("found")), "item_id", "left").withColumn("e", e)
    within = lambda s: F.round(F.avg(F.when(F.col("e").isNotNull(), (F.col("e") <= s).cast("double"))), 6)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("e"), 3).alias("mae_s"), F.round(F.median("e"), 3).alias("median_s"), within(60).alias("within_minute"), within(3600).alias("within_hour"), within(86400).alias("within_day"), F.round(F.avg(F.col("e").isNull().cast("double")), 6).alias("unresolved"))
