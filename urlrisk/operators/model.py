"""Training table, network training with early stop, inference, evaluation."""

from __future__ import annotations

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.operators import features, scoring
from urlrisk.plans.skew import running_totals

LAYERS = [len(C.FEATURES), 128, 64, 32, 2]


def training_table(labeled: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Feature columns of a labelled table; rows without URL or class are skipped."""
    usable = labeled.where(F.col("url").isNotNull() & F.col("result").isin(0, 1))
    joined = usable if profile is None else usable.join(
        profile.select("url", "redirect_depth", "chain_length"), "url", "left"
    )
    return features.extract_features(joined, "A")


def feature_stats(table: DataFrame) -> DataFrame:
    """One row with ``<name>_mean`` and ``<name>_std`` (population) of every feature."""
    aggs = []
    for name in C.FEATURES:
        column = F.col(name).cast("double")
        aggs += [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std")]
    return table.agg(*aggs)


def model_input(table: DataFrame, stats: DataFrame | None = None, label: str = "result") -> DataFrame:
    """Standardised ``features`` vector and double ``label`` next to the URL."""
    scaled = scoring.normalize_features(table, stats)
    return scaled.select(
        "url", F.col(label).cast("double").alias("label"),
        array_to_vector(features.feature_array()).alias("features"),
    )


def train_network(
    train: DataFrame, val: DataFrame, max_epochs: int = 50, patience: int = 7, steps_per_epoch: int = 10,
    seed: int = 42,
) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """Fit the network epoch by epoch, each starting from the last weights; keep the best epoch.

    An epoch is ``steps_per_epoch`` solver steps, each over all of ``train``. Stops when the validation AUC
    has not improved for ``patience`` epochs. Returns the model and the AUC history. Runs one distributed
    fit per epoch over the cached ``train``, which is dealt evenly over all cores: every step waits for the
    largest partition, and a split by ranks leaves whole partitions without training rows.
    """
    parts = max(train.sparkSession.sparkContext.defaultParallelism, train.rdd.getNumPartitions())
    train = train.repartition(parts)
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    train, val = train.persist(), val.persist()
    best, best_auc, waited, weights, history = None, -1.0, 0, None, []
    try:
        for _ in range(max_epochs):
            mlp = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=steps_per_epoch, seed=seed, blockSize=256)
            if weights is not None:
                mlp = mlp.setInitialWeights(weights)
            model = mlp.fit(train)
            weights = model.weights
            auc = evaluator.evaluate(model.transform(val))
            history.append(auc)
            if auc > best_auc:
                best, best_auc, waited = model, auc, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        train.unpersist()
        val.unpersist()
    return best, history


def infer(model: MultilayerPerceptronClassificationModel, table: DataFrame) -> DataFrame:
    """Add ``threat_probability``: the model's probability of the malicious class."""
    scored = model.transform(table)
    return scored.withColumn("threat_probability", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def confusion(scored: DataFrame, label: str = "result", prob: str = "threat_probability") -> DataFrame:
    """``(label, predicted, count)`` at threshold 0.5."""
    predicted = (F.col(prob) > 0.5).cast("int")
    return (
        scored.select(F.col(label).cast("int").alias("label"), predicted.alias("predicted"))
        .groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("count"))
    )


def classification_report(scored: DataFrame, label: str = "result", prob: str = "threat_probability") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages and accuracy."""
    cells = confusion(scored, label, prob)

    def cell(y: int, p: int):
        matches = (F.col("label") == y) & (F.col("predicted") == p)
        return F.coalesce(F.sum(F.when(matches, F.col("count"))), F.lit(0))

    one = cells.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    def row(name, p, r, f, n):
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            n.cast("bigint").alias("support"),
        )

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p0, r0, n0 = ratio(tn, tn + fn), ratio(tn, tn + fp), tn + fp
    p1, r1, n1 = ratio(tp, tp + fp), ratio(tp, tp + fn), tp + fn
    f0, f1 = ratio(2 * p0 * r0, p0 + r0), ratio(2 * p1 * r1, p1 + r1)
    n = n0 + n1
    acc = ratio(tn + tp, n)
    rows = F.array(
        row("benign", p0, r0, f0, n0), row("malicious", p1, r1, f1, n1), row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", ratio(p0 * n0 + p1 * n1, n), ratio(r0 * n0 + r1 * n1, n),
            ratio(f0 * n0 + f1 * n1, n), n),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def roc_auc(scored: DataFrame, label: str = "result", prob: str = "threat_probability") -> DataFrame:
    """Exact area under the ROC curve with ties counted half, one row. Runs a job.

    Classes are counted per distinct score; ranks of the scores come from a distributed running sum.
    """
    known = F.col(prob).isNotNull()
    per_score = scored.groupBy(F.col(prob).alias("score")).agg(
        F.count_if(known & (F.col(label) == 1)).alias("pos"),
        F.count_if(known & (F.col(label) == 0)).alias("neg"),
    )
    ordered = running_totals(per_score, [], [F.col("score")], F.col("neg"), "neg_upto")
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") * 0.5))
    return ordered.agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc")
    )


def verdict_accuracy(scored: DataFrame, label: str = "result", prob: str = "threat_probability") -> DataFrame:
    """Add ``correct``: probability above 0.5 agrees with the known class."""
    return scored.withColumn("correct", (F.col(prob) > 0.5) == (F.col(label) == 1))
