"""Change classifiers with Spark ML: weights, hash splits, boosted trees, scoring."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import persist_table, remove_tables
from .temporal import temporal_stack


#: Spark's settings that remove the shuffles of a query once it has run, and that bound the bytes a task scans.
CLEANUP, SPLIT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.files.maxPartitionBytes"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that is put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def training_table(df: DataFrame, name: str, most: int = 500_000) -> Iterator[DataFrame]:
    """``df`` as a table that is scanned by tasks of about ``most`` rows or fewer, while the ``with`` block lasts.

    A fit passes over its rows many times, and Spark ML makes them once more to log them: shuffled rows would lie on disk
    twice, scanned ones not at all. The shuffles that led to the table go once it is written.
    """
    spark = df.sparkSession
    with setting(spark, CLEANUP, "true"):
        table = persist_table(df, name, maxRecordsPerFile=max(1, most // 10))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of its files
    try:
        with setting(spark, SPLIT, f"{max(1, size * most // max(most, table.count()))}b"):
            yield table
    finally:
        remove_tables(table)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = total / (2 n_class); the classes are few, so their counts are broadcast."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__t") / (2 * F.col("__n"))).drop("__n", "__t")


def spread(df: DataFrame, keys: list[str], rows: int, most: int = 500_000) -> DataFrame:
    """``df`` in partitions of about ``most`` rows or fewer, so that a task of a fit holds no share that grows with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def weighted_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for equal ``columns`` with their summed ``weight``: the same to trees that take all rows, and often far fewer."""
    return df.groupBy(*columns).agg(F.sum("weight").alias("weight"))


def boosted_filter(df: DataFrame, key: str, features: list[str], label: str, iterations: int = 10, seed: int = 7) -> DataFrame:
    """Fit on a hash-chosen 70 %, stop early on 15 %, score all rows: key, probability, split."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))
    x = class_weights(df, label).withColumn("split", F.when(h < 15, "test").when(h < 30, "val").otherwise("train")).withColumn("__val", F.col("split") == "val")
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(x)
    gbt = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", validationIndicatorCol="__val", maxIter=iterations, maxDepth=4, seed=seed)
    model = gbt.fit(x.filter("split <> 'test'"))
    return model.transform(x).select(key, F.round(vector_to_array("probability")[1], 6).alias("probability"), "split")


def importances(df: DataFrame, key: str, features: list[str], label: str, iterations: int = 10, seed: int = 7) -> DataFrame:
    """feature, importance (shares of 1), place: what the boosted filter's trees gain by each feature, all features listed.

    Fitted with class weights on a hash-chosen 85 %. Rows with a null label are left out; null features count as zero. Equal
    importances are placed by name. A label of one class has no model and raises an error.
    """
    with training_table(df.select(key, *features, label), "features") as rows:
        x = class_weights(rows.filter(F.col(label).isNotNull()).na.fill(0.0, features), label).filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) >= 15)
        if x.select(label).distinct().limit(2).count() < 2:
            raise ValueError(f"{label} has fewer than two classes")
        x = VectorAssembler(inputCols=features, outputCol="__x").transform(x)
        model = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=iterations, maxDepth=4, seed=seed).fit(x)
    gained = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda v: (-v[1], v[0]))
    return df.sparkSession.createDataFrame([(name, v, i) for i, (name, v) in enumerate(gained, 1)], "feature string, importance double, place int")


def cross_validated(df: DataFrame, key: str, features: list[str], label: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """fold, n, balanced_accuracy: each fold by a hash of the key, scored by boosted trees fitted on the others."""
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(class_weights(df, label).withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")))
    gbt = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=5, maxDepth=3, seed=seed)
    out = None
    for i in range(folds):
        scored = gbt.fit(x.filter(F.col("fold") != i)).transform(x.filter(F.col("fold") == i)).select("fold", label, "prediction")
        out = scored if out is None else out.unionByName(scored)
    hit = lambda y: F.try_divide(F.count(F.when((F.col(label) == y) & (F.col("prediction") == y), 1)), F.count(F.when(F.col(label) == y, 1)))
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round((hit(0) + hit(1)) / 2, 6).alias("balanced_accuracy"))


def forest_classes(df: DataFrame, key: str, features: list[str], label: str, trees: int = 20, seed: int = 7) -> DataFrame:
    """key, predicted, split: a weighted forest over all classes, fitted on a hash-chosen 80 %, scored on all rows."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))
    x = class_weights(df, label).withColumn("split", F.when(h < 20, "test").otherwise("train"))
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(x)
    forest = RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=6, seed=seed)
    return forest.fit(spread(x.filter("split = 'train'"), [key], df.count())).transform(x).select(key, label, F.col("prediction").alias("predicted"), "split")


def fold_of(key: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def boosted_classes(df: DataFrame, key: str, features: list[str], label: str, iterations: int = 8, seed: int = 7) -> DataFrame:
    """key, label, predicted, probabilities (by class, summing to 1), split: boosted trees against the rest for each class.

    Fitted with class weights on a hash-chosen 80 % (equal rows as one, with their weights summed), scored on all rows. The trees' margins pass the logistic function that
    they were fitted for, which makes them comparable between classes; of equal classes the smallest is predicted. Classes are
    few: they are listed on the driver.
    """
    x = class_weights(df, label).withColumn("split", F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < 20, "test").otherwise("train"))
    vectors = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    train = persist_table(weighted_rows(x.filter("split = 'train'"), [*features, label]), "train")
    classes = sorted(r[0] for r in train.select(label).distinct().collect())
    fit_on = vectors.transform(spread(train, features, train.count()))
    out = vectors.transform(x).withColumn("__p", F.array().cast("array<double>"))
    for c in classes:
        one = fit_on.withColumn("__y", (F.col(label) == c).cast("double"))
        model = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=iterations, maxDepth=4, seed=seed).fit(one)
        out = model.transform(out).withColumn("__p", F.concat("__p", F.array(vector_to_array("probability")[1]))).drop("rawPrediction", "probability", "prediction")
    remove_tables(train)
    total = F.aggregate("__p", F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn("probabilities", F.transform("__p", lambda v: v / total))
    best = F.array_position("__p", F.array_max("__p")).cast("int")
    return out.select(key, label, F.element_at(F.array(*map(F.lit, classes)), best).alias("predicted"), "probabilities", "split")


def out_of_fold(x: DataFrame, fold: str, members: dict, label: str, folds: int, keep: list[str]) -> DataFrame:
    """Each row's probability by each member, fitted on the other folds only: ``keep`` and a column a member."""
    parts = []
    for i in range(folds):
        scored = x.filter(F.col(fold) == i)
        for name, make in members.items():
            model = make().fit(x.filter(F.col(fold) != i))
            scored = model.transform(scored).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        parts.append(scored.select(*keep, *members))
    return reduce(DataFrame.unionByName, parts)


def balanced_accuracy(p: str, label: str) -> Column:
    hit = lambda y, right: F.try_divide(F.count_if((F.col(label) == y) & right), F.count_if(F.col(label) == y))
    return (hit(1, F.col(p) > 0.5) + hit(0, F.col(p) <= 0.5)) / 2


def stacked_ensemble(df: DataFrame, key: str, features: list[str], label: str, folds: int = 3, least: float = 0.1, seed: int = 7) -> DataFrame:
    """key, label, fold, one column a member, weighted, votes, stacked: probabilities that no model gave for a row it had seen.

    Members (a logistic regression, a forest, boosted trees) are fitted out of fold. ``weighted`` is their mean by balanced
    accuracy, at least ``least`` each; ``votes`` the share of members above one half; ``stacked`` a logistic regression on
    the members' probabilities, itself fitted on the other folds.
    """
    x = class_weights(df.select(key, *features, label), label).withColumn("fold", fold_of(key, folds, seed))
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(x)
    common = {"featuresCol": "__x", "labelCol": label, "weightCol": "weight"}
    members = {
        "logistic": lambda: LogisticRegression(**common, maxIter=30), "forest": lambda: RandomForestClassifier(**common, numTrees=10, maxDepth=5, seed=seed),
        "boosted": lambda: GBTClassifier(**common, maxIter=6, maxDepth=3, seed=seed),
    }
    base = persist_table(out_of_fold(x, "fold", members, label, folds, [key, label, "weight", "fold"]), "members")
    metric = base.agg(*(F.greatest(F.coalesce(balanced_accuracy(m, label), F.lit(0.5)), F.lit(least)).alias(m) for m in members)).first()
    total = sum(metric)
    weighted = sum((F.col(m) * (metric[m] / total) for m in list(members)[1:]), F.col("logistic") * (metric["logistic"] / total))
    votes = sum(((F.col(m) > 0.5).cast("int") for m in list(members)[1:]), (F.col("logistic") > 0.5).cast("int")) / len(members)
    second = VectorAssembler(inputCols=[*members], outputCol="__x").transform(base)
    stacked = out_of_fold(second, "fold", {"stacked": lambda: LogisticRegression(**common, maxIter=30)}, label, folds, [key, label, "fold", *members])
    return stacked.select(key, label, "fold", *members, weighted.alias("weighted"), votes.alias("votes"), "stacked")


def stacked_windows(df: DataFrame, key: str, pixel: str, features: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """Multi-window inference: each window scored by the boosted filter, then the windows of a pixel stacked over time."""
    scored = df.select(key, pixel).join(boosted_filter(df, key, features, label), key)
    return temporal_stack(scored, pixel, F.col("probability") >= threshold, F.col("probability"))
