"""Classifiers over flat windows with pyspark.ml: fit on the cluster, score as P(y = 1)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.functions.scalars import clip, logit, zero_missing


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """df with wt = n / (2 n of the row's class)."""
    n = F.broadcast(df.groupBy(y).agg(F.count(F.lit(1)).cast("double").alias("_c")))
    total = F.broadcast(df.agg(F.count(F.lit(1)).cast("double").alias("_n")))
    return df.join(n, y).crossJoin(total).withColumn("wt", F.col("_n") / (2 * F.col("_c"))).drop("_c", "_n")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({c: zero_missing(F.col(c).cast("double")) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def forest(trees: int = 200, leaf: int = 2, depth: int = 12, seed: int = 42, memory: int = 1024):
    """memory: MB for the histograms of the nodes that are split in one pass; deep levels of many trees need fewer
    passes over the rows with more."""
    return RandomForestClassifier(labelCol="y", weightCol="wt", numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, seed=seed, maxMemoryInMB=memory)


def boosted(rounds: int = 150, depth: int = 5, seed: int = 42):
    return GBTClassifier(labelCol="y", weightCol="wt", maxIter=rounds, maxDepth=depth, seed=seed)


def logistic(l2: float = 1e-3, rounds: int = 300):
    return LogisticRegression(labelCol="y", weightCol="wt", regParam=l2, maxIter=rounds, standardization=True)


MODELS = {"random_forest": forest, "gbm": boosted, "logistic": logistic}
#: What a model reads: flat columns, or window tensors (flattening "full", see sequence.SequenceModel).
MODEL_INPUT = {**dict.fromkeys(MODELS, "flat"), "gru": "seq"}


class Classifier:
    """fit() and score() for one entry of MODELS; data of one class give that class as a constant."""

    def __init__(self, features: list[str], model: str = "random_forest", weighted: bool = True, **options):
        self.features, self.stage, self.fitted, self.constant, self.weighted = features, MODELS[model](**options), None, None, weighted

    def fit(self, df: DataFrame) -> "Classifier":
        seen = [r.y for r in df.select("y").distinct().limit(2).collect()]
        if len(seen) < 2:
            self.constant = float(seen[0]) if seen else 0.0
        else:
            self.fitted = self.stage.fit(assemble(balanced(df) if self.weighted else df.withColumn("wt", F.lit(1.0)), self.features))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """df with p."""
        if self.fitted is None:
            return df.withColumn("p", F.lit(self.constant))
        out = self.fitted.transform(assemble(df, self.features))
        return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self, spark) -> DataFrame:
        rows = [(n, float(v)) for n, v in zip(self.features, self.fitted.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double")


def platt(cal: DataFrame, df: DataFrame) -> DataFrame:
    """df with q: a logistic fit of y on the logit of p, nearly without a penalty."""
    z = lambda d: VectorAssembler(inputCols=["_z"], outputCol="features").transform(d.withColumn("_z", logit(F.col("p"))))
    m = LogisticRegression(labelCol="y", regParam=1e-6, maxIter=300).fit(z(cal))
    return m.transform(z(df)).withColumn("q", vector_to_array("probability")[1]).drop("_z", "features", "rawPrediction", "probability", "prediction")


def isotonic(cal: DataFrame, df: DataFrame) -> DataFrame:
    """df with q: an isotonic fit of y on p, clipped outside its range."""
    m = IsotonicRegression(labelCol="y", featuresCol="p", predictionCol="q").fit(cal.withColumn("y", F.col("y").cast("double")))
    return m.transform(df).withColumn("q", clip(F.col("q"), 0.0, 1.0))
