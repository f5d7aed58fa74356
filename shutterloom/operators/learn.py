"""The personal model: features, corpus, training, prediction, validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES, SCENES, SCHEMA_VERSION
from ..functions.scores import clamp, zero
from ..storage import spread, written
from .dashboard import pairwise_tallies
from .forests import Forests, Plan, train

HALF_LIFE_DAYS = 180.0
LEAST_SAMPLES = 30
#: A prediction moves the overall score by this much at most.
REACH = 25.0
LABELS = {"keep": 1.0, "maybe": 0.0, "reject": -1.0}


def features(columns: list[str]) -> list[Column]:
    """M1: the 31 features in order, from the catalog columns that there are; null becomes NaN, scenes are 0 or 1."""
    nan = F.lit(float("nan"))

    def one(name: str) -> Column:
        if name == "face_present":
            return (zero(F.col("face_detected")) == 1).cast("double") if "face_detected" in columns else F.lit(0.0)
        if name.startswith("scene_is_"):
            scene = name.removeprefix("scene_is_")
            assert scene in SCENES
            return F.coalesce((F.col("scene") == scene).cast("double"), F.lit(0.0)) if "scene" in columns else F.lit(0.0)
        return F.coalesce(F.col(name).cast("double"), nan) if name in columns else nan

    return [one(name).alias(name) for name in FEATURES]


def features_to_json(columns: list[str]) -> Column:
    """M2: the features by name, NaN as null."""
    values = [F.when(~F.isnan(c), c).alias(name) for name, c in zip(FEATURES, features(columns), strict=True)]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def features_from_json(text: Column) -> list[Column]:
    """M2: unknown names are ignored, missing ones are NaN."""
    values = F.from_json(text, "map<string,double>")
    return [F.coalesce(values[name], F.lit(float("nan"))).alias(name) for name in FEATURES]


def pairwise_samples(comparisons: DataFrame, images: DataFrame, weight: float = 0.4) -> DataFrame:
    """M3: a sample for each compared photo: keep if it won at least as often as it lost."""
    rows = pairwise_tallies(comparisons).join(images, "id")
    decision = F.when(F.col("wins") >= F.col("losses"), "keep").otherwise("reject")
    return rows.select(decision.alias("decision"), "overall_score", F.lit(weight).alias("weight"), F.col("last_decided").alias("decided_at"), *features(rows.columns))


def training_corpus(samples: DataFrame, synthetic: DataFrame | None = None, least: int = LEAST_SAMPLES) -> DataFrame:
    """M4: frozen samples with weight 1, and synthetic ones; no row if there are fewer than `least` frozen ones."""
    real = samples.select("decision", "overall_score", F.lit(1.0).alias("weight"), "decided_at", *features_from_json(F.col("features_json")))
    both = real if synthetic is None else real.unionByName(synthetic)
    # One row that says whether there are enough.
    enough = samples.agg((F.count("*") >= least).alias("enough")).where("enough")
    return both.join(F.broadcast(enough), F.lit(True), "left_semi")


def sample_weights(corpus: DataFrame, as_of: str, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """M5: corpus with `weight` halved every half-life before as_of, then scaled to a mean of 1; an unknown date has no decay."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("decided_at").cast("timestamp"))
    age = F.greatest(F.lit(0.0), seconds / 86400)
    decayed = corpus.withColumn("weight", F.col("weight") * F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0)))
    sums = decayed.agg((F.count("*") / F.sum("weight")).alias("__scale"))
    return decayed.join(F.broadcast(sums), F.lit(True)).withColumn("weight", F.col("weight") * F.col("__scale")).drop("__scale")


def labelled(corpus: DataFrame) -> DataFrame:
    label = F.lit(None).cast("double")
    for name, value in LABELS.items():
        label = F.when(F.col("decision") == name, value).otherwise(label)
    return corpus.withColumn("label", label).where("label is not null")


def _pipeline(rows: DataFrame, trees: int, rate: float, share: float, seed: int, weighted: bool) -> Pipeline:
    """Mean imputation (a feature that no row has is left out), assembly, boosted trees."""
    known = rows.agg(*(F.count_if(~F.isnan(F.col(f))).alias(f) for f in FEATURES)).first()
    used = [f for f in FEATURES if known[f]]
    filled = [f"{f}__filled" for f in used]
    booster = GBTRegressor(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=3, stepSize=rate, subsamplingRate=share, seed=seed)
    if weighted:
        booster = booster.setWeightCol("weight")
    return Pipeline(stages=[Imputer(inputCols=used, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), booster])


def train_personal(corpus: DataFrame, trees: int = 200, rate: float = 0.05, share: float = 0.8, seed: int = 42, weighted: bool = True) -> PipelineModel:
    """M6: boosted trees on labels 1, 0 and -1."""
    rows = labelled(corpus)
    rows = written(spread(rows.withColumn("key", F.xxhash64(*rows.columns)), "key"))
    return _pipeline(rows, trees, rate, share, seed, weighted).fit(rows)


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance)."""
    names = [c.removesuffix("__filled") for c in model.stages[1].getInputCols()]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.stages[2].featureImportances.toArray(), strict=True)], "feature string, importance double")


def _moved(overall: Column, raw: Column) -> Column:
    return clamp(overall + clamp(REACH * raw, -REACH, REACH), 0.0, 100.0)


def predict_personal(model: PipelineModel, images: DataFrame) -> DataFrame:
    """M7: (id, personal_score): the overall score moved by up to REACH, within 0 and 100; null without one."""
    rows = images.select("id", "overall_score", *features(images.columns))
    return model.transform(rows).select("id", _moved(F.col("overall_score"), F.col("prediction")).alias("personal_score"))


def _keyed(corpus: DataFrame, weighted: bool) -> DataFrame:
    """labelled() rows with a key by their content."""
    rows = labelled(corpus).withColumn("key", F.xxhash64("decision", "overall_score", "decided_at", *FEATURES))
    return rows if weighted else rows.withColumn("weight", F.lit(1.0))


def uncertainty_ensemble(corpus: DataFrame, members: int = 20, trees: int = 50, seed: int = 42) -> Forests:
    """M9: small models that differ by what each of their trees sees, 0.7 of the samples by seed; all are trained at once."""
    return train(_keyed(corpus, True), FEATURES, Plan(tuple(range(seed, seed + members)), trees, 0.1, share=0.7))


def predict_with_uncertainty(model: PipelineModel, ensemble: Forests | None, images: DataFrame) -> DataFrame:
    """M9: (id, personal_score, personal_std): the spread is the population deviation of the members' scores, 0 without members."""
    rows = images.select("id", "overall_score", *features(images.columns))
    out = model.transform(rows).withColumn("personal_score", _moved(F.col("overall_score"), F.col("prediction"))).select("id", "overall_score", "personal_score", *FEATURES)
    if ensemble is None:
        return out.select("id", "personal_score", F.lit(0.0).alias("personal_std"))
    raw = ensemble.predictions([F.col(f) for f in FEATURES])
    out = out.select("id", "personal_score", "overall_score", raw.alias("raw")).withColumn("scores", F.transform("raw", lambda x: _moved(F.col("overall_score"), x)))
    mean = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.size("scores")
    out = out.withColumn("mean", mean)
    spread = F.aggregate("scores", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    return out.select("id", "personal_score", F.sqrt(spread / F.size("scores")).alias("personal_std"))


def with_personal(model: PipelineModel, ensemble: Forests | None, images: DataFrame) -> DataFrame:
    """images with personal_score and personal_std in place of what they had, as a culling with a ready model wants them."""
    found = predict_with_uncertainty(model, ensemble, images)
    return images.drop("personal_score", "personal_std").join(found, "id", "left")


def _right(score: Column) -> Column:
    """Whether the score gives the sample's decision with the fixed cutoffs 70 and 50."""
    return (F.when(score >= 70, "keep").when(score >= 50, "maybe").otherwise("reject") == F.col("decision")).cast("double")


def validate(corpus: DataFrame, margin: float = 0.05, trees: int = 50) -> DataFrame:
    """M8: one row (accuracy, baseline, beats_baseline, margin, splits): mean accuracy of models and of the plain score over splits of 4 to 1, and whether the models win by the margin.

    There are as many splits as a fifth of the samples, 10 at most. Each has a model of its own, trained without the fifth of the samples that it is
    asked about; all are trained at once. A null overall score counts as 0. Fewer than 5 samples give zeros and no split.
    """
    rows = written(_keyed(corpus, False).withColumn("overall_score", F.coalesce("overall_score", F.lit(0.0))))
    n = rows.count()
    if n < 5:
        return rows.sparkSession.createDataFrame([(0.0, 0.0, False, 0.0, 0)], "accuracy double, baseline double, beats_baseline boolean, margin double, splits int")
    plan = Plan(tuple(range(42, 42 + min(10, n // 5))), trees, 0.1, out=0.2)
    models = train(rows, FEATURES, plan)

    def left_out(key: pd.Series) -> pd.Series:
        return pd.Series(list(plan.left_out(key.to_numpy())), dtype=object)

    asked = rows.select("decision", "overall_score", models.predictions([F.col(f) for f in FEATURES]).alias("raw"), F.pandas_udf(left_out, "array<boolean>")("key").alias("out"))
    each = asked.select("decision", "overall_score", F.posexplode(F.arrays_zip("raw", "out")).alias("split", "x")).where("x.out")
    right = each.groupBy("split").agg(F.avg(_right(_moved(F.col("overall_score"), F.col("x.raw")))).alias("a"), F.avg(_right(F.col("overall_score"))).alias("b"))
    accuracy, baseline = F.avg("a"), F.avg("b")
    found = right.agg(accuracy.alias("a"), baseline.alias("b"), F.count("*").cast("int").alias("splits"))
    return found.select(F.round("a", 3).alias("accuracy"), F.round("b", 3).alias("baseline"), (F.col("a") - F.col("b") >= margin).alias("beats_baseline"), F.round(F.col("a") - F.col("b"), 3).alias("margin"), "splits")


def save_model(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """The model with its schema version and feature count beside it."""
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"schema_version": SCHEMA_VERSION, "n_features": len(FEATURES)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> PipelineModel:
    """Refuses a model of another schema version or number of features."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if (meta["schema_version"], meta["n_features"]) != (SCHEMA_VERSION, len(FEATURES)):
        raise ValueError(f"the model is for other features: {meta}")
    return PipelineModel.load(f"{path}/model")


def retrain_due(samples: DataFrame, trained: int | None, least: int = LEAST_SAMPLES, step: int = 10) -> DataFrame:
    """(samples, due)."""
    n = F.count("*")
    fresh = F.lit(True) if trained is None else n - F.lit(trained) >= step
    return samples.agg(n.alias("samples"), ((n >= least) & fresh).alias("due"))
