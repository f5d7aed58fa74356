"""Queries on the personal model and its corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import FEATURES
from ..operators import learn
from ..storage import checkpoint_folder, written
from . import views
from .dashboards import _feature_sql, _samples


def m1_features(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    values = learn.features(photos.columns)
    return photos.select("id", *(F.when(~F.isnan(c), c).alias(n) for n, c in zip(FEATURES, values, strict=True)))


def m3_pairwise_samples(spark, sf_dir):
    rows = learn.pairwise_samples(views.comparisons(spark, sf_dir), views.photos(spark, sf_dir))
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 4).alias("overall"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.avg("sharpness_score"), 4).alias("sharpness"))


def _corpus(spark, sf_dir):
    synthetic = learn.pairwise_samples(views.comparisons(spark, sf_dir), views.photos(spark, sf_dir))
    return learn.training_corpus(_samples(spark, sf_dir), synthetic)


def m5_sample_weights(spark, sf_dir):
    rows = learn.sample_weights(_corpus(spark, sf_dir), "2024-07-01 00:00:00")
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


_PAIRS = """t AS (SELECT id, SUM(won) AS wins, SUM(1 - won) AS losses, MAX(decided_at) AS decided_at FROM (SELECT winner_id AS id, 1 AS won, decided_at FROM comparisons UNION ALL SELECT loser_id, 0, decided_at FROM comparisons) x GROUP BY id),
    y AS (SELECT CASE WHEN wins >= losses THEN 'keep' ELSE 'reject' END AS decision, t.decided_at, p.overall_score, p.sharpness_score FROM t JOIN photos p ON p.id = t.id)"""
_M5 = f"""WITH {_PAIRS}, c AS (SELECT decision, decided_at, 1.0E0 AS w FROM decisions JOIN photos ON id = image_id UNION ALL SELECT decision, decided_at, 0.4E0 FROM y),
    d AS (SELECT decision, w * POWER(0.5E0, GREATEST(0, EPOCH(TIMESTAMP '2024-07-01 00:00:00') - FLOOR(EPOCH(decided_at))) / 86400.0E0 / 180.0E0) AS w FROM c)
    SELECT decision, COUNT(*) AS n, ROUND(SUM(w) * (SELECT COUNT(*) / SUM(w) FROM d), 3) AS weight FROM d GROUP BY decision"""


def m7_personal_scores(spark, sf_dir):
    """Scores of all photos by a model trained on the decided ones."""
    corpus = written(learn.sample_weights(_corpus(spark, sf_dir), "2024-07-01 00:00:00"))
    model = learn.train_personal(corpus)
    return learn.predict_personal(model, views.photos(spark, sf_dir))


def m7_constant_model(spark, sf_dir):
    """All that the model has seen was kept, so it moves every score up as far as it may; saved and loaded again before it is asked."""
    corpus = written(learn.sample_weights(_corpus(spark, sf_dir).where("decision = 'keep'"), "2024-07-01 00:00:00"))
    photos = views.photos(spark, sf_dir).withColumn("overall_score", F.when(F.col("id") % 9 > 0, F.col("overall_score")))
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    learn.save_model(learn.train_personal(corpus, 2), path, spark)
    found = learn.predict_with_uncertainty(learn.load_model(path, spark), learn.uncertainty_ensemble(corpus, 3, 2), photos)
    return found.select("id", F.round("personal_score", 6).alias("personal_score"), F.round("personal_std", 6).alias("personal_std"))


def m8_validation(spark, sf_dir):
    """Ten models of fifty trees, each asked about the fifth of the samples that it hasn't seen."""
    return learn.validate(_corpus(spark, sf_dir))


def m9_uncertainty(spark, sf_dir):
    """Scores of all photos by the model, and their spread by twenty models of fifty trees."""
    corpus = written(learn.sample_weights(_corpus(spark, sf_dir), "2024-07-01 00:00:00"))
    return learn.predict_with_uncertainty(learn.train_personal(corpus), learn.uncertainty_ensemble(corpus), views.photos(spark, sf_dir))


def m11_retrain_due(spark, sf_dir):
    return learn.retrain_due(_samples(spark, sf_dir), 100)


QUERIES = {
    "m1_features": (m1_features, f"SELECT id, {', '.join(f'{_feature_sql(f)} AS {f}' for f in FEATURES)} FROM photos".replace("CAST(CAST(", "CAST((").replace(" AS FLOAT) AS DOUBLE)", ") AS DOUBLE)")),
    "m3_pairwise_samples": (m3_pairwise_samples, f"WITH {_PAIRS} SELECT decision, COUNT(*) AS n, ROUND(AVG(overall_score), 4) AS overall, ROUND(0.4E0 * COUNT(*), 4) AS weight, ROUND(AVG(sharpness_score), 4) AS sharpness FROM y GROUP BY decision"),
    "m5_sample_weights": (m5_sample_weights, _M5),
    "m7_personal_scores": (m7_personal_scores, None),
    "m7_constant_model": (m7_constant_model, "SELECT id, CASE WHEN id % 9 > 0 THEN LEAST(100, ROUND(overall_score + 25, 6)) END AS personal_score, CASE WHEN id % 9 > 0 THEN 0.0E0 END AS personal_std FROM photos"),
    "m8_validation": (m8_validation, None),
    "m9_uncertainty": (m9_uncertainty, None),
    "m11_retrain_due": (m11_retrain_due, "SELECT COUNT(*) AS samples, (COUNT(*) >= 30 AND COUNT(*) - 100 >= 10) AS due FROM decisions JOIN photos ON id = image_id"),
}
