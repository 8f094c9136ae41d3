"""Cases from the review of round 2."""

import numpy as np
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from storecast.models import trees
from storecast.plans import q_models


def _sales(spark, n=1200):
    rng = np.random.default_rng(5)
    rows = [(i, float(3 * (i % 7) + 10 * (i % 2) + rng.normal() * 4), int(i % 2), int(i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "store_nbr long, sales double, onpromotion int, day_of_week int")
    for c in trees.FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df.repartition(4, "store_nbr").checkpoint()


def test_models_use_source_settings():
    assert q_models.P == {"max_iter": 1000, "step": 0.05, "depth": 10, "seed": 42, "patience": 50}


def test_stepwise_growth_stops_and_equals_plain_fit(spark):
    df = _sales(spark)
    train, val = df.where("store_nbr < 900"), df.where("store_nbr >= 900")
    model, errors, best = trees.fit_early_stop(train, val, 200, 0.3, 4, patience=3)
    # Growth ends in the block in which the best round fell 3 behind.
    assert best + 3 < len(errors) <= best + 3 + trees.BLOCK and len(errors) < 200
    assert model.getNumTrees == best + 1 and best == trees.best_round(errors, 3)
    plain = GBTRegressor(featuresCol="features", labelCol="label", maxIter=best + 1, stepSize=0.3, maxDepth=4,
                         seed=42, maxBins=64).fit(trees.labelled(train))
    rows = trees.labelled(val)
    ours = [r.prediction for r in model.transform(rows).orderBy("store_nbr").collect()]
    theirs = [r.prediction for r in plain.transform(rows).orderBy("store_nbr").collect()]
    assert np.allclose(ours, theirs, rtol=1e-9)
    assert np.allclose(errors[:best + 1], plain.evaluateEachIteration(rows, "squared"), rtol=1e-9)
