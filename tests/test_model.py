"""The ridge model against the normal equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from audira.operators import prelaunch


def frame_of(spark, x, y):
    rows = [(f"e{i}", *map(float, r), None if v is None else float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    names = [f"f{j}" for j in range(len(x[0]))]
    return spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{n} double" for n in names) + ", target double"), names


@pytest.mark.parametrize("alpha", [1.0, 10.0])
def test_ridge_matches_the_normal_equations(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)) * [1, 100, 0.01, 1] + [0, 5, 7, 0]
    x[:, 3] = 2.5  # a constant feature has no say
    y = np.exp(1 + x[:, 0] * 0.3 + x[:, 1] * 0.01 + rng.normal(size=40) * 0.1)
    frame, names = frame_of(spark, x.tolist(), y.tolist())
    fit = prelaunch.ridge_log_regression(frame, names, alpha=alpha)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1.0)
    z[:, 3] = 0
    label = np.log1p(y)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (label - label.mean()))
    assert np.allclose(fit.coefficients, w, rtol=1e-9, atol=1e-11)
    want = np.maximum(np.expm1(label.mean() + z @ w), 0)
    got = {r.entity_id: r.prediction for r in prelaunch.ridge_predictions(frame, fit).collect()}
    assert np.allclose([got[f"e{i}"] for i in range(40)], want, rtol=1e-8)


def test_too_few_labels_give_no_model(spark):
    frame, names = frame_of(spark, [[i] for i in range(14)], [1.0] * 11 + [None] * 3)
    assert prelaunch.ridge_log_regression(frame, names) is None
    assert prelaunch.ridge_predictions(frame, None).where("prediction IS NOT NULL").count() == 0


def test_equal_labels(spark):
    frame, names = frame_of(spark, [[i] for i in range(14)], [3.0] * 14)
    fit = prelaunch.ridge_log_regression(frame, names)
    assert {round(r.prediction, 9) for r in prelaunch.ridge_predictions(frame, fit).collect()} == {3.0}


def test_all_features_on_the_tables(spark, sf_dir):
    from audira.plans.prelaunch_queries import METRICS, SPEC
    from audira.sources import bindings as b

    fact = b.metric_long(spark, sf_dir, METRICS, title=True)
    frame, names = prelaunch.prelaunch_features_cutoff(fact, b.entity_dim(spark, sf_dir), "W-1", SPEC)
    fit = prelaunch.ridge_log_regression(frame, names)
    data = frame.where("target IS NOT NULL").select(*names, "target").toPandas()
    x, y = data[names].to_numpy(), np.log1p(data["target"].to_numpy())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(len(names)), z.T @ (y - y.mean()))
    assert fit.rows == len(data) and np.allclose(fit.coefficients, w, rtol=1e-8, atol=1e-10)


def test_postprocess_clips_and_shrinks(spark):
    labels = spark.createDataFrame([(float(v),) for v in range(1, 102)], "label double")
    rows = [("low", -5.0, 1.0), ("high", 500.0, 1.0), ("thin", 96.0, 0.5)]
    preds = spark.createDataFrame(rows, "entity_id string, prediction double, coverage double")
    got = {r.entity_id: r.prediction for r in prelaunch.prediction_postprocess(preds, labels).collect()}
    assert got == {"low": 6.0, "high": 96.0, "thin": pytest.approx(0.7 * 96 + 0.3 * 51)}


def test_errors_ignore_zero_actuals(spark):
    df = spark.createDataFrame([(2.0, 1.0), (3.0, 0.0), (1.0, -2.0)], "prediction double, actual double")
    assert prelaunch.mape(df).first()[0] == pytest.approx(125.0)
    signed = df.select(prelaunch.signed_error(F.col("prediction"), F.col("actual"))).collect()
    assert [r[0] for r in signed] == [100.0, None, 150.0]
