"""The ridge head on all components, against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import retrieve


def test_ridge_head_fits_all_components(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 20))
    y = np.clip(1 / (1 + np.exp(-(x @ r.normal(size=20) - 0.5))) + r.normal(size=400) * 0.05, 0, 1)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    rows += [([1.0, None, 2.0], 0.25), (None, 1.0), ([], 0.0), ([5.0] * 20, None)]
    x = np.vstack([x, np.pad([1.0, 0.0, 2.0], (0, 17)), np.zeros((2, 20))])
    p = np.clip(np.r_[y, 0.25, 1.0, 0.0], 1e-4, 1 - 1e-4)
    one = np.column_stack([np.ones(len(x)), x])
    pen = np.eye(21) * 0.3
    pen[0, 0] = 0
    want = np.linalg.solve(one.T @ one + pen, one.T @ np.log(p / (1 - p)))
    df = spark.createDataFrame(rows, "v array<double>, y double").repartition(3)
    got = {g["term"]: g["weight"] for g in retrieve.ridge_head(df, "v", F.col("y"), 0.3).collect()}
    assert list(got) == ["bias", *(f"x{i}" for i in range(1, 21))]
    assert np.allclose(list(got.values()), want, atol=2e-6)
    assert retrieve.ridge_head(df.limit(0), "v", F.col("y"), 0.3).count() == 0
