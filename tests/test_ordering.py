"""Orders of ids of all kinds, against a sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_numeric_order_of_all_ids(spark, parts):
    r = random.Random(5)
    ids = [str(r.randrange(10**6)) for _ in range(150)] + [f"x{r.randrange(500)}" for _ in range(150)] + ["007", "7", "9" * 30, "1" + "0" * 30, "", " 12 ", "A1", "x", "-3", None]
    got = ordering.positions_by(spark.createDataFrame([(i,) for i in ids], "id string"), ordering.numeric_first(F.col("id")), parts).collect()

    def place(i):
        v = (i or "").strip()
        return (i is None, (0, int(v), v) if v.isascii() and v.isdigit() else (1, 0, v), i or "")

    assert [x["position"] for x in sorted(got, key=lambda x: x["position"])] == list(range(len(ids)))
    assert [x["id"] for x in sorted(got, key=lambda x: x["position"])] == sorted(ids, key=place)
