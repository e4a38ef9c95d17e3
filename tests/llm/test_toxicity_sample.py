"""Training sequences beyond the bound are taken at even steps from all documents of a class."""

from __future__ import annotations

import pytest

pytest.importorskip("pyarrow")
from millrace.llm import toxicity  # noqa: E402


class Fitted(Exception):
    pass


def test_late_toxic_documents_take_part(spark, monkeypatch):
    seen = {}

    def fit(self, seqs, labels, weight, **_):
        seen.update(index=self.index, found={f for s in seqs for fs in s for f in fs}, weight=float(weight[[any(y) for y in labels]].sum()))
        raise Fitted

    monkeypatch.setattr(toxicity.Crf, "fit", fit)
    # 130 toxic documents of 204 sequences; the last 20 in order of str(id) have a word of their own.
    docs = [(i, " ".join(["vile" if i < 210 else "foul"] * 48 * 204)) for i in range(100, 230)] + [(i, "good calm words") for i in range(300, 400)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in docs], "doc_id bigint, toxic int")
    with pytest.raises(Fitted):
        toxicity.train(spark.createDataFrame(docs, "doc_id bigint, text string"), labels)
    assert {seen["index"]["=vile"], seen["index"]["=foul"]} <= seen["found"]
    assert seen["weight"] == 130 * 204
