"""The labelled sample beside repeated rows."""

import pytest

from reelspark.llm import quality


def test_copies_do_not_drive_a_class_out(spark, make, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, y, **how: seen.update(x=x, y=y))
    docs = make([(1, "short copy")] * 9 + [(2, "a much longer text " * 50), (2, None), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    quality.learn(docs, labels, max_rows=2)
    assert sorted(seen["y"]) == [0, 1]
    first = seen["x"].tolist()
    quality.learn(docs.repartition(5), labels, max_rows=2)
    assert seen["x"].tolist() == first and len(seen["y"]) <= 2


@pytest.mark.parametrize("n", [1, 3])
def test_no_more_rows_than_marks(spark, make, monkeypatch, n):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, y, **how: seen.update(y=y))
    quality.learn(make([(i % 4, f"text {i}") for i in range(40)]), spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"), max_rows=n)
    assert len(seen["y"]) == n
