"""Near duplicates do not depend on the size of a bucket."""

import pytest
from pyspark.sql import functions as F

from driftwell.llm import simhash


@pytest.mark.parametrize("bands", [1, 8])
def test_long_buckets_lose_no_pair(spark, monkeypatch, bands):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:-k], *[f"x{k}y{j}" for j in range(k)]]) for k in range(1, 13)]
    rows = simhash.cut(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    monkeypatch.setattr(simhash, "BANDS", bands)

    def labels():
        return {r.row: r.label for r in simhash.similar(rows).select(F.col("row"), F.col("label")).collect()}

    wanted = labels()
    monkeypatch.setattr(simhash, "PIECE", 2)
    assert len(set(wanted.values())) < len(texts) and labels() == wanted
