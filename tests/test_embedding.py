"""Providers in batches: one load a worker, budgets, windows pooled, wrong vectors refused."""

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefold.operators import embedding as E

DIM = 8


def letters(texts):
    """Counts of bytes by their remainder, shifted by one."""
    return [np.bincount(np.frombuffer(t.encode(), np.uint8) % DIM, minlength=DIM) + 1.0 for t in texts]


def test_batches_keep_the_budget():
    sizes = [5, 90, 5, 40, 200, 40, 1]
    got = E.batches(sizes, 100)
    assert sorted(i for b in got for i in b) == list(range(7))
    assert all(len(b) == 1 or len(b) * max(sizes[i] for i in b) <= 100 for b in got)
    assert E.batches([], 10) == []


def test_one_load_a_worker_and_pooled_windows(spark, tmp_path):
    def load():
        (tmp_path / f"load-{uuid.uuid4().hex}").touch()

        def model(texts):
            (tmp_path / f"batch-{uuid.uuid4().hex}-{len(texts) * max(map(len, texts))}").touch()
            return letters(texts)

        return model

    embed = E.provided(uuid.uuid4().hex, load, DIM, "q: ", 20, len, 100)
    texts = spark.range(400).repartition(40).select("id", F.when(F.col("id") % 10 > 0, F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), (F.col("id") % 7).cast("int"))).alias("text"))
    got = {r.id: (r.text, r.v) for r in texts.withColumn("v", embed(F.col("text"))).collect()}
    assert len(got) == 400
    for text, v in got.values():
        if text is None:
            assert v is None
            continue
        mean = np.mean(letters(E.split_windows("q: ", text, 20, len)), axis=0)
        assert np.allclose(v, mean / np.linalg.norm(mean), atol=1e-6)
    made = [p.name.split("-") for p in Path(tmp_path).iterdir()]
    assert 1 <= sum(m[0] == "load" for m in made) <= 8  # 40 tasks on 8 workers
    assert all(int(m[2]) <= 100 for m in made if m[0] == "batch")


@pytest.mark.parametrize("bad", [lambda t: letters(t)[1:], lambda t: [np.zeros(DIM)] * len(t), lambda t: [np.full(DIM, np.nan)] * len(t)])
def test_wrong_vectors_are_errors(spark, bad):
    embed = E.provided(uuid.uuid4().hex, lambda: bad, DIM)
    with pytest.raises(Exception, match="the provider gave"):
        spark.createDataFrame([("a",)], "text string").select(embed(F.col("text"))).collect()
