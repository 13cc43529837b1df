"""The vector index against exact search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefold.operators import vector_index as V
from lorefold.operators.ranking import knn

DIM = 24


@pytest.fixture(scope="module")
def items(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, DIM))
    x = centres[r.integers(0, 40, 3000)] + 0.5 * r.standard_normal((3000, DIM))
    x[::7] = x[0]  # a hot vector
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * DIM, 0), (9003, [float("nan")] * DIM, 0)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, kind int").repartition(4).cache()


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    before, V.PART_ROWS = V.PART_ROWS, 100
    yield V.build(items, f"file://{tmp_path_factory.mktemp('index')}/i", keep=("kind",))
    V.PART_ROWS = before


def asked(items, mod=50):
    return items.where(F.col("id") % mod == 3).select(F.col("id").alias("qid"), F.transform("embedding", lambda v: v * 0.9 + 0.05).alias("embedding"))


def lists(df):
    return {(r.qid, r["rank"]): (r.id, round(r.score, 5)) for r in df.collect()}


def test_every_row_with_a_direction_is_indexed(items, index):
    assert index.rows().count() == 3000
    assert index.rows().groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 600


@pytest.mark.parametrize("where", [None, "kind = 1"])
def test_exact_search_equals_comparing_all(items, index, where):
    q = asked(items)
    want = lists(knn(items.where(where) if where else items, q, 12))
    assert len(want) == 12 * q.where("qid < 3000").count()
    assert lists(index.search(q, 12, probe=1, where=where, exact=True)) == want


def test_a_few_cells_hold_nine_of_ten(items, index):
    q = asked(items, 25)
    want, got = ({(r.qid, r.score) for r in df.collect()} for df in (knn(items, q, 12), index.search(q, 12, probe=8)))
    assert len(want & got) >= 0.9 * len(want)


def test_bounds_of_codes_are_sure():
    r = np.random.default_rng(6)
    x = r.standard_normal((500, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = V.fit(x, 10)
    cell, codes, low, step, lost = V.encoded(x, centroids)
    q = x[:50]
    near = (q @ centroids.T)[:, cell] + q.sum(axis=1)[:, None] * low + (q @ codes.T) * step
    assert (np.abs(near - q @ x.T) <= lost[None, :] + 1e-9).all()


def test_fewer_rows_than_the_limit_and_refused_queries(spark, items, index):
    q = asked(items, 500)
    few = index.search(q, 12, probe=1, where="id < 5", exact=True)
    assert {r.n for r in few.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {5}
    with pytest.raises(ValueError, match="repeated"):
        index.search(q.unionByName(q))
    with pytest.raises(ValueError, match="dimensions"):
        index.search(spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"))


def test_recall_of_the_registered_near_query(spark):
    from lorefold.plans.registry import QUERIES
    from tests.conftest import SMALL

    want, got = ({(r.qid, r.score) for r in QUERIES[n](spark, SMALL).collect()} for n in ("knn_topk", "knn_indexed_near"))
    assert len(want & got) >= 0.9 * len(want)


def test_query_blocks_of_exact_search_are_released_one_by_one(spark, items, monkeypatch):
    q = asked(items)
    want = lists(knn(items, q, 5))
    monkeypatch.setattr("lorefold.operators.ranking.QUERY_BYTES", 10 * DIM * 8)
    assert lists(knn(items, q, 5)) == want


def test_a_second_look_hands_on_only_what_reaches_the_first_lists(items, index, monkeypatch):
    """Queries go to a task once with the cells that they look at, and rows below the last score of a query's first list aren't paired with it."""
    kept, write = [], V.written
    monkeypatch.setattr(V, "written", lambda df, name: kept.append((name, out := write(df, name))) or out)
    q = asked(items)
    n, cells = q.where("qid < 3000").count(), len(index._about.value.cells)
    assert lists(index.search(q, 12, probe=cells, exact=True)) == lists(knn(items, q, 12))
    asks = [df for name, df in kept if name == "probes"]
    assert all(df.groupBy("qid", "task").count().where("count > 1").isEmpty() for df in asks)
    assert asks[0].select(F.explode("cells")).count() > asks[0].count() >= n
    rows = index.rows().join(index.spark.createDataFrame(list(zip(index._about.value.cells.tolist(), index._about.value.task.tolist())), "cell int, task int"), "cell")
    codes = rows.select((F.col("task") + F.col("part")).alias("task"), "cell", "id", "codes", "low", "step", "lost")
    dealt = asks[1].unionByName(codes, allowMissingColumns=True).repartition("task").sortWithinPartitions("task", F.asc_nulls_first("cell"))
    left = dealt.mapInArrow(V._screened(index._about, DIM, 12), "qid long, id long, cell int")
    reach = knn(items, q, 3000, 3000).join(knn(items, q, 12).where("rank = 12").select("qid", F.col("score").alias("last")), "qid").where("score >= last - 0.01").count()
    assert 12 * n <= left.count() <= reach
