"""A persisted inverted-file index of vectors: cells around centroids, residual codes with sure error bounds, filtered search, exact rescoring."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranking import top_k, unit

#: Vectors that centroids are fitted on, cells at most, rounds of fitting, rows of a part of a cell, and rows of small cells that a search puts in one task.
SAMPLE, MOST_CELLS, ROUNDS, PART_ROWS, TASK_ROWS = 20_000, 4096, 8, 20_000, 5_000
#: Queries that are compared with all centroids, or with a run of a cell's rows, at once.
ASKED = 256
#: Room for rounding in bounds; steps of a residual code.
SLACK, STEPS = 1e-6, 255
#: Scores are rounded as ranking.knn rounds them.
DIGITS = 6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, dim))


def fit(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; empty ones start again at the vectors that are worst represented."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        score = sample @ centroids.T
        mine = score.argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, mine, sample)
        norm = np.linalg.norm(total, axis=1)
        worst = iter(score.max(axis=1).argsort())
        for c in np.flatnonzero(norm < 1e-9):
            total[c] = sample[next(worst)]
        centroids = total / np.linalg.norm(total, axis=1, keepdims=True)
    return centroids


def encoded(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each unit vector, the residual in STEPS steps between its lowest and highest coordinate, both as floats, and the length of what the steps lose."""
    cell = (x @ centroids.T).argmax(axis=1)
    rest = x - centroids[cell]
    low, high = rest.min(axis=1, initial=0), rest.max(axis=1, initial=0)
    step = np.maximum(high - low, 1e-12) / STEPS
    codes = np.rint((rest - low[:, None]) / step[:, None]).clip(0, STEPS).astype(np.uint8)
    lost = np.linalg.norm(rest - (low[:, None] + codes * step[:, None]), axis=1)
    return cell, codes, low, step, lost


def _assign(centroids, dim: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            cell, codes, low, step, lost = encoded(x, centroids.value)
            near = np.minimum((x * centroids.value[cell]).sum(axis=1), 1)
            columns = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (low, step, lost, np.arccos(near)))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], names=[*names, "cell", "codes", "low", "step", "lost", "angle"])

    return run


def build(items: DataFrame, path: str, keep: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
    """Write an index of items (id, embedding, and the columns to keep for filters) to path and open it.

    Centroids are fitted on at most `sample` vectors, those with the smallest hashes, on the driver; every vector is indexed, in the cell of its nearest centroid. There are about sqrt(n) cells, MOST_CELLS at most.
    All vectors must have one length; null, zero and non-finite ones have no place. The table is partitioned by cell, so a search reads the cells it looks at. A cell of more than PART_ROWS rows is cut in parts,
    which are searched as tasks of their own.
    """
    spark = items.sparkSession
    rows = items.select("id", *keep, unit(F.col("embedding")).alias("x")).where("x is not null")
    dims = [r[0] for r in rows.select(F.size("x").alias("n")).distinct().limit(2).collect()]
    if len(dims) != 1:
        raise ValueError("an index needs vectors, all of one length")
    n = rows.count()
    cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
    some = rows.select("x", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(sample).select("x").toArrow()
    centroids = fit(_matrix(some.column("x").combine_chunks(), dims[0]), cells, seed)
    sent = spark.sparkContext.broadcast(centroids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell int, codes binary, low double, step double, lost double, angle double"])
    assigned = written(rows.mapInArrow(_assign(sent, dims[0], rows.columns), schema), "assigned")
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).orderBy("cell").collect()
    parts = spark.createDataFrame([(r.cell, -(-r.rows // PART_ROWS)) for r in sizes], "cell int, parts int")
    placed = assigned.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts", "angle")
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    about = {"dim": dims[0], "cells": [r.cell for r in sizes], "radius": [r.radius for r in sizes], "rows": [r.rows for r in sizes], "centroids": [centroids[r.cell].tolist() for r in sizes]}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return VectorIndex(spark, path)


def _probed(about, dim: int, probe: int | None):
    """Queries (qid, q, floor) to a row for each task that they go to, with the cells that they look at there: the `probe` nearest cells, or all whose vectors may reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = about.value
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                b = whole.slice(at, ASKED)
                q = _matrix(b.column("q"), dim)
                near = np.clip(q @ a.centroids.T, -1, 1)
                if probe is None:
                    most = np.cos(np.maximum(0, np.arccos(near) - a.radius[None, :]))
                    look = most + SLACK + 0.5 * 10.0**-DIGITS >= b.column("floor").to_numpy(zero_copy_only=False)[:, None]
                else:
                    look = np.zeros(near.shape, bool)
                    np.put_along_axis(look, np.argsort(-near, axis=1, kind="stable")[:, :probe], True, axis=1)
                i, c = np.nonzero(look)
                if not len(i):
                    continue
                again = np.repeat(np.arange(len(i)), a.parts[c])
                task = a.task[c[again]] + np.concatenate([np.arange(p) for p in a.parts[c]])
                i, c = i[again], c[again]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 0) | (np.diff(task) != 0)]))
                cells = pa.ListArray.from_arrays(pa.array([*new, len(c)], pa.int32()), pa.array(a.cells[c].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(task[new].astype(np.int32)), cells, *(b.column(n).take(pa.array(i[new])) for n in ("qid", "q", "floor"))], names=["task", "cells", "qid", "q", "floor"])

    return run


def _screened(about, dim: int, limit: int):
    """Rows of queries and of codes, sorted by task with queries first and codes by cell, to (qid, id, cell): each query's rows of its cells that reach its floor and may be among the best `limit` of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = about.value
        place = {c: k for k, c in enumerate(a.cells.tolist())}
        at = None
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column("task").to_numpy().astype(np.int64) << 32 | b.column("cell").fill_null(-1).to_numpy() + 1
            edges = np.flatnonzero(np.diff(keys) != 0) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                task, cell = int(keys[lo] >> 32), int(keys[lo] & 0xFFFFFFFF) - 1
                if task != at:
                    at, waiting, asking = task, [], None
                if cell < 0:
                    waiting.append(part.select(["cells", "qid", "q", "floor"]))
                    continue
                if waiting:  # all queries of a task come before its first row
                    qids = pa.chunked_array([w.column("qid") for w in waiting]).combine_chunks()
                    queries = np.concatenate([_matrix(w.column("q"), dim) for w in waiting])
                    best = np.repeat(np.concatenate([w.column("floor").to_numpy(zero_copy_only=False) for w in waiting])[:, None], limit, axis=1)
                    looks = pa.chunked_array([w.column("cells") for w in waiting]).combine_chunks()
                    of, looked, waiting = np.repeat(np.arange(len(qids)), pc.list_value_length(looks).to_numpy()), looks.flatten().to_numpy(), []
                    order = np.argsort(looked, kind="stable")
                    asking = of[order], looked[order]
                if asking is None:
                    continue
                mine = asking[0][np.searchsorted(asking[1], cell) : np.searchsorted(asking[1], cell, side="right")]
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, dim).T.astype(np.float64)
                low, step, lost = (part.column(n).to_numpy() for n in ("low", "step", "lost"))
                for x in range(0, len(mine), ASKED):
                    who = mine[x : x + ASKED]
                    q = queries[who]
                    score = (q @ a.centroids[place[cell]])[:, None] + q.sum(axis=1)[:, None] * low[None, :] + (q @ codes) * step[None, :]
                    sure = np.concatenate([best[who], score - lost[None, :]], axis=1)
                    best[who] = np.partition(sure, sure.shape[1] - limit, axis=1)[:, -limit:]
                    i, j = np.nonzero(score + lost[None, :] + SLACK >= best[who].min(axis=1)[:, None] - 10.0**-DIGITS)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(who[i])), part.column("id").take(pa.array(j)), pa.array(np.full(len(i), cell, np.int32))], names=["qid", "id", "cell"])

    return run


@dataclass(frozen=True)
class _About:
    """What searches send to the tasks: MOST_CELLS centroids at most."""

    centroids: np.ndarray
    radius: np.ndarray
    cells: np.ndarray
    parts: np.ndarray
    task: np.ndarray


@dataclass
class VectorIndex:
    """An index that build() has written to a folder of any file system that Spark reads."""

    spark: SparkSession
    path: str
    dim: int = field(init=False)

    def __post_init__(self):
        about = json.loads(self.spark.read.parquet(f"{self.path}/about").first()["about"])
        self.dim = about["dim"]
        parts = -(-np.array(about["rows"]) // PART_ROWS)
        task, at, held = [], -1, 0
        for n, p in zip(about["rows"], parts.tolist(), strict=True):
            if at < 0 or p > 1 or held + n > TASK_ROWS:
                at, held = at + 1, 0
            task.append(at)
            at, held = at + p - 1, n + held if p == 1 else TASK_ROWS
        self._about = self.spark.sparkContext.broadcast(_About(np.array(about["centroids"]).reshape(-1, self.dim), np.array(about["radius"]), np.array(about["cells"]), parts, np.array(task)))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _top(self, queries: DataFrame, probe: int | None, limit: int, where: Column | str | None) -> DataFrame:
        kind = {f.name: f.dataType.simpleString() for f in (*queries.schema, *self.rows().schema)}
        asks = queries.mapInArrow(_probed(self._about, self.dim, probe), f"task int, cells array<int>, qid {kind['qid']}, q array<double>, floor double")
        asks = written(asks, "probes")
        looked = [r[0] for r in asks.select(F.explode("cells")).distinct().collect()]  # MOST_CELLS at most
        rows = self.rows().where(F.col("cell").isin(looked))
        rows = rows if where is None else rows.where(where)
        a = self._about.value
        tasks = self.spark.createDataFrame(list(zip(a.cells.tolist(), a.task.tolist(), strict=True)), "cell int, task int")
        codes = rows.join(F.broadcast(tasks), "cell").select((F.col("task") + F.col("part")).alias("task"), "cell", "id", "codes", "low", "step", "lost")
        both = asks.unionByName(codes, allowMissingColumns=True)
        dealt = both.repartitionById(int((a.task + a.parts).max()), "task").sortWithinPartitions("task", F.asc_nulls_first("cell"))
        left = dealt.mapInArrow(_screened(self._about, self.dim, limit), f"qid {kind['qid']}, id {kind['id']}, cell int")
        exact = left.join(rows.select("cell", "id", "x"), ["cell", "id"]).join(queries.select("qid", "q"), "qid")
        score = F.round(F.aggregate(F.zip_with("x", "q", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v), DIGITS)
        return top_k(exact.select("qid", "id", score.alias("score")), limit, "qid", [F.desc("score"), F.asc("id")])

    def search(self, queries: DataFrame, limit: int = 12, probe: int = 8, where: Column | str | None = None, exact: bool = False) -> DataFrame:
        """Top lists (qid, id, score, rank) by cosine for queries (qid, embedding), over the rows that `where` lets through.

        A query looks at its `probe` nearest cells. There codes give each score with a sure error, and only rows that may be among the best `limit` of their part are scored by their vectors. With exact,
        a second look goes to every other cell whose centroid and radius leave room for a score as good as the last of the first list: the result is then that of comparing with all rows.
        Repeated qids are errors; null and zero query vectors have no list. Queries are rows throughout, never on the driver.
        """
        if limit < 1 or probe < 1:
            raise ValueError("limit and probe must be positive")
        q = written(queries.select("qid", unit(F.col("embedding")).alias("q")).where("q is not null and qid is not null").withColumn("floor", F.lit(-1.0)), "queries")
        if not q.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError("a qid is repeated")
        if not q.where(F.size("q") != self.dim).isEmpty():
            raise ValueError(f"a query vector needs {self.dim} dimensions")
        first = self._top(q, probe, limit, where)
        if not exact:
            return first
        first = written(first, "first")
        full = first.where(F.col("rank") == limit).select("qid", F.col("score").alias("_last"))
        again = q.join(full, "qid", "left").withColumn("floor", F.coalesce("_last", F.lit(-1.0))).drop("_last")
        return self._top(again, None, limit, where)

    def probes_for(self, recall: float = 0.95, limit: int = 12, queries: int = 64, seed: int = 2) -> int:
        """How many cells a search must look at to find that share of the best `limit`, by the exact lists of `queries` rows of the index, those with the smallest hashes."""
        some = self.rows().select(F.col("id").alias("qid"), F.col("x").alias("embedding"), F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(queries).drop("h")
        some = written(some.dropDuplicates(["qid"]), "probing")
        best = self.search(some, limit, exact=True).join(self.rows().select("id", "cell"), "id").join(some, "qid").select("embedding", "cell").toArrow()
        a = self._about.value
        order = np.argsort(-(_matrix(best.column("embedding").combine_chunks(), self.dim) @ a.centroids.T), axis=1, kind="stable")
        place = np.sort((a.cells[order] == best.column("cell").to_numpy()[:, None]).argmax(axis=1))
        return int(place[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1 if len(place) else 1
