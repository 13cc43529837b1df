"""Toxicity: class-conditional Kneser-Ney models of bytes, which share the recursive backoff counts of rare expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, crc_mod, materialise, pieces, seeded_bits, table

#: Bytes of an n-gram; the discount of every order.
ORDER, DISCOUNT = 5, 0.75
#: Labelled documents, on average, on which the weights of the score are fitted.
CALIBRATION = 20_000
CUT, SEED = 0.3, 10
#: Distinct n-grams of a model that is sent to the tasks, which at 56 bytes each take 112 MB; a larger one is joined.
HELD_GRAMS = 2_000_000
#: Bytes of a unit of the joins: a word, or a part of a longer one, after the bytes before it.
PIECE = 64
#: Distinct n-grams that a task counts before it hands them on, and rows of counts that wait for the next sum.
COUNTED, WAITING = 1_500_000, 1 << 17
#: Bytes of texts whose n-grams, of 8 bytes each and several times over while they are sorted, a task holds at once.
TEXT_BYTES = 1 << 19
_U = np.uint64
_START = b"\x01" * (ORDER - 1)
#: Columns of a model: counts of n-grams by class, of their contexts and the kinds of bytes that follow; for each shorter order, the kinds of bytes
#: before an n-gram, and for its context their sum and the kinds of bytes that follow.
COUNTS = ("c0", "c1", "h0", "h1", "t0", "t1", *(f"{k}_{j}" for j in range(ORDER - 1, 0, -1) for k in "nht"))


def spelled(text: str | None) -> bytes:
    """The words between ASCII white space, A-Z in lower case, each with a blank after it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words) + b" " if words else b""


def grams_of(flat: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, packed in an integer, its last byte lowest."""
    one = np.frombuffer(flat, dtype=np.uint8).astype(_U)
    packed = one.copy()
    for k in range(1, ORDER):
        packed[k:] |= one[:-k] << _U(8 * k)
    return packed


def _suffix(gram, j: int):
    return gram & _U((1 << 8 * j) - 1)


def log_ratio(v: dict[str, np.ndarray]) -> np.ndarray:
    """log P(byte | context, toxic) - log P(byte | context, ordinary) from the columns COUNTS; counts that a model doesn't have are 0.

    The shared probability recurses from the uniform one through the orders 1, 2, ... by numbers of kinds; the highest order has each class's own counts.
    """
    shared: np.ndarray | float = 1 / 256
    for j in range(1, ORDER):
        held = np.maximum(v[f"h_{j}"], 1)
        shared = np.where(v[f"h_{j}"] > 0, (np.maximum(v[f"n_{j}"] - DISCOUNT, 0) + DISCOUNT * v[f"t_{j}"] * shared) / held, shared)
    p = [np.where(v["h" + c] > 0, (np.maximum(v["c" + c] - DISCOUNT, 0) + DISCOUNT * v["t" + c] * shared) / np.maximum(v["h" + c], 1), shared) for c in "01"]
    return np.log(p[1] / p[0])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


@dataclass
class Held:
    """A model that is small enough to be sent to the tasks: for each table, sorted keys and their columns."""

    tables: list[tuple[str, np.ndarray, dict[str, np.ndarray]]]
    weights: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray, types: np.ndarray, weights: np.ndarray) -> Held:
        """The tables of the n-grams with their counts; the shorter orders count the n-grams `types`."""
        f = lambda *values: [np.asarray(v, dtype="f4") for v in values]
        keys, *sums = _sums(gram >> _U(8), c0, c1, c0 > 0, c1 > 0) if len(gram) else (gram, c0, c1, c0, c1)
        gram, c0, c1 = _sums(gram, c0, c1)
        tables = [("gram", gram, dict(zip(("c0", "c1"), f(c0, c1), strict=True))), ("context", keys, dict(zip(("h0", "h1", "t0", "t1"), f(*sums), strict=True)))]
        for j in range(ORDER - 1, 0, -1):
            types, n = np.unique(_suffix(types, j), return_counts=True)
            keys, total, kinds = _sums(types >> _U(8), n, np.ones(len(n)))
            tables += [(f"gram_{j}", types, {f"n_{j}": f(n)[0]}), (f"context_{j}", keys, {f"h_{j}": f(total)[0], f"t_{j}": f(kinds)[0]})]
        return Held(tables, weights)

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        """log_ratio of each n-gram."""
        found: dict[str, np.ndarray] = {}
        for name, keys, values in self.tables:
            kind, _, j = name.partition("_")
            key = _suffix(gram, int(j)) if j else gram
            key = key >> _U(8) if kind == "context" else key
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            same = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            found |= {c: np.where(same, v[at], 0).astype(float) if len(v) else np.zeros(len(key)) for c, v in values.items()}
        return log_ratio(found)

    def sums(self, flat: bytes) -> np.ndarray:
        """Before each byte, and at the end, the sum of the log ratios of the bytes so far; n-grams are made of TEXT_BYTES at a time, however long a text is."""
        total, lead = np.zeros(len(flat) + 1), ORDER - 1
        for at in range(0, len(flat), TEXT_BYTES):
            before = min(at, lead)
            gram, inverse = np.unique(grams_of(flat[at - before : at + TEXT_BYTES])[before:], return_inverse=True)
            total[at + 1 : at + 1 + len(inverse)] = self.ratios(gram)[inverse]
        return np.cumsum(total, out=total)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the log ratio per byte, the highest of a word, and the logarithm of the number of words; zeros without words."""
        data = [spelled(t) for t in texts]
        flat = b"".join(_START + d for d in data)
        total = self.sums(flat)
        size = np.array([len(d) for d in data])
        end = np.cumsum(size + len(_START))
        blanks = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
        cut = np.searchsorted(blanks, np.concatenate(([0], end)))
        out = np.zeros((len(texts), 3))
        for i, (n, stop) in enumerate(zip(size.tolist(), end.tolist(), strict=True)):
            if n:
                ends = blanks[cut[i] : cut[i + 1]] + 1
                words = np.diff(total[np.concatenate(([stop - n], ends))])
                out[i] = (total[stop] - total[stop - n]) / n, words.max(), np.log(len(words))
        return out


@dataclass
class KneserNey:
    """A model: each n-gram's counts (gram, c0, c1), the kinds of n-grams (gram), the weights of bias, ratio per byte, strongest word and log of the words; and its small form."""

    grams: DataFrame
    types: DataFrame
    weights: np.ndarray
    held: Held | None = None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, toxic, text) rows to the counts of n-grams by part and class."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def batch() -> pa.RecordBatch:
        keys, *counts = held[0]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["gram", "a0", "a1", "b0", "b1"])

    for b in pieces(batches, "text", TEXT_BYTES):
        column = 2 * b.column("part").to_numpy() + b.column("toxic").to_numpy()
        texts = b.column("text").to_pylist()
        for k in range(4):
            data = [_START + spelled(texts[i]) for i in np.flatnonzero(column == k)]
            size = np.array([len(d) for d in data], dtype=np.int64)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            gram, n = np.unique(grams_of(b"".join(data))[place >= len(_START)], return_counts=True)
            held.append((gram, *(n if m == k else np.zeros(len(n), dtype=np.int64) for m in range(4))))
            waiting += len(gram)
        if waiting >= WAITING:
            held, waiting = [_sums(*map(np.concatenate, zip(*held, strict=True)))], 0
            if len(held[0][0]) > COUNTED:
                yield batch()
                held = []
    held = [_sums(*map(np.concatenate, zip(*held, strict=True)))] if held else []
    if held and len(held[0][0]):
        yield batch()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) rows to (text_key, word number, unit): bytes of a word, PIECE at most, after the ORDER - 1 bytes before them."""
    lead = ORDER - 1
    for b in pieces(batches, "text"):
        for key, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = _START + spelled(text)
            number, unit, at, word = [], [], lead, 0
            while at < len(data):
                end = data.index(b" ", at) + 1
                for a in range(at, end, PIECE):
                    number.append(word)
                    unit.append(data[a - lead : min(a + PIECE, end)])
                at, word = end, word + 1
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(unit), pa.string()), pa.array(number, pa.int64()), pa.array(unit, pa.binary())], names=["text_key", "word", "unit"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units to the n-grams at their bytes."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            column = b.column("unit").slice(at, 2000)
            units = column.to_pylist()
            length = np.array([len(u) for u in units])
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            inside = place >= ORDER - 1
            row = np.repeat(np.arange(len(units)), length)[inside]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(row)), pa.array(grams_of(b"".join(units))[inside].view(np.int64))], names=["unit", "gram"])


def _log_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("gram"), pa.array(log_ratio({c: b.column(c).to_numpy().astype(float) for c in COUNTS}))], names=["gram", "ratio"])


def _joined_ratios(grams: DataFrame, net: KneserNey) -> DataFrame:
    """log_ratio of the n-grams `grams` (gram), from joins with the counts of each order; no task holds a table."""
    context = lambda c: F.shiftrightunsigned(c, 8)
    mine, theirs = F.col("gram"), net.grams
    counts = [F.sum("c" + c).alias("h" + c) for c in "01"] + [F.count_if(F.col("c" + c) > 0).alias("t" + c) for c in "01"]
    out = grams.join(theirs, "gram", "left").withColumn("key", context(mine)).join(theirs.groupBy(context("gram").alias("key")).agg(*counts), "key", "left")
    types = net.types
    for j in range(ORDER - 1, 0, -1):
        types = materialise(types.groupBy(F.col("gram").bitwiseAND((1 << 8 * j) - 1).alias("gram")).agg(F.count("*").alias(f"n_{j}")), f"order-{j}")
        above = types.groupBy(context("gram").alias("key")).agg(F.sum(f"n_{j}").alias(f"h_{j}"), F.count("*").alias(f"t_{j}"))
        low = mine.bitwiseAND((1 << 8 * j) - 1)
        out = out.withColumn("key", low).join(types.withColumnRenamed("gram", "key"), "key", "left").withColumn("key", context(low)).join(above, "key", "left")
    return out.select("gram", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in COUNTS]).mapInArrow(_log_ratios, "gram long, ratio double")


def _joined_features(docs: DataFrame, net: KneserNey) -> DataFrame:
    """docs (text, ...) with mean, most and length as Held.features() has them, for a model of any size: n-grams of distinct units meet their counts, units their ratios."""
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    units = keyed.select("text_key", "text").dropDuplicates(["text_key"]).mapInArrow(_units, "text_key string, word long, unit binary")
    units = materialise(units.groupBy("text_key", "word", "unit").agg(F.count("*").alias("n")), "units")
    grams = materialise(units.select("unit").distinct().mapInArrow(_spell, "unit binary, gram long"), "spelled")
    ratios = materialise(_joined_ratios(grams.select("gram").distinct(), net), "ratios")
    known = materialise(grams.join(ratios, "gram").groupBy("unit").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("bytes")), "unit-ratios")
    words = units.join(known, "unit").groupBy("text_key", "word").agg(F.sum(F.col("n") * F.col("ratio")).alias("ratio"), F.sum(F.col("n") * F.col("bytes")).alias("bytes"))
    found = words.groupBy("text_key").agg((F.sum("ratio") / F.sum("bytes")).alias("mean"), F.max("ratio").alias("most"), F.log(F.count("*").cast("double")).alias("length"))
    return keyed.join(found, "text_key", "left").fillna(0.0, ["mean", "most", "length"])


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", TEXT_BYTES):
            x = shared.value.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "mean", "most", "length"])

    return run


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", TEXT_BYTES):
            z = np.column_stack([np.ones(b.num_rows), shared.value.features(b.column("text").to_pylist())]) @ shared.value.weights
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*names, "score"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a small ridge penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + len(y) * penalty * np.diag([1e-6] + [1.0] * (len(w) - 1)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - len(y) * penalty * np.append(0, w[1:]))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(grams: DataFrame, n: int, parts: str, weights: np.ndarray) -> KneserNey:
    """The model of some halves of the rows, from n-grams with their counts in each; a small form too, if there are HELD_GRAMS at most."""
    sums = [sum((F.col(p + c) for p in parts[1:]), F.col(parts[0] + c)).alias("c" + c) for c in "01"]
    own = grams.select("gram", *sums)
    net = KneserNey(own.where("c0 + c1 > 0"), grams.select("gram"), weights)
    if n <= HELD_GRAMS:
        got = own.toArrow()
        gram, c0, c1 = got.column("gram").to_numpy().view(_U), got.column("c0").to_numpy(), got.column("c1").to_numpy()
        seen = c0 + c1 > 0
        net.held = Held.of(gram[seen], c0[seen], c1[seen], gram, weights)
    return net


def fit(labelled: DataFrame) -> KneserNey | None:
    """Models of rows (doc_id, text, toxic 0 or 1); null unless both classes have a row.

    Counts cover all rows, and every n-gram keeps its own, so the model grows with the input: tasks count n-grams, which cross word borders, and Spark sums
    them. To weigh the features of the score, models of half of the rows (by a seeded hash of doc_id) measure a part of the other half, chosen by another
    seeded hash so that it has CALIBRATION rows on average at most; then all rows make the model.
    """
    part = F.when(seeded_bits(SEED, F.col("doc_id")) % 2 == 0, 0).otherwise(1)
    rows = labelled.select(part.alias("part"), F.col("toxic").cast("int").alias("toxic"), "text", (seeded_bits(SEED + 1, F.col("doc_id")) / F.lit(float(1 << 52))).alias("draw"))
    kinds = {(r[0], r[1]): r[2] for r in rows.groupBy("part", "toxic").count().collect()}
    if {t for _, t in kinds} != {0, 1}:
        return None
    counts = ("a0", "a1", "b0", "b1")
    grams = rows.select("part", "toxic", "text").mapInArrow(_count, "gram long, " + ", ".join(f"{c} long" for c in counts)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in counts])
    grams = materialise(grams, "grams")
    n = grams.count()
    weights = np.array([-4.0, 1.0, 1.0, -0.5])
    if len(kinds) == 4:
        half = _model(grams, n, "a", weights)
        chosen = rows.where((F.col("part") == 1) & (F.col("draw") < CALIBRATION / (kinds[1, 0] + kinds[1, 1]))).select("toxic", "text")
        if half.held:
            shared = rows.sparkSession.sparkContext.broadcast(half.held)
            got = chosen.mapInArrow(_measure(shared), "toxic int, mean double, most double, length double").toArrow()
            shared.unpersist()
        else:
            got = _joined_features(materialise(chosen, "chosen"), half).select("toxic", "mean", "most", "length").toArrow()
        y, *x = (got.column(c).to_numpy() for c in ("toxic", "mean", "most", "length"))
        if len(set(y.tolist())) == 2:
            weights = logistic(np.column_stack([np.ones(len(y)), *x]), y.astype(float))
    return _model(grams, n, "ab", weights)


def score(docs: DataFrame, net: KneserNey | None, cut: float = CUT) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `cut`).

    A text's log-likelihood under the toxic model, less that under the ordinary one, divided by its bytes, is weighed with the same ratio of its strongest word, so
    that one expression counts in a long text too, and with the text's length, which makes strong words likelier. Texts are scored whole, however long. A text
    without words, and a null, has no evidence and gets the score of that. Without a model all have 0. Repeated rows score alike; columns score and predicted are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    if net is None:
        return docs.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    if net.held is None:
        bias, *w = (float(v) for v in net.weights)
        own = docs.select(F.struct(*names).alias("row"), "text")
        z = sum((k * F.col(c) for k, c in zip(w, ("mean", "most", "length"), strict=True)), F.lit(bias))
        out = _joined_features(own, net).select("row.*", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(net.held)
    return docs.select(*names).mapInArrow(_score(shared, names), schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a toxic label of 0 or 1 whose crc32(doc_id) mod 4 isn't 2."""
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    return docs.select("doc_id", "text").where(crc_mod(F.col("doc_id"), 4) != 2).join(broadcast_if_small(known, labels.count(), 24), "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(labelled(docs, table(spark, sf_dir, "labels")))
    held: Column = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}
