"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors decide which pairs are computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import set_key
from .common import broadcast_if_small, materialise, table
from .components import connected_components, spanning_stars
from .ngram_join import grouped

THRESHOLD, SEED = 0.93, 4
#: Rotations, each with a code of its own; bits of the companion codes, which stand for the other vector of a pair.
ROTATIONS, LEVELS = 2, 4
#: Classes of one block of a label, rows of a block that are compared at a time, and room for rounding in the bounds.
BLOCK, STRIP, SLACK = 2048, 128, 1e-9
_LONG = np.dtype("<u8")


def rotation(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim, number)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    out = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(_LONG)


@dataclass
class Codes:
    """What is stored of unit vectors under one rotation: the signs of the rotated coordinates, with the inner product of sign code and vector as the correction factor; and the
    coordinates rounded to 2^LEVELS steps, as bit planes, with the lowest step, the width of one, their sum, and the length of what the rounding lost."""

    sign: np.ndarray  # n x words
    planes: np.ndarray  # n x LEVELS x words
    numbers: np.ndarray  # n x 5: factor, lowest, width, sum, lost
    dim: int

    @staticmethod
    def of(x: np.ndarray, number: int) -> Codes:
        dim = x.shape[1]
        u = x @ rotation(dim, number)
        low, high = u.min(axis=1), u.max(axis=1)
        width = np.maximum(high - low, 1e-12) / ((1 << LEVELS) - 1)
        step = np.rint((u - low[:, None]) / width[:, None]).astype(np.uint8)
        near = low[:, None] + width[:, None] * step
        factor = np.abs(u).sum(axis=1) / math.sqrt(dim)
        planes = np.stack([_pack((step >> k) & 1 == 1) for k in range(LEVELS)], axis=1)
        return Codes(_pack(u > 0), planes, np.column_stack([factor, low, width, near.sum(axis=1), np.linalg.norm(u - near, axis=1)]), dim)

    def __getitem__(self, at) -> Codes:
        return Codes(self.sign[at], self.planes[at], self.numbers[at], self.dim)

    def packed(self) -> list[bytes]:
        """One row of bytes for each vector."""
        n = len(self.sign)
        rows = np.concatenate([self.sign.view(np.uint8).reshape(n, -1), self.planes.reshape(n, -1).view(np.uint8).reshape(n, -1), self.numbers.astype("<f8").view(np.uint8).reshape(n, -1)], axis=1)
        return [r.tobytes() for r in rows]

    @staticmethod
    def unpacked(rows: list[bytes], dim: int) -> Codes:
        words = -(-dim // 64)
        raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
        a, b = 8 * words, 8 * words * (1 + LEVELS)
        part = lambda lo, hi, kind: np.ascontiguousarray(raw[:, lo:hi]).view(kind)
        return Codes(part(0, a, _LONG), part(a, b, _LONG).reshape(len(rows), LEVELS, words), part(b, raw.shape[1], "<f8"), dim)


def code_products(x: Codes, y: Codes) -> np.ndarray:
    """Inner products of the sign codes of x with the rounded vectors of y, by counting the bits that both have."""
    both = np.zeros((len(x.sign), len(y.sign)))
    for k in range(LEVELS):
        for w in range(x.sign.shape[1]):
            both += np.bitwise_count(x.sign[:, None, w] & y.planes[None, :, k, w]) * float(1 << k)
    _, low, width, total, _ = y.numbers.T
    ones = np.bitwise_count(x.sign).sum(axis=1, dtype=float)
    return (2 * (low * ones[:, None] + width * both) - total) / math.sqrt(x.dim)


def estimates(x: Codes, y: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of unit vectors, from the codes of x and the rounded vectors of y, and their standard errors by row of x.

    The product of code and y is divided by the correction factor. Over random rotations the error is sqrt((1 - factor^2) / factor^2 / (dim - 1)) at most, apart from the rounding.
    """
    factor = x.numbers[:, 0]
    error = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, x.dim - 1))
    return code_products(x, y) / factor[:, None], error


def least_products(factor: np.ndarray, threshold: float) -> np.ndarray:
    """The confidence bound, of confidence 1: by the angle's triangle inequality, the least inner product with a row's code that a unit vector can have whose product with the row is threshold or more."""
    across = np.sqrt(np.maximum(0, 1 - factor**2)) * math.sqrt(max(0.0, 1 - threshold**2))
    return np.where(factor + threshold < 0, -2.0, factor * threshold - across) - SLACK


def open_pairs(x: list[Codes], y: list[Codes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the codes of no rotation rule out, whichever of the two vectors gives the sign code; those left out are below the threshold for sure."""
    left, right = [], []
    for at in range(0, len(x[0].sign), STRIP):
        part = x[0][at : at + STRIP]
        i, j = np.nonzero(code_products(part, y[0]) + y[0].numbers[:, 4] >= least_products(part.numbers[:, 0], threshold)[:, None])
        i += at
        for a, b, turned in [(x[0], y[0], True), *((u, v, t) for u, v in zip(x[1:], y[1:], strict=True) for t in (False, True))]:
            code, other, m, n = (b, a, j, i) if turned else (a, b, i, j)
            both = sum(np.bitwise_count(code.sign[m, w] & other.planes[n, k, w]) * float(1 << k) for k in range(LEVELS) for w in range(code.sign.shape[1]))
            _, low, width, total, lost = other.numbers[n].T
            product = (2 * (low * np.bitwise_count(code.sign[m]).sum(axis=1, dtype=float) + width * both) - total) / math.sqrt(code.dim)
            keep = product + lost >= least_products(code.numbers[m, 0], threshold)
            i, j = i[keep], j[keep]
        left.append(i)
        right.append(j)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or any(c is None for c in v) else np.asarray(v, dtype=np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with dim, the key of the vector and its codes; nulls where the vector or the label can't link."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            rows = _vectors(b.column("embedding"))
            good = [i for i, (label, x) in enumerate(zip(b.column("label").to_pylist(), rows, strict=True)) if label is not None and x is not None]
            dims: list[int | None] = [None] * b.num_rows
            keys: list[tuple[int | None, int | None]] = [(None, None)] * b.num_rows
            codes: list[list[bytes] | None] = [None] * b.num_rows
            for dim in sorted({len(rows[i]) for i in good}):
                mine = [i for i in good if len(rows[i]) == dim]
                x = np.stack([rows[i] for i in mine])
                scale = np.abs(x).max(axis=1, keepdims=True)
                unit = x / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                packed = [Codes.of(unit, r).packed() for r in range(ROTATIONS)]
                for k, i in enumerate(mine):
                    dims[i], keys[i], codes[i] = dim, set_key(x[k] + 0.0), [p[k] for p in packed]  # + 0.0 makes -0.0 and 0.0 alike
            k1, k2 = zip(*keys, strict=True)
            columns = [pa.array(dims, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(codes, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "label", "embedding")), *columns], names=["node", "label", "embedding", "dim", "k1", "k2", "codes"])


def _sides(t: pa.Table, one: int, two: int) -> tuple[np.ndarray, np.ndarray, list[Codes]]:
    """Rows of block one, rows of block two, and the codes of all by rotation."""
    mine = t.column("mine").to_numpy()
    rows, dim = t.column("codes").to_pylist(), t.column("dim")[0].as_py()
    return np.flatnonzero(mine == one), np.flatnonzero(mine == two), [Codes.unpacked([r[k] for r in rows], dim) for k in range(ROTATIONS)]


def _pairs(t: pa.Table, one: int, two: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Open pairs of a pair of blocks as rows of the table, each once."""
    left, right, codes = _sides(t, one, two)
    if not len(left) or not len(right):
        return left[:0], left[:0]
    i, j = open_pairs([c[left] for c in codes], [c[right] for c in codes], threshold)
    i, j = left[i], right[j]
    ok = (i < j) if one == two else np.ones(len(i), dtype=bool)
    return i[ok], j[ok]


_BLOCKS = ["label", "dim", "one", "two"]


def _screen(threshold: float):
    """Codes of pairs of blocks to the rows that have an open pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in grouped(batches, _BLOCKS):
            i, j = _pairs(t, key[2], key[3], threshold)
            at = pa.array(np.unique(np.concatenate([i, j])))
            yield from t.select([*_BLOCKS, "mine", "node", "n", "codes"]).take(at).combine_chunks().to_batches()

    return run


def _compare(threshold: float):
    """Rows with open pairs and their vectors to links: sums and a spanning forest, never the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in grouped(batches, _BLOCKS):
            i, j = _pairs(t, key[2], key[3], threshold)
            ids, n = (np.array(t.column(c).to_pylist(), dtype=np.int64) for c in ("node", "n"))
            x = np.stack(_vectors(t.column("embedding")))
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keep = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, dtype=bool)])
            i, j = i[keep], j[keep]
            links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
            at = np.flatnonzero(links)
            stars = spanning_stars(zip(ids[i].tolist(), ids[j].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at], pa.int64()), pa.array(links[at].astype(np.int64), pa.int64()), pa.array([stars.get(v, v) for v in ids[at].tolist()], pa.int64())], names=["node", "links", "root"]
            )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Vectors (vec_id, embedding, label) of equal labels and lengths link if their cosine, in double precision, is threshold or more.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links reach) and kept, a row for each row of vectors.
    A vec_id may have any type that has an order (others than integers go by their 64-bit hashes inside), a label any type. A null label, and a vector that is null, empty, zero or
    holds null or non-finite components, links with nothing. Equal vectors of a label are one class, whose copies count in n_links without being compared. Rows that repeat a
    vec_id share links and component; a null vec_id has a null component_id, isn't kept and links with nothing. Extra columns play no part; an empty table gives an empty result.

    One pass stores the codes and factors of each vector. The classes of a label and length are cut into blocks of about BLOCK; each pair of blocks is a task that reads
    codes only and finds, by counting bits, the rows with pairs that the bounds leave open. Those rows alone, few beside the near copies, meet their full vectors, and a second task computes
    the open pairs exactly. The bounds hold for sure, so no link is lost at any size; the work grows with the square of a label's classes, a few bit operations a pair.
    """
    integral = vectors.schema["vec_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    node = F.col("vec_id").cast("long") if integral else F.when(F.col("vec_id").isNotNull(), F.xxhash64("vec_id"))
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select("vec_id", node.alias("node"), label.alias("label"), "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    keyed = materialise(rows.select("node", "label", "embedding").mapInArrow(_keyed, f"node long, label long, embedding {kind}, dim int, k1 long, k2 long, codes array<binary>"), "vectors")
    key = ["label", "dim", "k1", "k2"]
    valid = keyed.where("k1 is not null and node is not null")
    classes = materialise(valid.groupBy(*key).agg(F.min("node").alias("rep"), F.count("*").alias("n")), "classes")
    heads = valid.join(classes, key).where("node = rep").dropDuplicates(key)
    group = ["label", "dim"]
    blocks = classes.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1").select(*group, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    heads = materialise(heads.select("node", *group, "n", "embedding", "codes"), "heads")
    placed = heads.select("node", *group, "n", "codes").join(broadcast_if_small(blocks, classes.count(), 24), group)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*group, F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "node", "n", "codes")
    schema = "label long, dim int, one int, two int, mine int, node long, n long, codes array<binary>"
    left = materialise(placed.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS).mapInArrow(_screen(threshold), schema), "open")
    pairs = left.join(heads.select("node", *group, "embedding"), ["node", *group])
    found = materialise(pairs.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS).mapInArrow(_compare(threshold), "node long, links long, root long"), "links")
    part = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    links = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    out = keyed.select("node", *key).join(classes, key, "left").join(links, "rep", "left").join(part, F.col("rep") == F.col("_node"), "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component", "rep", "node"))
    n_links = F.when(F.col("node").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).otherwise(0)
    out = out.select("node", n_links.cast("long").alias("n_links"), component.alias("component"))
    if integral:
        back = vectors.schema["vec_id"].dataType
        out = out.select(F.col("node").cast(back).alias("vec_id"), "n_links", F.col("component").cast(back).alias("component_id"))
    else:
        names = rows.select("node", "vec_id").distinct()
        least = out.select("node", "component").distinct().join(names, "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
        out = out.join(names, "node", "left").join(least, "component", "left").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op4_embedding_dedup": r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reached as (select distinct x as root, x as node from links union select root, y from reached join links on node = x)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(low, e.vec_id) as component_id, e.vec_id = coalesce(low, e.vec_id) as kept from embeddings e
left join (select x, count(*) as n from links group by x) l on l.x = e.vec_id left join (select node, min(root) as low from reached group by node) r on r.node = e.vec_id
"""
}
