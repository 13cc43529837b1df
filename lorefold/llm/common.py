"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table as read_table

#: The largest table that an operator may broadcast, in bytes, judged by its row count and a bound on its row width.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of texts that a Python task works on at once; one longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 2000, 4 << 20
#: A key is hot if it has more rows than HOT_ROWS and than one part in HOT_PARTS of all, so there are fewer than HOT_PARTS hot keys at any size.
HOT_ROWS, HOT_PARTS = 1000, 100_000
#: Spark's setting that the shuffles of a finished query go at once, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the largest sieve, as a power of two.
SIEVE_BITS = 26
#: ASCII white space as the contracts write it, for java.util.regex.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, opened by Spark only; see the library's own reader for tables of few files."""
    return read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; where it is unset, a temporary one for a local session and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lorefold-shared"
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, a lost executor takes nothing along, and Spark removes the shuffles of the write once it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorefold-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PIECE_ROWS rows and about `most` bytes of the column `text`."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(size.tolist()):
            if i > at and (i - at >= PIECE_ROWS or total + n > most):
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)


def hot_split(counted: DataFrame, rows: int, n: str = "n", parts: int = HOT_PARTS) -> tuple[DataFrame, DataFrame]:
    """Keys with their row counts `n`, as (hot, others). Fewer than `parts` keys are hot whatever the input, so a broadcast of them has a proven bound;
    none of the others has more rows than a small part of all."""
    most = max(HOT_ROWS, rows // parts)
    return counted.where(F.col(n) > most), counted.where(F.col(n) <= most)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay under BROADCAST_BYTES; otherwise Spark joins by shuffling."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def seeded_bits(seed: int, *cols: Column, digits: int = 13) -> Column:
    """4 * digits uniform bits (52 by default, so a double holds them) from the md5 of the seed and the columns; nulls count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


@dataclass
class Sieve:
    """A bitmap that says of a 64-bit key whether it may be in a set. It takes 8 MB at most, whatever the set's size: a fuller one lets more pass, and whoever asks must be right with those too."""

    words: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Sieve:
        """The sieve of a column of longs. Spark sets the bits; the driver gets words of 64 of them, of which there are at most 2^20."""
        bits = min(SIEVE_BITS, max(12, (16 * keys.count()).bit_length()))
        slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        word, bit = F.shiftright(slot, 6).alias("word"), F.expr(f"bit_or(shiftleft(1L, cast(`{column}` & 63 as int)))").alias("bit")
        got = keys.groupBy(word).agg(bit).toArrow()
        words = np.zeros(1 << bits - 6, np.uint64)
        words[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
        return cls(words)

    def __contains__(self, key: int) -> bool:
        return bool(self.may_hold(np.array([key], np.int64))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) & np.uint64(64 * len(self.words) - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
