"""Sharding: proportional stratified interleaving of the sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import seeded_bits, table

SHARDS, SEED = 8, 3
#: Rows that a bucket holds on average, as long as 1 << BITS buckets are enough for that (a billion rows); with more rows, a bucket holds more.
ROWS, BITS = 1000, 20


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Put each row in a shard so that all shards hold the mixture of sources and their row counts are at most one apart; adds shard and slot.

    Rows of a source are shuffled by a seeded hash of doc_id and text and ranked; the rank plus a half, over the source's rows, is the
    fractional rank. All rows in the order of fractional rank (then source) are cut in equal runs: slot is the place in a run, gapless from 0.
    Rows alike in doc_id, source and text are interchangeable, and stand in one bucket. Null sources are one source, null ids and texts count as empty strings.
    Texts are hashed whole, however long, and only moved. A column of docs named shard or slot is replaced. An empty table stays empty.

    No task sorts a whole source: rows are dealt by (source, leading hash bits), ranked there, and lifted by the counts of the buckets before,
    which come from one narrow pass. The global order is dealt by ranges of fractional rank, whose counts follow from the sources' counts alone: a source
    adds a row for each range that it reaches, so never more rows than it has.
    """
    n = docs.count()
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, n) / ROWS))))
    deals = 1 << bits
    tie = F.xxhash64(*([c for c in ("text", "text_crc32") if c in docs.columns] or [F.lit(0)]))
    source, bucket, key = F.struct(F.col("source")), F.shiftright("_hash", 52 - bits).cast("int"), seeded_bits(seed, F.col("doc_id"), tie)
    narrow = docs.select(source.alias("_source"), key.alias("_hash")).groupBy("_source", bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_rows", F.sum("_n").over(Window.partitionBy("_source"))).drop("_n")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_tie", "doc_id")
    rows = docs.drop("shard", "slot").withColumns({"_source": source, "_hash": key}).withColumns({"_bucket": bucket, "_tie": tie})
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["_source", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    # a row of rank r among m rows falls in range g if floor((2r + 1) * deals / 2m) = g
    sources = narrow.groupBy("_source").agg(F.sum("_n").alias("_m"))
    few = sources.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_m"), F.lit(deals).cast("long")) - 1)))
    below = lambda deal: F.expr(f"least(_m, (2L * _m * ({deal}) + {deals - 1}) div {2 * deals})")
    each = few.select(F.when(F.col("_m") < deals, F.expr(f"cast((2L * _step + 1) * {deals} div (2 * _m) as int)")).otherwise(F.col("_step").cast("int")).alias("_deal"), F.when(F.col("_m") < deals, F.lit(1).cast("long")).otherwise(below("_step + 1") - below("_step")).alias("_k"))
    sized = each.groupBy("_deal").agg(F.sum("_k").alias("_k"))
    starts = sized.select("_deal", (F.sum("_k").over(Window.orderBy("_deal").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_k")).alias("_start"))
    ranked = ranked.withColumn("_deal", F.expr(f"cast((2L * _rank + 1) * {deals} div (2 * _rows) as int)")).withColumn("_part", (2 * F.col("_rank") + 1) / (2 * F.col("_rows")))
    place = F.row_number().over(Window.partitionBy("_deal").orderBy("_part", "_source")) - 1
    placed = ranked.withColumn("_place", place).join(starts, "_deal").withColumn("_place", F.col("_place") + F.col("_start"))
    shard = F.expr(f"cast(_place * {shards} div {max(1, n)} as int)")
    slot = F.col("_place") - F.expr(f"(shard * {max(1, n)}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot.cast("long")).select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


SQL: dict[str, str] = {}
