"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise, seeded_bits, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 6
#: Documents of one source and size that one task numbers.
ROWS = 20_000


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Targets of the sources (source, source_size), which share the total size by weight under a ceiling of most times their own size.

    Sources in code-point order, null last, take the weights in turn. Handing the excess over a ceiling to the others by weight, again and
    again, ends at one level t with target = min(t * weight, ceiling). With the sources sorted by ceiling / weight, let the first k stand at their ceilings
    and the others share the rest by weight: the level rises with k as long as the next source is above its ceiling, then falls, so t is the largest.
    One row per source is sorted in one task; documents never are.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (turn + 1).cast("int")).cast("long")).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max("level").over(whole))
    return ranked.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _meet(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of `small`, whose row of equal keys there is one; null equals null."""
    named = small.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in small.columns])
    return rows.join(broadcast_if_small(named, small.count(), 96), [rows[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]).drop(*[f"_key_{k}" for k in keys])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Add size (words), source_size, target, rate and copies to docs; copies is floor(rate), plus one with the probability of the fraction.

    The draw of the extra copy is seeded by the source and doc_ids, so reruns agree. Within a source the draws are spread evenly over the documents in the order
    of size (from the largest), then of their seeded hash: document number r, from 0, has the extra copy if a multiple of 1 lies between u + r * fraction and
    u + (r + 1) * fraction, where u is the source's seeded start. Each document's probability is the fraction, and what a source takes differs
    from its target by less than its largest document. Rows that repeat a doc_id draw each for itself. A null text has no words; a source without words has rate 0;
    documents without words stay, with copies by their source's rate. A null source is one source. Long texts are counted whole. Clashing columns are replaced.

    Between the passes over the texts only counts move: a row for each source and size. The numbers r come from counts of strata, a stratum being
    documents of one source and size, cut by hash where there are more than ROWS of them; so no task sorts a source.
    """
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    strata = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("_n")), "strata").withColumn("_buckets", F.ceil(F.col("_n") / ROWS).cast("long"))
    goal = materialise(targets(strata.groupBy("source").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size")), weights, most), "targets").withColumnRenamed("source", "_goal_source")
    bucket = F.shiftrightunsigned(F.shiftright("_hash", 20) * F.col("_buckets"), 32)
    placed = _meet(sized.withColumn("_hash", seeded_bits(seed, F.col("doc_id"))), strata.drop("_n"), ["source", "size"]).withColumn("_bucket", bucket).drop("_buckets")
    counts = strata.where("_buckets = 1").select("source", "size", F.lit(0).cast("long").alias("_bucket"), "_n")
    if not strata.where("_buckets > 1").isEmpty():
        crowded = placed.select("source", "size", "_bucket").join(broadcast_if_small(strata.where("_buckets > 1").select(F.col("source").alias("_s"), F.col("size").alias("_z")), strata.count(), 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left_semi")
        counts = counts.unionByName(crowded.groupBy("source", "size", "_bucket").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("source").orderBy(F.desc("size"), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("source", "size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    tie = [F.xxhash64("text")] if "text" in docs.columns else []
    inside = Window.partitionBy("source", "size", "_bucket").orderBy("_hash", "doc_id", *tie)
    ranked = _meet(placed.withColumn("_place", F.row_number().over(inside) - 1), offsets, ["source", "size", "_bucket"]).withColumn("_place", F.col("_place") + F.col("_offset"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select("_goal_source", "source_size", "target", rate.alias("rate"), (seeded_bits(seed, F.col("_goal_source")) / F.lit(float(1 << 52))).alias("_start"))
    joined = ranked.join(broadcast_if_small(goal, goal.count(), 96), ranked["source"].eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    fraction = F.col("rate") - F.floor("rate")
    extra = F.floor(F.col("_start") + (F.col("_place") + 1) * fraction) - F.floor(F.col("_start") + F.col("_place") * fraction)
    return joined.withColumn("copies", F.floor("rate") + extra).drop("_bucket", "_hash", "_place", "_offset", "_start")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix() as many times as it has copies, with its number as copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same as SQL over a relation named docs(doc_id, text, source, ...).
SIZED_SQL = r"""
sized as (select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from docs),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from sources),
levelled as (select *, (sum(source_size) over () - coalesce(sum(cap) over fill, 0))::double / (sum(weight) over () - coalesce(sum(weight) over fill, 0))::double as step
  from weighed window fill as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
goals as (select source, source_size, least((select max(step) from levelled) * weight, cap::double) as target from levelled),
rated as (select s.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
    ('0x' || substr(md5('6|' || coalesce(s.source, '')), 1, 13))::bigint / 4503599627370496.0::double as start,
    row_number() over (partition by s.source order by s.size desc, ('0x' || substr(md5('6|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint, doc_id) - 1 as place
  from sized s join goals g on s.source is not distinct from g.source),
mixed as (select *, (floor(rate) + floor(start + (place + 1) * (rate - floor(rate))) - floor(start + place * (rate - floor(rate))))::bigint as copies from rated)
"""
SQL = {"op6_mixing": f"with docs as (select * from documents), {SIZED_SQL} select doc_id, size, source_size, target, size * copies as taken, copies from mixed"}
