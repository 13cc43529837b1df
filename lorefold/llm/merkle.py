"""Merkle manifest of a dataset: nested structs rolled up over the digits of ranks within bounded blocks, from which proofs are emitted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table

#: Children of a node; levels of a block, which so has WIDTH ** LEVELS leaves at most; rows that a range of ranks has on average.
WIDTH, LEVELS, RANGE_ROWS = 3, 6, 20_000
#: The type of a proof's steps: siblings that stand before, and all of them; a bound on the bytes of the steps of 24 levels.
STEPS = "array<struct<before:int,siblings:array<string>>>"
STEP_BYTES = WIDTH * 70 * 24
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts, one after another; none of them may be null."""
    return F.sha2(F.concat(F.lit(""), *parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A field of a leaf: `-` if null, else its UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add rank (from 0, long, in the order of the columns `order` within the group) and n (rows of the group). The group may be null, which is a group of its own.

    Rows are dealt by ranges of (group, order) and written with the number of their range; ranks within a range are lifted by the counts of the ranges before,
    one small row for each range and group. So no task sorts a whole group, only equal rows stay together, and the numbers outlive lost executors. Rows alike in group and order are interchangeable.
    """
    parts = max(1, -(-nodes.count() // RANGE_ROWS), nodes.sparkSession.sparkContext.defaultParallelism)
    dealt = materialise(nodes.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_k"))
    of, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.struct(group).alias("_of"), F.col("_range").alias("_in"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(of).alias("n"))
    offsets = materialise(offsets, "merkle-offsets")
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1
    met = dealt.withColumn("_place", place).join(broadcast_if_small(offsets, offsets.count(), 128), (F.col("_range") == F.col("_in")) & (F.struct(group) == F.col("_of")))
    return met.withColumn("rank", (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_of", "_in", "_before")


def _level(nodes: DataFrame, k: int) -> DataFrame:
    """Group the digit of level k away: runs of up to WIDTH nodes become one, which keeps them as kids. Where the group has one node by now, it stays what it is."""
    rest = [f"d{j}" for j in range(k + 1, LEVELS)]
    kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "digest", "kids"))).alias("kids")
    out = nodes.groupBy("up", "n", *rest).agg(kids)
    many = F.col("n") > WIDTH**k
    return out.withColumn("digest", F.when(many, digest(F.array_join("kids.digest", ""))).otherwise(F.col("kids")[0]["digest"]))


def _leaves(node: Column, n: Column, k: int, steps: Column) -> Column:
    """The leaves under the kids of a node of level k, each with the steps of its proof from itself up to the node, followed by `steps`."""

    def below(kid: Column) -> Column:
        others = F.transform(F.filter(node["kids"], lambda x: x["digit"] != kid["digit"]), lambda x: x["digest"])
        own = F.array(F.struct(kid["digit"].alias("before"), others.alias("siblings")))
        path = F.concat(F.when(n > WIDTH**k, own).otherwise(F.array().cast(STEPS)), steps)
        return F.array(F.struct(kid["kids"].alias("leaf"), path.alias("steps"))) if k == 0 else _leaves(kid, n, k - 1, path)

    return F.flatten(F.transform(node["kids"], below))


def blocks(nodes: DataFrame, group: str, payload: Column) -> DataFrame:
    """Roll up (group, rank, n, digest) to a row for each block: (group, block, n, digest, kids, steps, root), with the payload of each leaf at the bottom of kids, and the steps from the block to the root of its group.

    A block is WIDTH ** LEVELS neighbours of a group. Its rows meet once, by (group, block); then the digits of the rank are grouped away one by one in the same tasks, nesting children in
    their node. The roots of a group's blocks are the leaves of the same work a level higher, of which there is one for 729 leaves; the steps that follow from it reach a block's row by (group, block).
    """
    digits = [F.expr(f"cast(rank div {WIDTH**k} % {WIDTH} as int)").alias(f"d{k}") for k in range(LEVELS)]
    up = F.struct(F.col(group).alias("of"), F.expr(f"rank div {WIDTH**LEVELS}").alias("block")).alias("up")
    rows = nodes.select(up, "n", "digest", payload.alias("kids"), *digits).repartition("up")
    for k in range(LEVELS):
        rows = _level(rows, k)
    rows = materialise(rows, "merkle-blocks")
    if (rows.agg(F.max("n")).first()[0] or 0) > WIDTH**LEVELS:
        higher = rows.select(F.col("up.of").alias(group), F.col("up.block").alias("rank"), F.expr(f"(n + {WIDTH**LEVELS - 1}) div {WIDTH**LEVELS}").alias("n"), "digest")
        above = proofs(blocks(higher, group, F.col("rank")), group)
        above = materialise(above.select(F.struct(F.col(group).alias("of"), F.col("leaf").alias("block")).alias("_up"), "steps", "root"), "merkle-upper")
        rows = rows.join(broadcast_if_small(above, above.count(), STEP_BYTES), rows["up"] == above["_up"])
    else:
        rows = rows.withColumns({"steps": F.array().cast(STEPS), "root": F.col("digest")})
    return rows.select(F.col("up.of").alias(group), F.col("up.block").alias("block"), "n", "digest", "kids", "steps", "root")


def proofs(rolled: DataFrame, *keep: str) -> DataFrame:
    """Emit (the columns to keep, leaf, steps, root) from blocks(): a transform over the nested struct gives each leaf its steps, and an explode makes rows of them. Leaves join nothing."""
    node = F.struct("kids")
    out = rolled.select(*keep, "root", F.explode(_leaves(node, F.col("n"), LEVELS - 1, F.col("steps"))).alias("_x"))
    return out.select(*keep, F.col("_x.leaf").alias("leaf"), F.col("_x.steps").alias("steps"), "root")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""

    def up(acc: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], 1, step["before"])
        after = F.slice(step["siblings"], step["before"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), acc, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def manifest(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """One row (order, group, leaf, seen, subroot, root, steps) for each row of docs: its leaf digest, the digest of what `tampered` makes of its columns' text (the leaf itself without it), and its proof.

    Leaves ascend by doc_id within a source; runs of WIDTH become their digest until one node is left, the source's subroot (a lone leaf is its own). Subroots, by source in the order of UTF-8 bytes and null
    first, give the root likewise. Rows of one doc_id and source stand in the order of their leaves; a null doc_id comes first. Null fields are `-`, an empty text is `0:`. Texts are hashed whole
    where they are read, and only digests move. Columns that aren't fields are ignored. An empty table has no rows.
    """
    leaf = digest(*[field(F.col(c)) for c in fields])
    seen = leaf if tampered is None else digest(*[field(tampered(F.col(c)) if c == "text" else F.col(c)) for c in fields])
    narrow = docs.select(F.col(order).alias("_id"), F.col(group).alias("_group"), leaf.alias("digest"), F.when(seen != leaf, seen).alias("_seen"))
    leaves = ranked(narrow, "_group", ["_id", "digest", "_seen"])
    own = blocks(leaves, "_group", F.struct("_id", "digest", "_seen"))
    subroots = own.where("block = 0").select("_group", F.col("root").alias("digest"), F.lit(0).alias("_all"))
    top = proofs(blocks(ranked(subroots, "_all", ["_group"]), "_all", F.col("_group")))
    top = materialise(top.select(F.struct(F.col("leaf").alias("_group")).alias("_of"), F.col("steps").alias("_top"), F.col("root").alias("_root")), "merkle-top")
    met = own.join(broadcast_if_small(top, top.count(), STEP_BYTES), F.struct("_group") == F.col("_of"))
    met = proofs(met.withColumn("steps", F.concat("steps", "_top")).withColumn("_subroot", F.col("root")).withColumn("root", F.col("_root")), "_group", "_subroot")
    return met.select(
        F.col("leaf._id").alias(order), F.col("_group").alias(group), F.col("leaf.digest").alias("leaf"), F.coalesce("leaf._seen", "leaf.digest").alias("seen"), F.col("_subroot").alias("subroot"), "root", "steps",
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest(docs, tampered=lambda text: F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    proof = F.sha2(F.array_join(F.flatten(F.col("steps.siblings")), "").cast("binary"), 256)
    folded = fold(F.col("seen"), F.col("steps"))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, group: str, levels: int) -> str:
    """Relations that raise `name`(group, idx, digest, n) level by level: {name}_k holds the nodes of level k, {name}_runs_k its runs in order."""
    parts = [f"{name}_0 as (select {group}, idx, digest, n from {name})"]
    for k in range(levels):
        parts.append(f"{name}_runs_{k} as (select {group}, idx // {WIDTH} as up, max(n) as n, list(digest order by idx) as digests from {name}_{k} group by {group}, idx // {WIDTH})")
        parts.append(f"{name}_{k + 1} as (select {group}, up as idx, case when n > 1 then sha256(array_to_string(digests, '')) else digests[1] end as digest, (n + {WIDTH - 1}) // {WIDTH} as n from {name}_runs_{k})")
    return ",\n".join(parts)


def _climb_sql(rows: str, name: str, group: str, idx: str, levels: int) -> str:
    """Relations {rows}_{name}_k: rows that have folded `acc` and gathered `proof` over k levels of the tree."""
    parts = [f"{rows}_{name}_0 as (select * from {rows})"]
    for k in range(levels):
        at = f"(({idx} // {WIDTH**k}) % {WIDTH})"
        before, after = f"array_to_string(list_slice(t.digests, 1, {at}), '')", f"array_to_string(list_slice(t.digests, {at} + 2, {WIDTH}), '')"
        parts.append(f"""{rows}_{name}_{k + 1} as (select r.* exclude (acc, proof), case when t.n > 1 then sha256({before} || acc || {after}) else acc end as acc,
  case when t.n > 1 then proof || {before} || {after} else proof end as proof
  from {rows}_{name}_{k} r join {name}_runs_{k} t on r.{group} is not distinct from t.{group} and r.{idx} // {WIDTH ** (k + 1)} = t.up)""")
    return ",\n".join(parts)


#: Levels that the SQL spells out: 531,441 leaves a source and 6,561 sources. The crc32 goes bit by bit, a byte coming in before its first one.
_DOWN, _TOP = 12, 8
_CRC_SQL = "xor(list_reduce([4294967295::bigint] || flatten([[c, 0, 0, 0, 0, 0, 0, 0] for c in [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]]), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _field_sql(x: str) -> str:
    return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"


def _manifest_sql() -> str:
    head = " || ".join(_field_sql(c) for c in FIELDS[:-1])
    return f"""
with hashed as (select doc_id, source, sha256({head} || {_field_sql("text")}) as leaf,
    sha256({head} || {_field_sql(f"case when {_CRC_SQL} % 2 = 0 then replace(text, chr(10), '') else text end")}) as seen from documents),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as rank, seen as acc, '' as proof from hashed),
low as (select source, rank as idx, leaf as digest, count(*) over (partition by source) as n from leaves),
{_tree_sql("low", "source", _DOWN)},
ordered as (select source, digest as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from low_{_DOWN}),
high as (select 0 as whole, place as idx, subroot as digest, n from ordered),
{_tree_sql("high", "whole", _TOP)},
{_climb_sql("leaves", "low", "source", "rank", _DOWN)},
placed as (select l.*, o.subroot, o.place, 0 as whole from leaves_low_{_DOWN} l join ordered o on l.source is not distinct from o.source),
{_climb_sql("placed", "high", "whole", "place", _TOP)}
select doc_id, leaf, subroot, (select digest from high_{_TOP}) as root, sha256(proof) as proof_sha256, acc as folded_root, acc = (select digest from high_{_TOP}) as verified from placed_high_{_TOP}
"""


SQL: dict[str, str] = {"op12_merkle_manifest": _manifest_sql()}
