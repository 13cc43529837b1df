"""The chunk store: generations of items, their manifests, visibility, upserts and prunes, over Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, is_blank, java_trim, optional

SOURCE_TYPES = {"DOCUMENT": "documents", "AUDIO": "audio", "IMAGE": "images", "VIDEO": "videos"}


def source_generation(source: Column, generation: Column) -> Column:
    return F.when(source.isNotNull() & generation.isNotNull(), F.concat_ws(":", source, generation))


def item_id(source: Column, generation: Column, sequence: Column) -> Column:
    """source:generation:sequence, or source:sequence without a generation; null without a source."""
    return F.when(source.isNotNull(), F.concat_ws(":", source, generation, F.coalesce(sequence, F.lit(0)).cast("string")))


def source_type(c: Column) -> Column:
    """The stored type of a source; what isn't known counts as documents."""
    return F.when(c.isin(*SOURCE_TYPES.values()), c).otherwise("documents")


def from_hits(hits: DataFrame) -> DataFrame:
    """The tolerant read: content and workspace default to empty, created_at to the epoch, the type to documents."""
    fill = {"content": F.coalesce("content", F.lit("")), "workspace_id": F.coalesce("workspace_id", F.lit("")), "source_type": source_type(F.col("source_type")), "created_at": F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))}
    return hits.withColumns({k: v for k, v in fill.items() if k in hits.columns})


def items_of_chunks(chunks: DataFrame, generation: str | None = None) -> DataFrame:
    """Items of chunks (workspace_id, source_id, sequence, content, heading, speaker, ...): ids, trimmed fields, the embedding input and its hash; blank chunks are dropped."""
    kept = chunks.where(~is_blank(F.col("content")))
    g = F.lit(generation).cast("string")
    out = kept.withColumns({"content": java_trim(F.col("content")), "heading": optional(F.col("heading")), "speaker": optional(F.col("speaker")), "generation": g})
    out = out.withColumns({"id": item_id(F.col("source_id"), g, F.col("sequence")), "source_generation": source_generation(F.col("source_id"), g)})
    return out.withColumn("content_hash", F.sha2(embedding_input(F.col("heading"), F.col("speaker"), F.col("content")).cast("binary"), 256))


def embedding_input(heading: Column, speaker: Column, content: Column) -> Column:
    """Heading and speaker, where there are any, before the content."""
    return F.concat(F.coalesce(F.concat(optional(heading), F.lit("\n\n")), F.lit("")), F.coalesce(F.concat(F.lit("Speaker: "), optional(speaker), F.lit("\n\n")), F.lit("")), content)


def visible(items: DataFrame, manifests: DataFrame, workspace: str | None = None) -> DataFrame:
    """Items of published generations, and items without a generation whose source has no manifest (a null source has none)."""
    if workspace is not None:
        items, manifests = items.where(F.col("workspace_id") == workspace), manifests.where(F.col("workspace_id") == workspace)
    active = manifests.select(source_generation(F.col("source_id"), F.col("active_generation")).alias("source_generation")).distinct()
    published = items.where("source_generation is not null").join(active, "source_generation", "left_semi")
    managed = manifests.select("source_id").distinct()
    legacy = items.where("source_generation is null").join(managed, "source_id", "left_anti")
    return published.select(*items.columns).unionByName(legacy.select(*items.columns))


def owned(workspaces: DataFrame, owner: str) -> DataFrame:
    return workspaces.where(F.col("owner_id") == owner).orderBy(F.desc("created_at"))


def completeness(items: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each manifest: expected and indexed items of its generation, and whether they agree."""
    counts = items.where("source_generation is not null").groupBy("source_generation").agg(F.count("*").alias("indexed_items"))
    m = manifests.withColumn("source_generation", source_generation(F.col("source_id"), F.col("active_generation"))).join(counts, "source_generation", "left")
    n = F.coalesce("indexed_items", F.lit(0)).cast("long")
    return m.select("source_id", "active_generation", F.col("expected_items").cast("long").alias("expected_items"), n.alias("indexed_items"), (n == F.col("expected_items")).alias("complete"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of their key. Of new rows that share a key one stays, the greatest by all its columns; rows without a key are kept as they are."""
    fresh = new.select(*existing.columns)
    once = fresh.groupBy(key).agg(F.max(F.struct(*fresh.columns)).alias("row")).where(F.col(key).isNotNull()).select("row.*")
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(once).unionByName(fresh.where(F.col(key).isNull()))


def replace_source(existing: DataFrame, new: DataFrame, workspace: str, source: str) -> DataFrame:
    """The source's rows become `new`, whose rows must all belong to it."""
    if not new.where(~(F.col("workspace_id").eqNullSafe(F.lit(workspace)) & F.col("source_id").eqNullSafe(F.lit(source)))).isEmpty():
        raise ValueError("an item belongs to another source")
    return delete_source(existing, workspace, source).unionByName(new.select(*existing.columns))


def delete_source(items: DataFrame, workspace: str, source: str) -> DataFrame:
    return items.where(~((F.col("workspace_id") == workspace) & F.coalesce(F.col("source_id") == source, F.lit(False))))


def delete_workspace(items: DataFrame, workspace: str) -> DataFrame:
    return items.where(~F.coalesce(F.col("workspace_id") == workspace, F.lit(False)))


def stage_generation(items: DataFrame, path: str, source: str, generation: str, expected: int) -> None:
    """Write one generation of a source to its own folder and verify its count; nothing is visible yet."""
    bad = items.where(~(F.col("source_id").eqNullSafe(F.lit(source)) & F.col("generation").eqNullSafe(F.lit(generation))))
    if not bad.isEmpty():
        raise ValueError("an item belongs to another source or generation")
    target = f"{path}/source={source}/generation={generation}"
    items.write.mode("overwrite").parquet(target)
    found = items.sparkSession.read.parquet(target).count()
    if found != expected:
        raise ValueError(f"staged {found} of {expected} items")


def publish(manifests: DataFrame, source: str, workspace: str, generation: str, expected: int) -> DataFrame:
    """Manifests after the switch of a source to a generation."""
    if expected < 1:
        raise ValueError("a manifest needs items")
    row = manifests.sparkSession.createDataFrame([(source, workspace, generation, expected)], "source_id string, workspace_id string, active_generation string, expected_items int")
    return upsert(manifests.select("source_id", "workspace_id", "active_generation", F.col("expected_items").cast("int").alias("expected_items")), row, "source_id")


def prune(items: DataFrame, manifests: DataFrame) -> DataFrame:
    """Items without those of inactive generations of managed sources."""
    active = manifests.select(F.col("source_id").alias("m"), "active_generation")
    joined = items.join(active, items["source_id"] == F.col("m"), "left")
    return joined.where("m is null or (generation is not null and generation = active_generation)").select(*[items[c] for c in items.columns])


def check_delete(response: dict) -> None:
    """Refuse a response to a delete that timed out or names failures."""
    failures = response.get("failures", [])
    if response.get("timed_out") or not isinstance(failures, list) or failures:
        raise RuntimeError("delete was incomplete")


def scan(items: DataFrame, limit: int | None = 1000) -> DataFrame:
    """A workspace's items in their order, without embeddings; the service reads 1000 at most."""
    out = items.drop("embedding").orderBy(F.asc("created_at"), F.asc_nulls_last("source_id"), F.asc_nulls_last("chunk_sequence"), F.asc("id"))
    return out if limit is None else out.limit(limit)


def workspace_knowledge(items: DataFrame, span_seconds: int | None = None) -> DataFrame:
    """Contents of each workspace by kind of source, in item order, joined by empty lines; null for a kind without content.

    A text is one row of one task, so for large workspaces give span_seconds: then each workspace has a row (workspace_id, span, ...) for each span of created_at with
    items, and its text is that of its spans in their order.
    """
    rows = items.where(~is_blank(F.col("content"))).withColumn("row", F.struct("created_at", F.col("source_id").isNull().alias("n1"), "source_id", F.col("chunk_sequence").isNull().alias("n2"), "chunk_sequence", "id", "content"))
    part = lambda kind: F.when(F.count_if(F.col("source_type") == kind) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source_type") == kind, F.col("row")))), lambda r: r["content"]), "\n\n"))
    keys = ["workspace_id"] if span_seconds is None else ["workspace_id", F.floor(F.unix_timestamp("created_at") / span_seconds).alias("span")]
    return rows.groupBy(*keys).agg(*[part(k).alias(k) for k in SOURCE_TYPES.values()])


def has_knowledge(sources: DataFrame, items: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether each source (workspace_id, source_id) is indexed whole: its manifest is the workspace's and counts its items; without a manifest, any item will do."""
    done = completeness(items, manifests).join(manifests.select("source_id", F.col("workspace_id").alias("_owner")), "source_id").select("source_id", "complete", "_owner")
    some = items.select("workspace_id", "source_id").distinct().withColumn("_some", F.lit(True))
    out = sources.join(done, "source_id", "left").join(some, ["workspace_id", "source_id"], "left")
    managed = F.col("_owner").isNotNull()
    return out.select("workspace_id", "source_id", F.when(managed, F.col("complete") & (F.col("_owner") == F.col("workspace_id"))).otherwise(F.coalesce("_some", F.lit(False))).alias("has_knowledge"))


def whole_items(texts: DataFrame, generation: str | None = None) -> DataFrame:
    """Items of whole texts (workspace_id, source_id, content, ...): one a source, of sequence 0, without a place in it."""
    nothing = {c: F.lit(None).cast("string") for c in ("heading", "speaker") if c not in texts.columns}
    return items_of_chunks(texts.withColumns({**nothing, "sequence": F.lit(0)}), generation).withColumn("sequence", F.lit(None).cast("int"))


def append_fields(items: DataFrame, updates: DataFrame, generation: str | None = None) -> DataFrame:
    """Items with updates of fields (workspace_id, source_id, content) as items of their own; nothing is overwritten."""
    return items.unionByName(whole_items(updates, generation).select(*items.columns))


def embedded(items: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Items with the vectors (id, embedding) of their ids, all or none: a missing, second or wrong vector is an error, found when the result is computed."""
    one = vectors.groupBy("id").agg(F.count("*").alias("_n"), F.first("embedding").alias("embedding"))
    joined = items.drop("embedding").join(one, "id", "left")
    good = (F.col("_n") == 1) & (F.size("embedding") == dim)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no single vector of the right length for "), F.col("id").cast("string"))))
    return joined.withColumn("embedding", checked).drop("_n")


def audit_key(c: Column) -> Column:
    return fingerprint(c)


def stored_files(files: DataFrame) -> DataFrame:
    """Content-addressed keys of binaryFile rows (path, content): digest, size and key."""
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("sha256"), F.length("content").cast("long").alias("size_bytes"), F.concat_ws("/", F.substring(digest, 1, 2), digest).alias("storage_key"))


def content_exists(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each source's bytes are there; one without a storage key is an address and has none to miss."""
    have = files.select("storage_key").distinct().withColumn("_have", F.lit(True))
    return sources.join(have, "storage_key", "left").withColumn("content_exists", F.col("storage_key").isNull() | F.coalesce("_have", F.lit(False))).drop("_have")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def append_history(answers: DataFrame, path: str) -> None:
    """Append answers (workspace_id, created_at, ...) as JSON text."""
    rest = [c for c in answers.columns if c not in ("id", "workspace_id", "created_at")]
    answers.select("id", "workspace_id", "created_at", F.to_json(F.struct(*rest)).alias("answer_json")).write.mode("append").parquet(path)


def read_history(history: DataFrame, workspace: str, schema: str, limit: int = 20) -> DataFrame:
    rows = history.where(F.col("workspace_id") == workspace).orderBy(F.desc("created_at")).limit(min(max(limit, 1), 100))
    return rows.select("id", "created_at", F.from_json("answer_json", schema).alias("answer"))


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
