"""From sources to visible items: dispatch by kind, chunks, vectors, counts, quarantine, and one atomic publication."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import main_text
from ..functions.text import is_blank
from ..sources.shared import written
from . import index
from .chunking import chunk_text
from .embedding import vector_error
from .ranking import LIST_BYTES, QUERY_BYTES
from .transcripts import parse_transcript, parse_video, transcript_chunks, transcript_text, untimed_chunks, video_text
from .versions import Conflict, Version, VersionedTables

#: Kinds of sources and the type that their items are stored with.
KINDS = {"DOCUMENT": "documents", "WEB_PAGE": "documents", "AUDIO": "audio", "IMAGE": "images", "VIDEO": "videos", "YOUTUBE": "videos"}
#: Characters of a body at most.
MOST_CHARS = 1_000_000
#: Columns of a chunk beside its source, with their types.
_CHUNK = {"sequence": "int", "content": "string", "heading": "string", "section_id": "string", "speaker": "string", "start_ms": "long", "end_ms": "long"}


def _shaped(chunks: DataFrame) -> DataFrame:
    have = set(chunks.columns)
    return chunks.select("source_id", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _CHUNK.items()])


def _documents(s: DataFrame) -> DataFrame:
    return _shaped(chunk_text(s.select(F.col("source_id").alias("doc_id"), F.col("body").alias("text"))).withColumnRenamed("doc_id", "source_id"))


def _pages(s: DataFrame) -> DataFrame:
    return _documents(s.select("source_id", F.array_join(main_text(F.col("body"))["blocks"], "\n\n").alias("body")))


def _audio(s: DataFrame) -> DataFrame:
    parsed = s.select("source_id", parse_transcript(F.col("body")).alias("segments"), transcript_text(F.col("body")).alias("text"))
    timed = parsed.select("source_id", F.posexplode("segments").alias("position", "s")).select("source_id", "position", "s.*")
    return _shaped(transcript_chunks(timed)).unionByName(_shaped(untimed_chunks(parsed.where(F.size("segments") == 0))))


def _whole(s: DataFrame) -> DataFrame:
    return _shaped(s.select("source_id", F.lit(0).alias("sequence"), F.col("body").alias("content")))


def _videos(s: DataFrame) -> DataFrame:
    v = parse_video(F.col("body"))
    return _whole(s.select("source_id", v.alias("v")).where("v is not null").select("source_id", video_text(F.col("v.summary"), F.col("v.segments")).alias("body")))


#: The path that each kind of source takes from (source_id, body) to chunks.
PATHS: dict[str, Callable[[DataFrame], DataFrame]] = {"DOCUMENT": _documents, "WEB_PAGE": _pages, "AUDIO": _audio, "IMAGE": _whole, "VIDEO": _videos, "YOUTUBE": _videos}


def body_error(kind: Column, body: Column) -> Column:
    """Why a source can't be processed at all; null if it can."""
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    return F.when(~known, "UNSUPPORTED_TYPE").when(is_blank(body), "EMPTY").when(F.length(body) > MOST_CHARS, "EXTRACTION_LIMIT_EXCEEDED")


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids to join with: sent to the tasks while it is small, so that bodies and contents stay where they are."""
    return F.broadcast(ids) if ids.count() * LIST_BYTES <= QUERY_BYTES else ids


def items_and_errors(sources: DataFrame, generation: str, embed: Callable[[Column], Column] | None = None, dim: int = 0) -> tuple[DataFrame, DataFrame]:
    """Split sources (workspace_id, source_id, kind, name, body) by kind, make items of each, and set apart what fails: (items, errors), both written.

    errors (workspace_id, source_id, error_code) has a row for each source without items: of an unknown kind, repeated, blank, too long, without readable content, or with a vector that can't be stored; items of
    a source are kept all or none. A null source_id is an error of its own. Bad rows never stop the others.
    """
    named = sources.select("workspace_id", "source_id", "kind", "name", "body")
    code = F.when(F.col("source_id").isNull() | F.col("workspace_id").isNull(), "MISSING_ID").otherwise(body_error(F.col("kind"), F.col("body")))
    often = named.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1 and source_id is not null").select("source_id", F.lit(True).alias("_again"))
    checked = written(named.join(_sent(written(often, "repeated")), "source_id", "left").withColumn("error_code", F.when(F.col("_again"), "REPEATED_ID").otherwise(code)).drop("_again"), "sources")
    good = checked.where("error_code is null")
    chunks = reduce(DataFrame.unionByName, [path(good.where(F.col("kind") == kind).select("source_id", "body")) for kind, path in PATHS.items()])
    about = good.select("source_id", "workspace_id", F.col("name").alias("source_name"), F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind")).alias("source_type"))
    items = index.items_of_chunks(chunks.join(about, "source_id"), generation)
    items = items.withColumn("sequence", F.when(F.col("section_id").isNotNull(), F.col("sequence")))
    if embed is not None:
        items = items.withColumn("embedding", embed(index.embedding_input(F.col("heading"), F.col("speaker"), F.col("content"))))
        items = items.withColumn("_bad", vector_error(F.col("embedding"), dim))
    items = written(items, "items")
    bad = items.sparkSession.createDataFrame([], "source_id string")
    if embed is not None:
        bad = written(items.where("_bad is not null").select(F.col("source_id").cast("string")).distinct(), "bad-vectors")
        items = items.drop("_bad").join(_sent(bad), "source_id", "left_anti")
    none = good.join(items.select("source_id").distinct(), "source_id", "left_anti").join(bad.withColumn("_vector", F.lit(True)), "source_id", "left")
    errors = checked.where("error_code is not null").select("workspace_id", "source_id", "error_code")
    errors = errors.unionByName(none.select("workspace_id", "source_id", F.when(F.col("_vector"), "INVALID_VECTOR").otherwise("NO_TEXT").alias("error_code")))
    return items, written(errors, "errors")


def ingest(tables: VersionedTables, sources: DataFrame, generation: str, embed: Callable[[Column], Column] | None = None, dim: int = 0, attempts: int = 5) -> Version:
    """Process sources and publish the outcome at once: the tables `items`, `manifests` (workspace_id, source_id, active_generation, expected_items) and `errors` (with generation).

    A source that was indexed before gets the new generation and loses its old items; one that fails keeps what it had, and stands in errors. Before the switch the staged items are counted again for each source.
    Nothing is visible until the version is published; a rival's version is merged with, not overwritten.
    """
    items, errors = items_and_errors(sources, generation, embed, dim)
    counts = written(items.groupBy("workspace_id", "source_id").agg(F.count("*").cast("int").alias("expected_items")).withColumn("active_generation", F.lit(generation)), "counts")
    for _ in range(attempts - 1):
        if (done := _published(tables, items, errors, counts, generation, False)) is not None:
            return done
    return _published(tables, items, errors, counts, generation, True)


def _published(tables: VersionedTables, items: DataFrame, errors: DataFrame, counts: DataFrame, generation: str, last: bool) -> Version | None:
    base = tables.version()
    told = errors.withColumn("generation", F.lit(generation))
    kept, manifests = items, counts
    if "items" in base.tables:
        fresh = counts.select("source_id")
        kept = tables.read("items", base).join(fresh, "source_id", "left_anti").unionByName(items, allowMissingColumns=True)
        manifests = tables.read("manifests", base).join(fresh, "source_id", "left_anti").unionByName(counts)
        told = tables.read("errors", base).join(fresh, "source_id", "left_anti").unionByName(told)
    staged = {"items": tables.stage("items", kept), "manifests": tables.stage("manifests", manifests), "errors": tables.stage("errors", told)}
    read = lambda t: tables.spark.read.parquet(f"{tables.root}/{staged[t]}")
    if not index.completeness(read("items"), read("manifests")).where("not complete").isEmpty():
        raise ValueError("staged items don't agree with their manifests")
    try:
        return tables.publish(base, staged)
    except Conflict:
        if last:
            raise
        return None


def visible_items(tables: VersionedTables, workspace: str | None = None) -> DataFrame:
    """What a reader of the newest version sees."""
    at = tables.version()
    return index.visible(tables.read("items", at), tables.read("manifests", at), workspace)
