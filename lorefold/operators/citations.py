"""Answer context and citations of retrieved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMPTY, is_blank, location, optional, snippet


def file_key(kind: Column, source: Column, name: Column, job: Column) -> Column:
    """type:source, or type:name:job without a source."""
    blank = F.lit("")
    return F.when(source.isNotNull(), F.concat_ws(":", kind, source)).otherwise(F.concat_ws(":", kind, F.coalesce(name, blank), F.coalesce(job, blank)))


def display_name(name: Column, kind: Column) -> Column:
    return F.coalesce(optional(name), kind)


def citations(items: DataFrame) -> DataFrame:
    """Citation of each ranked item: key of its file, display name, place and snippet."""
    return items.select(
        "qid", "rank", "id", file_key(F.col("source_type"), F.col("source_id"), F.col("source_name"), F.col("job_id")).alias("file_key"), display_name(F.col("source_name"), F.col("source_type")).alias("name"),
        location(F.col("start_ms"), F.col("end_ms"), F.col("page_number"), F.col("slide_number"), F.col("sheet_name")).alias("location"), snippet(F.col("content")).alias("snippet"),
    )


def source_files(cited: DataFrame) -> DataFrame:
    """Files of a question's citations in the order they are met, with the attributes of the first and the number of citations."""
    first = cited.groupBy("qid", "file_key").agg(F.min("rank").alias("first_rank"), F.min_by("name", "rank").alias("name"), F.min_by("id", "rank").alias("first_id"), F.count("*").alias("citations"))
    return first


def context(items: DataFrame) -> DataFrame:
    """One text of numbered evidence for each question, with a placeholder for what is missing."""
    value = lambda c: F.when(is_blank(F.col(c).cast("string")), EMPTY).otherwise(F.col(c).cast("string"))
    place = location(F.col("start_ms"), F.col("end_ms"), F.col("page_number"), F.col("slide_number"), F.col("sheet_name"))
    lines = F.concat_ws("\n", F.concat(F.lit("Evidence "), F.col("rank").cast("string")), *[F.concat(F.lit(f"{label}: "), v) for label, v in (
        ("Source type", value("source_type")), ("Source name", value("source_name")), ("Source id", value("source_id")), ("Job id", value("job_id")), ("URL", value("source_url")), ("Chunk", value("id")),
        ("Section", value("section_id")), ("Heading", value("heading")), ("Location", place), ("Speaker", value("speaker")), ("Created", value("created_at")), ("Content", value("content")),
    )])
    rows = F.array_sort(F.collect_list(F.struct("rank", lines.alias("text"))))
    return items.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("context"), F.count("*").alias("n_items"))


def location_label(page: Column, start: Column, end: Column, speaker: Column) -> Column:
    """The label shown beside a citation: the parts that there are."""
    from ..functions.text import time_text

    span = F.when(start.isNotNull(), F.concat(F.lit("Time "), time_text(start), F.coalesce(F.concat(F.lit("–"), time_text(end)), F.lit(""))))
    return F.concat_ws(" · ", F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))), span, optional(speaker))
