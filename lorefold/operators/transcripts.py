"""Transcripts and media analyses: parsing, chunks and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, java_trim, optional, time_text

TRANSCRIPT = "text string, transcript string, segments array<struct<text:string,start:string,end:string,speaker:string,timestamps:struct<from:string,to:string>>>"
VIDEO = "summary string, segments array<struct<startMs:double,endMs:double,description:string,speaker:string,text:string>>"
ANSWER = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"


def milliseconds(value: Column) -> Column:
    """Seconds, or h:m:s with a point or comma before the fraction, in milliseconds; 0 for what can't be read."""
    parts = F.split(F.regexp_replace(value, ",", "."), ":")
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
    return F.greatest(F.lit(0), F.coalesce(F.round(seconds * 1000).cast("long"), F.lit(0).cast("long")))


def parse_transcript(body: Column) -> Column:
    """array of (start_ms, end_ms, speaker, text) of a provider's JSON; blank segments are dropped, an end isn't before its start."""
    segments = F.coalesce(F.from_json(body, TRANSCRIPT)["segments"], F.array().cast("array<struct<text:string,start:string,end:string,speaker:string,timestamps:struct<from:string,to:string>>>"))
    start = lambda s: milliseconds(F.coalesce(s["start"], s["timestamps"]["from"]))
    end = lambda s: milliseconds(F.coalesce(s["end"], s["timestamps"]["to"]))
    return F.transform(F.filter(segments, lambda s: ~is_blank(s["text"])), lambda s: F.struct(start(s).alias("start_ms"), F.greatest(start(s), end(s)).alias("end_ms"), s["speaker"].alias("speaker"), java_trim(s["text"]).alias("text")))


def transcript_text(body: Column) -> Column:
    t = F.from_json(body, TRANSCRIPT)
    return F.coalesce(t["text"], t["transcript"])


def parse_video(body: Column) -> Column:
    """struct(summary, segments) of a video analysis; null without a summary."""
    v = F.from_json(body, VIDEO)
    low = lambda s: F.greatest(F.lit(0), F.coalesce(s["startMs"], F.lit(0.0))).cast("long")
    segments = F.transform(F.coalesce(v["segments"], F.array().cast("array<struct<startMs:double,endMs:double,description:string,speaker:string,text:string>>")), lambda s: F.struct(low(s).alias("start_ms"), F.greatest(low(s), F.coalesce(s["endMs"], F.lit(0.0)).cast("long")).alias("end_ms"), s["speaker"].alias("speaker"), F.coalesce(s["text"], s["description"]).alias("text")))
    return F.when(~is_blank(v["summary"]), F.struct(java_trim(v["summary"]).alias("summary"), F.filter(segments, lambda s: ~is_blank(s["text"])).alias("segments")))


def parse_answer(body: Column) -> Column:
    """Text of a model's first candidate; null if there is none."""
    parts = F.get(F.from_json(body, ANSWER)["candidates"], F.lit(0))["content"]["parts"]
    text = java_trim(F.array_join(F.transform(parts, lambda p: p["text"]), ""))
    return F.when(~is_blank(text), text)


def transcript_chunks(segments: DataFrame) -> DataFrame:
    """One chunk for each non-blank segment (source_id, position, start_ms, end_ms, speaker, text), numbered densely from 1."""
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("position"))
    return segments.where(~is_blank(F.col("text"))).select("source_id", number.alias("sequence"), java_trim(F.col("text")).alias("content"), F.lit("Audio transcript").alias("heading"), F.lit("transcript").alias("section_id"), "start_ms", "end_ms", "speaker")


def untimed_chunks(texts: DataFrame) -> DataFrame:
    """For transcripts without any segment (source_id, text): the whole text as one chunk without times, shaped like transcript_chunks; blank ones give none."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("start_ms", "long"), ("end_ms", "long"), ("speaker", "string"))]
    return texts.where(~is_blank(F.col("text"))).select("source_id", F.lit(1).alias("sequence"), java_trim(F.col("text")).alias("content"), F.lit("Audio transcript").alias("heading"), F.lit("transcript").alias("section_id"), *nothing)


def video_text(summary: Column, segments: Column, language: Column | None = None, transcript: Column | None = None) -> Column:
    """The text that stands for a video: what is seen, the language spoken, and what is said, by segments (start_ms, end_ms, speaker, text) or else as one transcript."""
    nothing = F.lit(None).cast("string")
    who = lambda s: F.coalesce(F.concat(optional(s["speaker"]), F.lit(": ")), F.lit(""))
    lines = F.array_join(F.transform(segments, lambda s: F.concat(F.lit("["), time_text(s["start_ms"]), F.lit(" - "), time_text(s["end_ms"]), F.lit("] "), who(s), java_trim(s["text"]))), "\n")
    said = F.when(F.size(segments) > 0, lines).otherwise(optional(nothing if transcript is None else transcript))
    parts = [F.concat(F.lit("Visual summary:\n"), java_trim(summary)), F.concat(F.lit("Spoken language: "), optional(nothing if language is None else language)), F.concat(F.lit("Spoken transcript:\n"), said)]
    return F.concat_ws("\n\n", *parts)  # leaves nulls out


def render_transcript(segments: DataFrame) -> DataFrame:
    """One text for each source: `[from - to] speaker: text` lines in order."""
    who = F.coalesce(F.concat(F.col("speaker"), F.lit(": ")), F.lit(""))
    line = F.concat(F.lit("["), time_text(F.col("start_ms")), F.lit(" - "), time_text(F.col("end_ms")), F.lit("] "), who, java_trim(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return segments.where(~is_blank(F.col("text"))).groupBy("source_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"), F.count("*").alias("n_segments"))


def ocr_text(regions: Column) -> Column:
    """Text of OCR regions, a line each."""
    return F.array_join(F.transform(regions, lambda r: r["text"]), "\n")


def merge_ocr(blocks: DataFrame, pages: DataFrame, ocr: DataFrame, most: int = 50) -> DataFrame:
    """Blocks (doc_id, sequence, page_number, text) with OCR text (doc_id, page_number, text) for pages (doc_id, page_number) that show no letter or digit, renumbered in page order."""
    legible = blocks.where(F.col("text").rlike(r"[\p{L}\p{Nd}]")).select("doc_id", "page_number").distinct()
    bare = pages.join(legible, ["doc_id", "page_number"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).where(F.col("n") <= most)
    added = ocr.where(~is_blank(F.col("text"))).join(bare.select("doc_id", "page_number"), ["doc_id", "page_number"]).select("doc_id", F.lit(1 << 30).alias("sequence"), "page_number", "text")
    both = blocks.select("doc_id", "sequence", "page_number", "text").unionByName(added)
    return both.withColumn("sequence", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "sequence")))
