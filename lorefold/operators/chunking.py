"""Sentence-bounded, section-aware chunks of ordered text blocks, as windows over exploded sentences."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import heading_level, is_blank, is_heading, java_trim, paragraphs

#: A sentence ends at . ? or !, closing quotes included, before white space that no lower-case letter follows.
_END = regex.compile(r"[.?!]+[\"'”’»)\]]*\s+(?=[^\p{Ll}\s])")
#: Titles and initials (A to Z) at the end of a piece, after which the sentence goes on.
_ABBREVIATION = regex.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|St|[A-Z])\.$")
#: Heading levels that heading_level() tells apart.
LEVELS = 6


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a paragraph, trimmed; blank ones are dropped. A piece that ends in a title or an initial takes the next one along, with the white space between."""
    out: list[str] = []
    pending = ""
    at = 0
    text = text or ""
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        pending += text[at:end]
        at = end
        piece = pending.strip()
        if _ABBREVIATION.search(piece):
            continue
        if piece:
            out.append(piece)
        pending = ""
    return [*out, pending.strip()] if pending.strip() else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences)


#: Held to be non-deterministic, so that filters over its column don't make Spark split the texts again.
sentences = _sentences.asNondeterministic()


def chunk_blocks(blocks: DataFrame, max_sentences: int = 5) -> DataFrame:
    """Chunks of blocks (doc_id, sequence, type, text, page_number, slide_number, sheet_name).

    A heading, by type or by look, closes the chunk, opens a section and becomes its heading path; a change of page, slide or sheet closes the chunk only.
    A chunk has max_sentences sentences at most; paragraphs in it stand apart by an empty line. A heading without sentences of its own in its run
    is a chunk that holds its path. Blank blocks count for nothing. The blocks are shuffled once, by document; everything else is running values over their order.
    """
    if max_sentences < 1:
        raise ValueError("max_sentences must be positive")
    where = ["page_number", "slide_number", "sheet_name"]
    parts = blocks.where(~is_blank(F.col("text"))).select("doc_id", "sequence", "type", *where, F.posexplode(paragraphs(F.col("text"))).alias("part", "paragraph"))
    head = F.coalesce((F.col("type") == "HEADING") | is_heading(F.col("paragraph")), F.lit(False))
    parts = parts.select("doc_id", "sequence", "part", *where, "paragraph", head.alias("head"), sentences("paragraph").alias("sentences"))
    parts = parts.select("doc_id", "sequence", "part", *where, "head", F.when(F.col("head"), F.col("paragraph")).alias("title"), F.when(F.col("head"), heading_level(F.col("paragraph"))).alias("level"), F.when(~F.col("head"), F.col("sentences")).alias("sentences"))
    parts = parts.withColumn("n", F.when(F.col("head"), 0).otherwise(F.size("sentences")))

    doc = Window.partitionBy("doc_id").orderBy("sequence", "part")
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*where)
    moved = ~place.eqNullSafe(F.lag(place).over(doc)) & (F.row_number().over(doc) > 1)
    parts = parts.withColumn("opens", F.col("head") | moved)
    count = lambda c: F.sum(F.col(c).cast("int")).over(so_far)
    parts = parts.withColumns({"section": count("head"), "run": count("opens"), "before": count("n") - F.col("n")})
    # A heading of level l stands in the stack at min(l, 1 + the place of the one before), which is its number plus the least of 0 and all l - number so far.
    parts = parts.withColumns({
        "depth": F.col("section") + F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("head"), F.col("level") - F.col("section"))).over(so_far), F.lit(0))),
        "offset": F.col("before") - F.coalesce(F.max(F.when(F.col("opens"), F.col("before"))).over(so_far), F.lit(0)),
    })
    levels = [f"title_{k}" for k in range(1, LEVELS + 1)]
    parts = parts.withColumns({c: F.last(F.when(F.col("depth") == k, F.col("title")), ignorenulls=True).over(so_far) for k, c in enumerate(levels, 1)})
    path = F.when(F.col("section") > 0, F.concat_ws(" > ", *[F.when(F.col("depth") >= k, F.col(c)) for k, c in enumerate(levels, 1)]))

    # What a part gives to each piece of its run: a heading nothing, but it opens the first.
    def given(piece: Column) -> Column:
        start = F.greatest(piece * max_sentences - F.col("offset"), F.lit(0))
        end = F.least((piece + 1) * max_sentences - F.col("offset"), F.col("n"))
        return F.struct(piece.alias("piece"), F.array_join(F.slice("sentences", (start + 1).cast("int"), (end - start).cast("int")), " ").alias("text"))

    of = lambda at: F.floor(at / max_sentences)
    pieces = F.when(F.col("head"), F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("text")))).when(F.col("n") > 0, F.transform(F.sequence(of(F.col("offset")), of(F.col("offset") + F.col("n") - 1)), given))
    body = parts.select("doc_id", "run", "section", path.alias("heading"), "sequence", "part", *where, F.explode_outer(pieces).alias("x")).where("x is not null")
    rows = F.array_sort(F.collect_list(F.when(F.col("x.text").isNotNull(), F.struct("sequence", "part", F.col("x.text").alias("text")))))
    chunks = body.groupBy("doc_id", "run", F.col("x.piece").alias("piece")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("content"), *[F.first(c).alias(c) for c in ("section", "heading", *where)])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "piece"))
    content = F.when(F.col("content") == "", F.col("heading")).otherwise(F.col("content"))
    return chunks.select("doc_id", number.alias("sequence"), content.alias("content"), "heading", F.col("section").cast("string").alias("section_id"), *where)


def chunk_text(docs: DataFrame, max_sentences: int = 5) -> DataFrame:
    """Chunks of plain texts (doc_id, text): each paragraph is a block."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("page_number", "int"), ("slide_number", "int"), ("sheet_name", "string"))]
    return chunk_blocks(docs.select("doc_id", F.lit(1).alias("sequence"), F.lit("PARAGRAPH").alias("type"), "text", *nothing), max_sentences)


def group_sentences(docs: DataFrame, pattern: str, size: int = 5) -> DataFrame:
    """Groups of up to `size` sentences where a regular expression cuts (doc_id, chunk, content): the part of chunking that SQL can express."""
    cut = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", pattern), java_trim), lambda s: s != "")).alias("at", "sentence"))
    cut = cut.withColumn("chunk", F.floor(F.col("at") / size).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("at", "sentence")))
    return cut.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(rows, lambda x: x["sentence"]), " ").alias("content"))


def render_blocks(blocks: DataFrame, max_chars: int = 1_000_000) -> DataFrame:
    """Text of each document (doc_id, content, error_code): markers where page, slide or sheet changes, # before headings, empty lines between blocks."""
    doc = Window.partitionBy("doc_id").orderBy("sequence")
    marker = lambda c, name: F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.last(c, ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))), F.concat(F.lit(f"[{name}"), F.col(c).cast("string"), F.lit("]")))
    line = F.when(F.col("type") == "HEADING", F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    rows = blocks.where(~is_blank(F.col("text"))).withColumn("line", F.concat_ws("\n\n", marker("page_number", "Page "), marker("slide_number", "Slide "), marker("sheet_name", "Sheet: "), line))
    parts = F.array_sort(F.collect_list(F.struct("sequence", "line")))
    text = rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("content"))
    return text.select("doc_id", F.when(F.length("content") <= max_chars, F.col("content")).alias("content"), F.when(F.length("content") > max_chars, "EXTRACTION_LIMIT_EXCEEDED").alias("error_code"))
