"""Located blocks of marked-up documents, from a table of their events: starts and ends of elements, and texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, java_trim, normalise_block
from ..sources.shared import written

#: What each element becomes, and how many blocks a document may have.
KINDS = {"h1": "HEADING", "h2": "HEADING", "h3": "HEADING", "h4": "HEADING", "h5": "HEADING", "h6": "HEADING", "p": "PARAGRAPH", "li": "LIST_ITEM", "tr": "TABLE_ROW"}
BLOCKS = 10_000
#: Events, or blocks, that a task sorts; those of a document stay together.
TASK_ROWS = 200_000
#: What isn't content, and elements without an end.
_SKIPPED = r"(?is)<!--.*?-->|<![^>]*>|<(script|style)\b.*?</(script|style)\s*>"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def markup_events(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """Events (doc_id, seq, kind, name, classes, title, text, spreadsheet) of HTML: comments, scripts, styles and elements without an end are left out."""
    found = pages.select(F.col(id_).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.regexp_replace(html, _SKIPPED, ""), F.lit(r"<[^>]*>|[^<]+"), F.lit(0))).alias("seq", "token"))
    token, tag = F.col("token"), F.col("token").startswith("<")
    value = lambda k: F.nullif(F.regexp_extract(token, rf'(?i)\s{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    text = token
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    events = found.select(
        "doc_id", F.col("seq").cast("long").alias("seq"), F.when(~tag, "text").when(token.startswith("</"), "end").otherwise("start").alias("kind"),
        F.when(tag, F.lower(F.regexp_extract(token, r"^</?\s*(?:[^\s:>/]+:)?([^\s>/]+)", 1))).alias("name"), F.when(tag, F.lower(value("class"))).alias("classes"),
        F.when(tag, F.coalesce(*[F.when(~is_blank(value(k)), java_trim(value(k))) for k in ("name", "title")])).alias("title"), F.when(~tag, text).alias("text"), F.lit(False).alias("spreadsheet"),
    )
    return events.where((F.col("kind") == "text") | ~F.col("name").isin(*_VOID))


def _marks(tags: DataFrame) -> DataFrame:
    """The tags (doc_id, seq, kind, name, in order) that open or close a block. Where none is open the first start opens one, and the next end of its name closes it."""

    class Marks:
        def __init__(self):
            self.name = None

        def eval(self, row):
            if self.name is None and row["kind"] == "start":
                self.name = row["name"]
                yield row["doc_id"], row["seq"], 1
            elif self.name == row["name"] and row["kind"] == "end":
                self.name = None
                yield row["doc_id"], row["seq"], -1

    made = F.udtf(Marks, returnType=f"doc_id {tags.schema['doc_id'].dataType.simpleString()}, seq bigint, mark int")
    return made(tags.asTable().partitionBy("doc_id").orderBy("seq"))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt by documents to as many tasks as n of them need."""
    return rows.repartition(max(1, math.ceil(n / TASK_ROWS)), "doc_id")


def _beside(rows: DataFrame, n: int, more: DataFrame, at: str, *names: str) -> DataFrame:
    """rows, dealt by documents, with the columns `names` of `more` where (doc_id, at) agree; both have a row for each at most, and rows without a partner in `rows` go. A join would deal them by both keys, and into a fixed number of tasks."""
    blank = [F.lit(None).cast(more.schema[c].dataType).alias(c) for c in names]
    both = _dealt(rows.select("*", *blank, F.lit(True).alias("_here")).unionByName(more.select("doc_id", at, *names), allowMissingColumns=True), n)
    one = Window.partitionBy("doc_id", at)
    return both.withColumns({c: F.max(c).over(one) for c in names}).where("_here").drop("_here")


def _open(rows: DataFrame, sets: Column, value: Column, name: str) -> DataFrame:
    """rows with `name`: the value of the innermost element around a row whose start `sets` it. An end belongs to the last start of its name that is open at its depth."""
    so_far = lambda *keys: Window.partitionBy("doc_id", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    step = F.when(start, 1).when(end, -1).otherwise(0)
    out = rows.withColumn("_depth", F.sum(step).over(so_far("name")) + F.when(end, 1).otherwise(0))
    out = out.withColumn("_sets", F.coalesce(F.last(F.when(start, F.coalesce(sets, F.lit(False))), ignorenulls=True).over(so_far("name", "_depth")), F.lit(False)) & (start | end))
    out = out.withColumn("_value", F.when(start & F.col("_sets"), value)).withColumn("_around", F.sum(F.when(F.col("_sets"), step).otherwise(0)).over(so_far()))
    out = out.withColumn(name, F.when(F.col("_around") > 0, F.last("_value", ignorenulls=True).over(so_far("_around"))))
    return out.drop("_depth", "_sets", "_value", "_around")


def blocks(events: DataFrame, most: int = BLOCKS) -> DataFrame:
    """Blocks (doc_id, sequence, type, text, page_number, slide_number, sheet_name, error_code) of events (doc_id, seq, kind, name, classes, title, text, spreadsheet).

    A block takes all text up to the first end of its element's name, with ` | ` before each cell of a row but the first; blank ones go, and one that is never
    closed gives none. Its place is that of its start: pages count outside of spreadsheets, an inner page hides the outer one, and what was before is restored at the
    element's end; a slide within a slide isn't one; a table's name or title, else in a spreadsheet the last heading before it, names the sheet. A document without blocks is one paragraph of all its text, if that isn't blank. More than `most` blocks are
    the error EXTRACTION_LIMIT_EXCEEDED, in one row in place of them. (doc_id, seq) is unique; events without a doc_id are left out; other columns play no part.
    """
    events = events.select("doc_id", "seq", "kind", "name", "classes", "title", "text", "spreadsheet").where("doc_id is not null")
    events = written(events, "events")
    n = events.count()
    start = F.col("kind") == "start"
    marks = _marks(events.where(F.col("kind").isin("start", "end") & F.col("name").isin(*KINDS)).select("doc_id", "seq", "kind", "name"))
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    has = lambda *names: start & F.arrays_overlap(F.split(F.coalesce("classes", F.lit("")), r"\s+"), F.array(*map(F.lit, names)))
    rows = _beside(events, n, marks, "seq", "mark").withColumn("block", F.count_if(F.col("mark") == 1).over(so_far)).withColumn("inside", F.coalesce(F.sum("mark").over(so_far), F.lit(0)) == 1)
    is_page = has("page") & ~F.coalesce("spreadsheet", F.lit(False))
    rows = _open(rows.withColumn("_n", F.count_if(is_page).over(so_far)), is_page, F.col("_n"), "page_number")
    rows = _open(rows.withColumn("_slide", has("slide", "slide-content")), F.col("_slide"), F.lit(1), "_in_slide")
    before = F.lag("_in_slide").over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = rows.withColumn("_first", F.col("_slide") & before.isNull()).withColumn("slide_number", F.when(F.col("_in_slide").isNotNull(), F.count_if("_first").over(so_far)))

    opened, cell = F.col("mark") == 1, start & F.col("name").isin("td", "th")
    parts = F.array_sort(F.collect_list(F.when(F.col("inside") & (cell | (F.col("kind") == "text")), F.struct("seq", "text"))))
    at_open = lambda c: F.max(F.when(opened, F.col(c))).alias(c)
    whole = rows.where("inside or mark = -1").groupBy("doc_id", "block").agg(
        F.max(F.when(opened, F.col("seq"))).alias("from"), F.max(F.when(F.col("mark") == -1, F.col("seq"))).alias("to"), at_open("name"), at_open("page_number"), at_open("slide_number"), at_open("spreadsheet"),
        F.min(F.when(cell & F.col("inside"), F.col("seq"))).alias("first_cell"), parts.alias("parts"),
    ).where(F.col("to").isNotNull())
    between = F.when(F.col("name") == "tr", " | ").otherwise("")
    joined = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.when(p["seq"] > F.col("first_cell"), between).otherwise(""))), "")
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair]), F.col("name"))
    whole = whole.withColumn("text", normalise_block(joined)).where(~is_blank(F.col("text"))).withColumn("type", kind)
    whole = written(whole.drop("parts", "first_cell", "name"), "blocks")

    heads = whole.where(F.col("spreadsheet") & (F.col("type") == "HEADING") & F.col("page_number").isNull() & F.col("slide_number").isNull()).select("doc_id", F.col("to").alias("seq"), F.col("text").alias("head"))
    tags = _beside(events.where("kind <> 'text'").select("doc_id", "seq", "kind", "name", "title"), n, marks, "seq", "mark")
    titled = _beside(tags, n, heads, "seq", "head")
    titled = titled.withColumn("_title", F.coalesce("title", F.last("head", ignorenulls=True).over(so_far)))
    sheets = _open(titled, (F.col("name") == "table") & F.col("_title").isNotNull(), F.col("_title"), "sheet_name").where(opened).select("doc_id", F.col("seq").alias("from"), "sheet_name")

    by_doc = Window.partitionBy("doc_id")
    located = _beside(whole, whole.count(), sheets.where("sheet_name is not null"), "from", "sheet_name").withColumn("n", F.count("*").over(by_doc)).withColumn("sequence", F.row_number().over(by_doc.orderBy("block")))
    columns = ["doc_id", "sequence", "type", "text", F.col("page_number").cast("int").alias("page_number"), F.col("slide_number").cast("int").alias("slide_number"), "sheet_name"]
    kept = located.where(F.col("n") <= most).select(*columns, F.lit(None).cast("string").alias("error_code"))
    over = located.where((F.col("n") > most) & (F.col("sequence") == 1)).select("doc_id", F.lit("EXTRACTION_LIMIT_EXCEEDED").alias("error_code"))
    raw = events.where("kind = 'text'").join(whole.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    plain = raw.select("doc_id", F.lit(1).alias("sequence"), F.lit("PARAGRAPH").alias("type"), normalise_block(F.array_join(F.col("parts.text"), "")).alias("text")).where(~is_blank(F.col("text")))
    return kept.unionByName(over, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True)
