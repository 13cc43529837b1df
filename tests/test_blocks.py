"""Blocks of marked-up documents."""

from pyspark.sql import functions as F

from lorefold.operators import blocks as B


def found(spark, *pages, spreadsheet=False, most=B.BLOCKS):
    events = B.markup_events(spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")).withColumn("spreadsheet", F.lit(spreadsheet)).withColumn("block", F.lit(9))
    return sorted((tuple(r) for r in B.blocks(events.repartition(3), most).collect()), key=lambda r: (r[0], r[1] or 0))


def test_blocks_end_at_the_first_end_of_their_name(spark):
    html = "<h1>T &amp; U</h1><ul><li>A<ul><li>B</li><li>C</li></ul>D</li></ul><p>never <b>closed"
    assert [r[1:4] for r in found(spark, html)] == [(1, "HEADING", "T & U"), (2, "LIST_ITEM", "AB"), (3, "LIST_ITEM", "C")]
    assert [r[2:4] for r in found(spark, "<table><tr><th>a</th><td> b</td><td>c</td></tr></table><p>x<td>y</p><p>  </p>")] == [("TABLE_ROW", "a | b | c"), ("PARAGRAPH", "xy")]


def test_places_are_restored(spark):
    html = '<p>0</p><div class="page"><p>1</p><div><div class="x page"><p>2</p></div><p>1b</p></div></div><p>0b</p><div class="page"><p>3</p></div>'
    assert [(r[3], r[4]) for r in found(spark, html)] == [("0", None), ("1", 1), ("2", 2), ("1b", 1), ("0b", None), ("3", 3)]
    html = '<div class="slide"><p>1</p><div class="slide-content"><p>1b</p></div><p>1c</p></div><p>0</p><div class="slide-content"><p>2</p></div>'
    assert [(r[3], r[5]) for r in found(spark, html)] == [("1", 1), ("1b", 1), ("1c", 1), ("0", None), ("2", 2)]


def test_sheets(spark):
    html = '<h1>S1</h1><table><tr><td>a</td></tr></table><p>out</p><div class="page"><table title=" T "><tr><td>b</td></tr><table><tr><td>c</td></tr></table><tr><td>d</td></tr></table></div>'
    assert [(r[3], r[4], r[6]) for r in found(spark, html, spreadsheet=True)] == [("S1", None, None), ("a", None, "S1"), ("out", None, None), ("b", None, "T"), ("c", None, "S1"), ("d", None, "T")]
    assert [(r[3], r[4], r[6]) for r in found(spark, html)] == [("S1", None, None), ("a", None, None), ("out", None, None), ("b", 1, "T"), ("c", 1, "T"), ("d", 1, "T")]


def test_without_blocks_and_beyond_the_limit(spark):
    got = found(spark, "<div>all <b>of</b> it</div>", " <br> ", "<p>1</p><p>2</p>", "<p>1</p><p>2</p><p>3</p>", None, "", most=2)
    assert [r[:4] + r[7:] for r in got if r[1] is not None] == [(0, 1, "PARAGRAPH", "all of it", None), (2, 1, "PARAGRAPH", "1", None), (2, 2, "PARAGRAPH", "2", None)]
    assert [r for r in got if r[1] is None] == [(3, None, None, None, None, None, None, "EXTRACTION_LIMIT_EXCEEDED")]
    assert found(spark) == []


def test_a_task_sorts_a_bounded_number_of_events(spark, monkeypatch):
    """The number of tasks follows the events, whatever the number of shuffle partitions, and a document stays whole."""
    monkeypatch.setattr(B, "TASK_ROWS", 5)
    events = B.markup_events(spark.createDataFrame([(i, f"<h1>{i}</h1><p>a<b>b</b></p>") for i in range(9)], "page_id long, html string"))
    marked = B._beside(events, events.count(), events.where("seq = 1").select("doc_id", "seq", F.lit(7).alias("mark")), "seq", "mark")
    assert marked.rdd.getNumPartitions() == -(-events.count() // 5) > 8
    assert sorted((r.doc_id, r.seq) for r in marked.where("mark = 7").collect()) == [(i, 1) for i in range(9)] and marked.count() == events.count()
    assert [r[:4] for r in found(spark, "<h1>T</h1><p>a</p>", "<p>b</p>")] == [(0, 1, "HEADING", "T"), (0, 2, "PARAGRAPH", "a"), (1, 1, "PARAGRAPH", "b")]
