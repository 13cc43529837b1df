"""Ingestion from sources of all kinds to visible items, with quarantine and generations."""

import json

import pytest
from pyspark.sql import functions as F

from lorefold.operators import ingestion
from lorefold.operators.embedding import hashed_words
from lorefold.operators.versions import VersionedTables

SOURCES = "workspace_id string, source_id string, kind string, name string, body string"
SEGMENTS = {"segments": [{"start": 1.5, "end": 2, "speaker": "Ann", "text": "Hello."}, {"start": 3, "end": 4, "text": "  "}, {"start": 5, "end": 6, "text": "Bye."}]}
VIDEO = {"summary": " A cat. ", "segments": [{"startMs": 0, "endMs": 1500, "speaker": " Bo ", "text": "Meow."}]}
ROWS = [
    ("w", "doc", "DOCUMENT", "a.txt", "CHAPTER 1\n\nOne. Two. Three. Four. Five. Six."), ("w", "page", "WEB_PAGE", "p", "<html><body><nav>menu</nav><main><h1>Title</h1><p>Text here.</p></main></body></html>"),
    ("w", "talk", "AUDIO", "t.wav", json.dumps(SEGMENTS)), ("w", "plain", "AUDIO", "u.wav", json.dumps({"text": " all of it "})), ("w", "cat", "VIDEO", "c.mp4", json.dumps(VIDEO)), ("v", "tube", "YOUTUBE", "y", json.dumps({"summary": "A dog."})),
    ("w", "pic", "IMAGE", "i.png", " A house. "), ("w", "odd", "ARCHIVE", "z.zip", "x"), ("w", "blank", "DOCUMENT", "b.txt", " \n "), ("w", "none", "AUDIO", "n.wav", "{"), ("w", "long", "IMAGE", "l.png", "x" * 1_000_001),
    ("w", "twice", "IMAGE", "1", "one"), ("w", "twice", "IMAGE", "2", "two"), ("w", None, "IMAGE", "3", "three"),
]
ERRORS = {"odd": "UNSUPPORTED_TYPE", "blank": "EMPTY", "none": "NO_TEXT", "long": "EXTRACTION_LIMIT_EXCEEDED", "twice": "REPEATED_ID", None: "MISSING_ID"}


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/store")


def test_every_kind_takes_its_path_and_bad_sources_are_set_apart(spark, tables):
    ingestion.ingest(tables, spark.createDataFrame(ROWS, SOURCES), "g1")
    got = {}
    for r in ingestion.visible_items(tables).orderBy("source_id", "sequence").collect():
        got.setdefault(r.source_id, []).append((r.sequence, r.heading, r.speaker, r.start_ms, r.content, r.source_type))
    assert got == {
        "doc": [(1, "CHAPTER 1", None, None, "One. Two. Three. Four. Five.", "documents"), (2, "CHAPTER 1", None, None, "Six.", "documents")],
        "page": [(1, "# Title", None, None, "Text here.", "documents")],
        "talk": [(1, "Audio transcript", "Ann", 1500, "Hello.", "audio"), (2, "Audio transcript", None, 5000, "Bye.", "audio")],
        "plain": [(1, "Audio transcript", None, None, "all of it", "audio")],
        "cat": [(None, None, None, None, "Visual summary:\nA cat.\n\nSpoken transcript:\n[00:00:00.000 - 00:00:01.500] Bo: Meow.", "videos")],
        "tube": [(None, None, None, None, "Visual summary:\nA dog.", "videos")],
        "pic": [(None, None, None, None, "A house.", "images")],
    }
    assert {r.source_id: r.error_code for r in tables.read("errors").collect()} == ERRORS
    assert tables.read("errors").count() == 7
    assert {r.source_id for r in ingestion.visible_items(tables, "v").collect()} == {"tube"}


def test_a_new_generation_replaces_a_source_and_a_failed_one_keeps_what_it_had(spark, tables):
    first = [("w", "a", "IMAGE", "a", "old a"), ("w", "b", "IMAGE", "b", "old b"), ("w", "c", "ARCHIVE", "c", "x")]
    again = [("w", "a", "IMAGE", "a", "new a"), ("w", "b", "IMAGE", "b", " "), ("w", "c", "IMAGE", "c", "now read")]
    before = ingestion.ingest(tables, spark.createDataFrame(first, SOURCES), "g1")
    ingestion.ingest(tables, spark.createDataFrame(again, SOURCES), "g2")
    assert {(r.id, r.content) for r in ingestion.visible_items(tables).collect()} == {("a:g2:0", "new a"), ("b:g1:0", "old b"), ("c:g2:0", "now read")}
    assert {(r.source_id, r.generation, r.error_code) for r in tables.read("errors").collect()} == {("b", "g2", "EMPTY")}
    assert {r.content for r in tables.read("items", before).collect()} == {"old a", "old b"}


def test_vectors_of_a_source_are_kept_all_or_none(spark, tables):
    embed = lambda text: F.when(text.contains("Bye"), F.array().cast("array<float>")).otherwise(hashed_words(8)(text))
    ingestion.ingest(tables, spark.createDataFrame(ROWS[:3], SOURCES), "g1", embed, 8)
    assert {r.source_id for r in ingestion.visible_items(tables).collect()} == {"doc", "page"}
    assert [(r.source_id, r.error_code) for r in tables.read("errors").collect()] == [("talk", "INVALID_VECTOR")]


def test_a_rival_between_staging_and_publication_is_merged(spark, tables, monkeypatch):
    ingestion.ingest(tables, spark.createDataFrame([("w", "a", "IMAGE", "a", "a")], SOURCES), "g1")
    publish, rivals = VersionedTables.publish, iter([True])

    def late(self, base, staged):
        if next(rivals, False):
            ingestion.ingest(tables, spark.createDataFrame([("w", "b", "IMAGE", "b", "b")], SOURCES), "g2")
        return publish(self, base, staged)

    monkeypatch.setattr(VersionedTables, "publish", late)
    ingestion.ingest(tables, spark.createDataFrame([("w", "c", "IMAGE", "c", "c")], SOURCES), "g3")
    assert {r.content for r in ingestion.visible_items(tables).collect()} == {"a", "b", "c"}
    assert tables.version().number == 3


def test_bodies_stay_where_they_are(spark, monkeypatch):
    """The ids that are there twice go to the sources; a shuffle of the sources would take all bodies along."""
    from lorefold.operators import ingestion

    plans, write = {}, ingestion.written
    monkeypatch.setattr(ingestion, "written", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    rows = [("w", "a", "IMAGE", "n", "one"), ("w", "b", "IMAGE", "n", "two"), ("w", "b", "IMAGE", "n", "three")]
    items, errors = ingestion.items_and_errors(spark.createDataFrame(rows, "workspace_id string, source_id string, kind string, name string, body string"), "g1")
    assert "rightHint=(strategy=broadcast)" in plans["sources"]
    assert [r.source_id for r in items.collect()] == ["a"] and [(r.source_id, r.error_code) for r in errors.collect()] == [("b", "REPEATED_ID")] * 2
