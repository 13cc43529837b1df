"""The postings index gives the lists of ranking.bm25, whatever it leaves unread."""

import pytest
from pyspark.sql import functions as F

from lorefold.operators import postings as P
from lorefold.operators import ranking as R
from lorefold.sources.shared import new_path

SMALL = "/root/testdata/sf0.001"


def items(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("heading"))


def questions(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def lists(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 5)) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and parts that the small table has many of."""
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "PART_ROWS", 30)
    monkeypatch.setattr(P, "BUCKETS", 2)


def test_equals_bm25_and_skips_blocks(spark, small_blocks):
    x, q = items(spark), questions(spark)
    index = P.PostingsIndex(spark, new_path(spark, "postings")).add(x, ("content", "heading"))
    plain = x.withColumn("speaker", F.lit(None).cast("string"))
    assert lists(index.search(q, 5, {"content": 1.0, "heading": 2.0})) == lists(R.bm25(plain, q, 5, 2.0))
    assert index._read("rows").where("part > 0").count() > 0
    words = x.select(F.explode(F.array_distinct(R.tokens(F.col("content")))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    rare = words.where("n <= 3").orderBy("text").limit(5).crossJoin(words.orderBy(F.desc("n"), "text").limit(1).select(F.col("text").alias("common")))
    pairs = rare.select(F.col("text").alias("qid"), F.concat_ws(" ", "text", "common").alias("text"))
    read = index.blocks(pairs, 1).agg(F.count("*").alias("all"), F.count_if("read").alias("read")).first()
    assert 0 < read.read < 0.5 * read.all
    assert lists(index.search(pairs, 1)) == lists(R.bm25(plain, pairs, 1))


def test_generations_share_statistics(spark, small_blocks):
    x, q = items(spark), questions(spark)
    index = P.PostingsIndex(spark, new_path(spark, "postings")).add(x.where("id % 2 = 0"), generation="a").add(x.where("id % 2 = 1"), generation="b")
    plain = x.withColumn("speaker", F.lit(None).cast("string"))
    assert lists(index.search(q)) == lists(R.bm25(plain, q))
    assert lists(index.search(q, generations=["b"])) == lists(R.bm25(plain.where("id % 2 = 1"), q))
    assert index.search(q, generations=["c"]).isEmpty()
    with pytest.raises(ValueError, match="there already"):
        index.add(x, generation="b")


def test_odd_rows(spark, small_blocks):
    rows = [("a", "red red blue"), ("b", "blue " * 3), ("c", None), ("d", "  "), ("e", "red blue")]
    x = spark.createDataFrame(rows, "id string, content string").withColumn("speaker", F.lit(None).cast("string"))
    q = spark.createDataFrame([(1, "Red"), (2, "blue, RED"), (3, None), (4, "green")], "qid int, text string")
    index = P.PostingsIndex(spark, new_path(spark, "postings")).add(x)
    assert lists(index.search(q, 2)) == lists(R.bm25(x, q, 2))
    empty = P.PostingsIndex(spark, new_path(spark, "postings")).add(x.limit(0))
    assert empty.search(q).isEmpty()
    with pytest.raises(ValueError, match="repeated"):
        P.PostingsIndex(spark, new_path(spark, "postings")).add(x.unionByName(x))


def test_peaks_are_the_unbeaten_postings(spark):
    e = spark.createDataFrame([([(9, 3, 10), (8, 2, 5), (7, 1, 7), (6, 5, 30), (5, 5, 40)],)], "e array<struct<id:int,tf:int,dl:int>>")
    assert [tuple(p) for p in e.select(P.peaks(F.col("e"))).first()[0]] == [(5, 2), (10, 3), (30, 5)]


def test_terms_are_counted_in_their_row(spark):
    x = spark.createDataFrame([("a", "red red Blue"), ("b", ""), ("c", None), ("d", "blue")], "id string, content string")
    got = P.documents(x, "content")
    assert sorted((r.id, r.dl, sorted(zip(r.terms, r.tfs, strict=True))) for r in got.collect()) == [("a", 3, [("blue", 1), ("red", 2)]), ("d", 1, [("blue", 1)])]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_pairs_of_questions_and_postings_are_never_rows(spark, monkeypatch):
    """Each task hands on a question's best documents only, also where questions come in several blocks."""
    monkeypatch.setattr(P, "MATRIX_TERMS", 3)
    x, kept = items(spark), []
    write = P.written
    monkeypatch.setattr(P, "written", lambda df, name: kept.append((name, out := write(df, name))) or out)
    q = spark.createDataFrame([(str(k), w) for k, w in enumerate(("the", "der", "le la", "el la de", "a e i o u"))], "qid string, text string")
    index = P.PostingsIndex(spark, new_path(spark, "postings")).add(x)
    assert lists(index.search(q, 3)) == lists(R.bm25(x.withColumn("speaker", F.lit(None).cast("string")), q, 3))
    near = [df for name, df in kept if name == "near"]
    assert len(near) > 1 and sum(df.count() for df in near) <= 60


def test_blocks_have_the_unbeaten_postings(spark, small_blocks):
    index = P.PostingsIndex(spark, new_path(spark, "postings")).add(items(spark))
    entries = F.transform(F.arrays_zip("ids", "tfs", "dls"), lambda e: F.struct(e["ids"].alias("id"), e["tfs"].alias("tf"), e["dls"].alias("dl")))
    rows = index._read("rows")
    assert rows.where(F.col("peaks") != P.peaks(entries)).isEmpty() and rows.where("n <> size(ids) or n > 4").isEmpty()
    assert rows.agg(F.sum("n")).first()[0] == index._read("terms").agg(F.sum(F.size("terms"))).first()[0]
