"""The Merkle manifest against a plain tree in memory and its SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lorefold.llm import merkle
from tests.conftest import SMALL


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and for each node how many siblings stand before it and all of them, level by level."""
    steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in under[a + j]:
                    steps[i].append((j, run[:j] + run[j + 1 :]))
            up.append(digest(*run))
            below.append(sum(under[a : a + 3], []))
        nodes, under = up, below
    return nodes[0], steps


def fold(x, steps):
    for j, siblings in steps:
        x = digest(*siblings[:j], x, *siblings[j:])
    return x


def plain(rows):
    by = {}
    for d, source, lang, n, text in rows:
        seen = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        by.setdefault(source, []).append((d, digest(*map(field, (d, source, lang, n, text))), digest(*map(field, (d, source, lang, n, seen)))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in names}
    low = {s: tree([x[1] for x in of[s]]) for s in names}
    root, high = tree([low[s][0] for s in names])
    out = []
    for s, more in zip(names, high, strict=True):
        for (d, leaf, seen), steps in zip(of[s], low[s][1], strict=True):
            folded = fold(seen, steps + more)
            out.append((d, leaf, low[s][0], root, digest(*(x for _, siblings in steps + more for x in siblings)), folded, folded == root))
    return sorted(out, key=repr)


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, "").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_equal_to_sql(same_as_sql):
    same_as_sql(merkle.op12_merkle_manifest, merkle.SQL["op12_merkle_manifest"])


def test_query_equals_a_plain_tree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert query(spark, docs, monkeypatch) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_sources_of_many_sizes_over_several_levels_of_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rows = [(i * 7 % 1000, s, None, i, f"text\n{i}") for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 82, 250)) for i in range(n)]
    rows = [(d, f"s{s}", *x) for d, s, *x in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert query(spark, docs, monkeypatch) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, None, "", 0, ""), (1, None, "", 1, "a\n\n"), (2, "", None, None, "\n"), (3, "é", "en", -5, "x" * 100_000 + "\n"), (None, "z", "y", 1, "t"), (5, "z", None, 2, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "digest": F.lit("own"), "steps": F.lit(2), "n": F.lit(3), "_group": F.lit("g")})
    assert query(spark, docs, monkeypatch) == plain(rows)
    assert query(spark, docs.where("false"), monkeypatch) == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    got = query(spark, one, monkeypatch)
    assert got == plain(rows[:1])
    assert got[0][4] == hashlib.sha256(b"").hexdigest()


def test_steps_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "en", i, f"t{i}") for i in range(100)], SCHEMA)
    out = merkle.manifest(docs)
    assert out.columns == ["doc_id", "source", "leaf", "seen", "subroot", "root", "steps"]
    assert out.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert out.where(merkle.fold(F.sha2("leaf", 256), F.col("steps")) == F.col("root")).count() == 0
