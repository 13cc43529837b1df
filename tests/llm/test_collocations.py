"""Collocations against plain counting of all phrases, and the passes of the miner."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefold.llm import collocations as co


def phrases(rows):
    """Counts of all phrases of 1 to 4 words by language, for (lang, text) rows."""
    out = {}
    for lang, text in rows:
        own = out.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return out


def plain(rows, least, top=2000):
    out = []
    for lang, f in phrases(rows).items():
        n = sum(k for p, k in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:top], 1)]
    return sorted(out)


def invented(seed, docs=200, vocabulary=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(r.choice(["en", "de", None]), " ".join(r.choices(words, weights, k=r.choice([0, 3, 40]))) + r.choice(["", ". W1 w2, w3", "! rare mark of all rare mark"])) for _ in range(docs)]


def got(spark, rows, **more):
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string").repartition(4)
    return sorted(tuple(x) for x in co.collocations(docs, **more).collect())


def test_equal_to_sql(same_as_sql):
    same_as_sql(co.op13_collocations, co.SQL["op13_collocations"])


@pytest.mark.parametrize(("sample", "least"), [(8, 5), (64, 12)])
def test_any_sample_gives_the_exact_counts(spark, sample, least):
    rows = invented(sample + least)
    assert got(spark, rows, least=least, sample=sample) == plain(rows, least)


def test_a_failed_border_is_closed(spark):
    """Nothing is proposed, so every frequent word is a failure of the border, and phrases of all lengths come from the expansion pass."""
    rows = [("en", "one two three four five")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = {(x.lang, x.phrase): x.f for x in co.frequent_phrases(docs, 9, sample=10**9).collect()}
    words = "one two three four five".split()
    assert found == {("en", " ".join(words[i : i + m])): 9 for m in range(1, 5) for i in range(6 - m)} | {("en", ""): 45}


def test_hot_parts_and_spans(spark, monkeypatch):
    monkeypatch.setattr("lorefold.llm.common.HOT_ROWS", 3)
    rows = [("en", f"the x{i} end {j % 3}") for i in range(12) for j in range(6)]
    assert got(spark, rows, least=4, top=5) == plain(rows, 4, 5)


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), ("und", "a b " * 40), (None, "A B " * 20), ("", "a\tb\x0ba b"), ("é", "ß ß . , ;" * 40), ("zh", "日本 語" * 30), ("en", "x" * 50_000 + " y" * 3000), ("en", "\x00 \x00 " * 40)]
    assert got(spark, rows, least=5) == plain(rows, 5)
    docs = spark.createDataFrame([(*x, 1, "own") for x in rows * 2], "lang string, text string, a int, f string").withColumns({"len": F.lit(2), "phrase": F.lit("z"), "n": F.lit(1), "words": F.lit(2)})
    assert sorted(tuple(x) for x in co.collocations(docs, least=5).collect()) == plain(rows * 2, 5)
    assert co.collocations(docs.where("false")).collect() == []


def test_two_phrases_of_one_hash_are_counted_apart():
    ids, names = co.words_of(["a b a c a b"], ["en"])
    places = co.Places(ids, co.word_hashes(names))
    places.keys[2] = np.zeros_like(places.keys[2])
    rows, f = places.count(2, places.inside[2])
    assert {tuple(names[i][1] for i in r): k for r, k in zip(rows.tolist(), f.tolist(), strict=True)} == {(b"a", b"b"): 2, (b"b", b"a"): 1, (b"a", b"c"): 1, (b"c", b"a"): 1}


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = [("en", n, p, f) for n, p, f in ((0, "", 10**18), (1, "a", 3 * 10**17), (1, "b", 2 * 10**17), (2, "a b", 10**17))]
    monkeypatch.setattr(co, "frequent_phrases", lambda *_: spark.createDataFrame(counts, "lang string, len int, phrase string, f long"))
    row = co.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert row.score == 2_000_000 * 10**17 // (5 * 10**17)
