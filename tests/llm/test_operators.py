"""Each operator against its SQL, a brute-force version or held-out accuracy, and against odd rows."""

import math
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorefold.llm import decontamination, embedding_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, queries, sharding, toxicity, warc
from lorefold.llm.common import materialise
from lorefold.llm.components import connected_components

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = "long words that go on " * 20_000
ODD = [
    (1, "The same line that stands in many documents.\nAnd one more.", "en", "a", "x"),
    (1, "The same line that stands in many documents.\nAnd one more.", "en", "a", "x"),
    (2, None, None, None, None),
    (3, "", "fr", "b", "y"),
    (4, " \t\n ", "de", None, "z"),
    (5, LONG, "en", "a", "x"),
    (6, "The same line that stands in many documents.", None, "b", None),
    (7, "the same line that stands in many documents.  ", "en", "a", "x"),
    (None, "The same line that stands in many documents.", "en", "a", "x"),
    (8, "ÄÖ 😀 \x00 123".encode("utf-16", "surrogatepass").decode("utf-16"), "de", "c", "w"),
]
SCHEMA = "doc_id long, text string, lang string, source string, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that clash with those of the operators."""
    extra = {c: F.lit("clash") for c in ("size", "shard", "slot", "score", "predicted", "n_words", "family", "sigs", "matches", "copies", "rate", "n")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


# 1. WARC


def test_revisits_take_the_latest_earlier_response(spark):
    full, again = "response", "revisit"
    rows = [
        (1, full, "http://www.Ex.org/a?utm_source=x&b=1", 10, 200, {"ETag": '"1"', "Content-Length": "5", "X": "old"}),
        (2, full, "https://ex.org/a/?b=1", 20, 200, {"ETag": '"2"', "Content-Length": "7", "X": "old", "Keep": "k"}),
        (3, again, "https://ex.org/a?b=1#f", 30, 304, {"etag": 'W/"2"', "Content-Length": "0", "x": "new"}),
        (4, again, "https://ex.org/a?b=1", 15, 304, {"ETag": '"2"'}),
        (5, again, "https://ex.org/a?b=1", 5, 304, {"ETag": '"1"'}),
        (6, again, "https://ex.org/a?b=1", 40, 304, None),
        (7, again, None, 40, 304, {"ETag": '"1"'}),
        (8, full, "https://ex.org/a?b=1", 25, 500, {"ETag": '"9"'}),
        (9, again, "https://ex.org/a?b=1", 20, 304, {"Last-Modified": "Mon"}),
    ]
    r = spark.createDataFrame(rows, "record_id long, warc_type string, url string, ts long, status int, headers map<string,string>").withColumn("outcome", F.lit("clash"))
    for span in (1, 20_000):
        got = {x.record_id: x for x in warc.resolve_revisits(r, span).collect()}
        assert {k: (v.outcome, v.response_id) for k, v in got.items()} == {3: ("resolved", 2), 4: ("mismatch", None), 5: ("no_response", None), 6: ("no_validator", None), 7: ("no_response", None), 9: ("mismatch", None)}
        assert got[3].merged == {"content-length": "7", "keep": "k", "etag": 'W/"2"', "x": "new"}
    assert warc.resolve_revisits(r.limit(0)).isEmpty()


# 2. Language ID


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = language_id.op2_language_id(spark, MEDIUM).where("held_out").join(docs.where("lang is not null"), "doc_id")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.9


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    layer = language_id.Gated.start(3, rng)
    ids, mask = language_id.pad([b"abc", b"d"])
    want = rng.standard_normal((3, 2, 3))
    _, cache = layer.forward(ids, mask)
    got = layer.backward(ids, cache, want)
    for name in ("u", "b", "table"):
        w, at = getattr(layer, name), (1,) if name == "b" else (0, 4) if name == "u" else (ord("b"), 2)
        keep, two = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = keep + step
            two.append(float((layer.forward(ids, mask)[0] * want).sum()))
        w[at] = keep
        assert math.isclose((two[0] - two[1]) / 2e-2, getattr(got, name)[at], rel_tol=0.05, abs_tol=1e-3)


def test_windows_label_every_byte_like_one_long_run(docs):
    """The windows cover each byte once; their pooled labels are those of positions that a plain run of the network over the same bytes gives, and nearly those of one run over the whole text."""
    net = language_id.fit(docs.where("doc_id % 2 = 0"), 20)
    data = ("".join(r.text for r in docs.limit(4).collect()) + " end").encode()
    parts = language_id.windows_of(data)
    assert b"".join(w[a:z] for w, a, z in parts) == data and sum(z - a for _, a, z in parts) == len(data) > 3 * language_id.CORE
    want = np.array([net.positions(*language_id.pad([w]))[0][a:z, 0].sum(axis=0) for w, a, z in parts])
    assert np.allclose(net.sums(parts), want, rtol=1e-3, atol=1e-3)
    whole = net.positions(*language_id.pad([data]))[0][:, 0].mean(axis=0)
    assert np.allclose(whole, want.sum(axis=0) / len(data), atol=0.02)


def test_language_of_odd_rows(spark, odd, docs):
    net = language_id.fit(docs.where("doc_id % 2 = 0"), 20)
    out = language_id.identify(odd, net, F.lit(None).cast("boolean")).collect()
    assert len(out) == len(ODD) and not any(r.held_out for r in out)
    by = {r.doc_id: r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(odd, None, F.lit(False)).collect()} == {"und"}


def test_languages_beyond_those_learned(spark, docs, monkeypatch):
    taken = []
    monkeypatch.setattr(language_id, "train", lambda samples: taken.append(samples))
    rows = [(i, f"text {i}", f"l{i % 600:03}") for i in range(1300)] + [(7, "same", "l000")] * 40
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    language_id.fit(many, 30)
    language_id.fit(many.repartition(3), 30)
    assert taken[0] == taken[1] and {lang for _, lang in taken[0]} == {f"l{i:03}" for i in range(500)}
    assert sum(lang == "l000" for _, lang in taken[0]) == 30 and sum(lang == "l150" for _, lang in taken[0]) == 2
    language_id.fit(many, 30, languages=1)
    assert {lang for _, lang in taken[2]} == {"l000"}
    language_id.fit(docs, 20)
    want = docs.toPandas().assign(h=[r[0] for r in docs.select(language_id.seeded_bits(language_id.SEED, F.col("doc_id"))).collect()]).dropna(subset=["lang", "text"])
    want = want[want.text.str.encode("utf-8").str.len().between(1, language_id.SAMPLE_BYTES)].sort_values(["lang", "h", "text"]).groupby("lang").head(20)
    assert taken[3] == [(t.encode(), lang) for t, lang in zip(want.text, want.lang, strict=True)]


# 3. Sharding


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in by[s]) == list(range(len(by[s]))) for s in by)
    return by


def test_shards_have_the_mixture(spark, docs):
    rows = sharding.interleave(docs.select("doc_id", "source", "text")).collect()
    by = check_shards(rows, 8)
    whole = Counter(r.source for r in rows)
    for s in range(8):
        mine = Counter(r.source for r in by[s])
        assert all(abs(mine[k] - n / 8) <= 2 for k, n in whole.items())
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(5).select("doc_id", "source", "text")).collect())


def test_shards_equal_brute_force(spark, docs):
    """Sort each source by its hash, then all rows by fractional rank and source, and cut in runs."""
    from lorefold.llm.common import seeded_bits

    one = docs.select("doc_id", "source", "text")
    hashed = one.select("doc_id", "source", seeded_bits(sharding.SEED, F.col("doc_id"), F.xxhash64("text")).alias("h"), F.xxhash64("text").alias("t")).collect()
    by = defaultdict(list)
    for r in sorted(hashed, key=lambda r: (r.h, r.t, r.doc_id)):
        by[r.source].append(r.doc_id)
    order = sorted(((2 * k + 1) / (2 * len(ids)), s, i) for s, ids in by.items() for k, i in enumerate(ids))
    n = len(order)
    want = {}
    for at, (_, _, i) in enumerate(order):
        s = at * 8 // n
        want[i] = (s, at - -(-s * n // 8))
    old = sharding.ROWS
    try:
        for sharding.ROWS in (old, 7):  # one bucket a source, and many
            assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(one).collect()} == want
    finally:
        sharding.ROWS = old


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.interleave(odd).collect()
    check_shards(rows, 8)
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == set(odd.columns)
    assert sharding.interleave(odd.limit(0)).isEmpty()


# 4. Embedding near-dedup


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base + rng.standard_normal((60, 32)) * s for s in (0, 0.1, 0.2, 0.3, 0.4)])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(300, x[0].tolist(), 0), (301, [0.0] * 32, 0), (302, None, 0), (303, [float("nan")] * 32, 0), (304, x[0].tolist(), None), (305, [None] * 32, 1), (306, [], 1), (307, x[0].tolist()[:8], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    f4 = {i: np.asarray(v, dtype="f4").astype(float) for i, v, label in rows if label is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)}
    of = {i: label for i, _, label in rows}
    links = defaultdict(set)
    for i in f4:
        for j in f4:
            if i != j and of[i] == of[j] and f4[i] @ f4[j] / np.linalg.norm(f4[i]) / np.linalg.norm(f4[j]) >= 0.93:
                links[i].add(j)

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    for block in (1024, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(e).collect()}
        assert got == {i: (len(links[i]), low(i), low(i) == i) for i, *_ in rows}
    named = e.withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(named).collect()} == {f"v{i:03d}": (n, f"v{c:03d}", k) for i, (n, c, k) in got.items()}
    assert embedding_dedup.near_duplicates(e.limit(0)).isEmpty()


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1e300, 1e300], 0), (4, [1e-300, 1e-300], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(e).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (None, None, False)]


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_estimates_are_unbiased_and_bounds_are_sure(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((400, dim))
    x[200:] = x[:200] + rng.standard_normal((200, dim)) * rng.uniform(0.05, 0.5, (200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = [embedding_dedup.Codes.of(x, r) for r in range(embedding_dedup.ROTATIONS)]
    again = embedding_dedup.Codes.unpacked(codes[0].packed(), dim)
    about, error = embedding_dedup.estimates(again, codes[0])
    off = (about - x @ x.T)[~np.eye(400, dtype=bool)]
    if dim > 3:
        assert abs(off.mean()) < 0.01 and (np.abs(off) <= 5 * error.max() + 0.1).mean() > 0.999
    close = set(zip(*np.nonzero(x @ x.T >= 0.93), strict=True))
    found = set(zip(*embedding_dedup.open_pairs(codes, codes, 0.93), strict=True))
    assert close <= found
    if dim >= 64:  # what is far below the threshold isn't computed
        assert min((x[i] @ x[j] for i, j in found), default=1) > 0.6


def test_embeddings_lose_no_link_in_large_labels(spark):
    """A label of several blocks, beside a small one, whose near pairs lie just above the threshold."""
    rng = np.random.default_rng(7)

    def near(n):
        u = rng.standard_normal((n, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = rng.standard_normal((n, 64))
        v -= (v * u).sum(1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return np.concatenate([u, 0.931 * u + math.sqrt(1 - 0.931**2) * v])

    x = np.concatenate([near(2500), near(10)])
    labels = [0] * 5000 + [1] * 20
    e = spark.createDataFrame([(i, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(e).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [int((unit[a:z] @ unit[i] >= 0.93).sum()) - 1 for a, z in ((0, 5000), (5000, 5020)) for i in range(a, z)]
    assert min(want) >= 1 and got == dict(enumerate(want))


# 5. N-gram Jaccard join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80), (1, 80)])
def test_join_equals_brute_force(spark, k, num):
    rng = np.random.default_rng(k)
    common = [f"c{i}" for i in rng.integers(0, 900, 60)]
    rows = []
    for n in rng.integers(1, 250, 50):
        words = [f"w{i}" for i in rng.integers(0, 4000, n)]
        if rng.random() < 0.5:
            words = words[: n // 2] + common + words[n // 2 :]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.integers(0, 1 + n // 25)):
                words = [*words[: (p := int(rng.integers(0, len(words))))], f"x{rng.integers(0, 999)}", *words[p + int(rng.integers(0, 2)) :]]
    want = brute_components(rows, k, num, 100)
    old = ngram_join.BLOCK_ENTRIES, ngram_join.BLOCK_ROWS
    try:
        for ngram_join.BLOCK_ENTRIES, ngram_join.BLOCK_ROWS in (old, (300, 2)):  # one block a family, and many
            got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()
            assert {r.doc_id: r.component_id for r in got} == want
            assert all(r.n_shingles == len(shingles(rows[r.doc_id][1], k)) for r in got)
    finally:
        ngram_join.BLOCK_ENTRIES, ngram_join.BLOCK_ROWS = old


@pytest.mark.parametrize("num, den", [(80, 100), (85, 100), (1, 2)])
def test_sets_that_link_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    for _ in range(2000):
        n = int(np.exp(rng.uniform(0, 6.5)))
        m = max(1, int(n * rng.uniform(1, den / num)))
        a = draw(n)
        b = np.unique(np.concatenate([rng.permutation(a)[: math.ceil(num * (n + m) / (num + den))], draw(max(0, m - math.ceil(num * (n + m) / (num + den))))]))
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(ngram_join.block_signatures(a, num, den), ngram_join.block_signatures(b, num, den)))
    with pytest.raises(ValueError):
        ngram_join.block_signatures(draw(50), 1, 5)


def test_join_of_odd_rows(spark, odd):
    got = ngram_join.jaccard_components(odd, 4, 85, 100).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[None].component_id is None
    assert {k: by[k].component_id for k in range(1, 9)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    assert [by[k].n_shingles for k in (2, 3, 4)] == [0, 0, 0]
    kept = ngram_join.keep_first(odd, ngram_join.jaccard_components(odd, 4, 85, 100))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 8, None]
    assert ngram_join.jaccard_components(odd.limit(0)).isEmpty()
    named = ngram_join.jaccard_components(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in named} == {None if k is None else f"d{k}": None if k is None else f"d{r.component_id}" for k, r in by.items()}
    twice = spark.createDataFrame([(1, "b b b b b b"), (1, "a a a a a a")], "doc_id long, text string")
    assert [r.text for r in ngram_join.keep_first(twice, ngram_join.jaccard_components(twice)).collect()] == ["a a a a a a"]


def test_join_of_a_null_id_before_its_copy(spark):
    """A row with a null doc_id doesn't keep its copy, later in the same task, from linking with a near copy."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(rows).collect()} == {None: None, 1: 1, 2: 1}


def test_components_of_a_long_path_in_many_tasks(spark):
    from lorefold.llm import components

    old, components.CONTRACT = components.CONTRACT, 40
    try:
        e = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901), (5, 5), (None, 3)], "a long, b long"))
        got = {r.node: r.component for r in connected_components(e).collect()}
    finally:
        components.CONTRACT = old
    assert got == {**{k: 0 for k in range(301)}, 900: 900, 901: 900}
    assert connected_components(e.limit(0)).isEmpty()


# 6. Mixing


def test_mix_meets_its_targets(spark):
    rows = [r for r in mixing.op6_mixing(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "source"), "doc_id").collect()]
    taken, goal = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    assert math.isclose(sum(goal.values()), sum(r.size for r in rows), rel_tol=1e-9)
    largest = {s: max(r.size for r in rows if r.source == s) for s in goal}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert abs(sum(taken.values()) / sum(goal.values()) - 1) < 0.01


def test_mix_numbers_crowded_strata_alike(spark, docs, monkeypatch):
    """Strata cut by hash, joined without broadcasts, give the draws of whole ones; a source of short texts comes near its target too."""
    few = docs.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.lit("one two")).otherwise(F.col("text")).alias("text"), F.lit("clash").alias("_bucket"))
    want = {r.doc_id: r.copies for r in mixing.mix(few.drop("_bucket")).collect()}
    monkeypatch.setattr(mixing, "ROWS", 3)
    monkeypatch.setattr("lorefold.llm.common.BROADCAST_BYTES", 0)
    assert {r.doc_id: r.copies for r in mixing.mix(few.drop("_bucket")).collect()} == want


def test_targets_refill_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 3 and got["b"] == 30 and got["c"] <= 300
    assert math.isclose(sum(got.values()), 1111) and got[None] <= 3000


def test_mix_of_odd_rows(spark, odd):
    out = mixing.mix(odd)
    assert sorted((r.doc_id, r.size) for r in out.where("doc_id is not null").collect()) == [(1, 11), (1, 11), (2, 0), (3, 0), (4, 0), (5, 100_000), (6, 8), (7, 8), (8, 4)]
    assert mixing.emit(out).count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd.limit(0)).isEmpty()


# 7. License scans


def test_rules_match_ordered_sentences(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    rows = [(1, "\n".join(bsd)), (2, "\n".join([bsd[0], bsd[2], bsd[1]])), (3, "x\n".join(bsd)), (4, "Released under the MIT License. All rights reserved."), (5, "\n".join([bsd[0], "Note one.", "Note two.", bsd[1], bsd[2]])), (6, None), (7, "")]
    got = {r.doc_id: sorted({m.licence for m in r.matches}) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["BSD-2-Clause"], 2: [], 3: [], 4: ["MIT", "proprietary"], 5: [], 6: [], 7: []}


#: Public licence texts, wrapped as they are found.
WRAPPED = {
    "MIT": """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is
// furnished to do so, subject to the following conditions:
//
// The above copyright notice and this permission notice shall be included in all
// copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
// IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
// FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
// AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
// LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
// OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
// SOFTWARE.""",
    "BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
}


def test_wrapped_licences_match(spark):
    rows = spark.createDataFrame(list(WRAPPED.items()), "doc_id string, text string")
    got = {r.doc_id: {(m.licence, m.parts) for m in r.matches} for r in license_scan.scan(rows).collect()}
    assert got == {"MIT": {("MIT", 4)}, "BSD-3-Clause": {("BSD-3-Clause", 4)}, "Apache-2.0": {("Apache-2.0", 4)}}


def test_license_scan_of_odd_rows(spark, odd):
    out = license_scan.scan(odd)
    assert out.count() == len(ODD) and "label" in out.columns
    assert license_scan.scan(odd.limit(0)).isEmpty()


# 8. Line dedup


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd, keep=["doc_id", "label"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].kept_text == "And one more." and by[6].kept_text == "" and by[7].n_dropped == 0
    assert by[2].kept_text is None and (by[2].n_lines, by[3].n_lines, by[4].n_lines) == (1, 1, 2)
    assert by[None].n_dropped == 0 and by[5].kept_text == LONG
    assert line_dedup.dedup_lines(odd.limit(0)).isEmpty()
    named = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()}
    assert named == {None if k is None else f"d{k}": (r.n_dropped, r.kept_text) for k, r in by.items()}


def test_hot_lines_drop_like_others(spark, docs, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect())
    want = rows()
    monkeypatch.setattr("lorefold.llm.common.HOT_ROWS", 2)
    assert rows() == want and sum(r[1] for r in want) > 0


# 9. Decontamination


def test_contamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "same LINE that"), (2, None), (3, ""), (4, "long words that go on long words that go on long words that go on"), (None, "documents")], "item_id long, text string").withColumn("w", F.lit("clash"))
    got = decontamination.contamination(odd, items).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD)
    assert (by[1].n_words, by[1].n_hit, by[1].n_items, by[1].contaminated) == (11, 4, 1, True)
    assert by[5].n_hit == by[5].n_words == 100_000 and by[2].n_words == 0 and not by[2].contaminated
    assert by[None].contaminated and by[8].n_hit == 0
    assert decontamination.contamination(odd.limit(0), items).isEmpty()
    clean = decontamination.contamination(odd, items.limit(0)).collect()
    assert len(clean) == len(ODD) and not any(r.contaminated for r in clean)
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8]


def test_contamination_by_shuffles_equals_broadcasts(docs, benchmark, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in decontamination.contamination(docs, benchmark).collect())
    want = rows()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("lorefold.llm.common.HOT_ROWS", 1)
    assert rows() == want
    monkeypatch.setattr("lorefold.llm.common.BROADCAST_BYTES", 0)
    assert rows() == want and any(r[5] for r in want)


# 10. Toxicity


#: Expressions of the synthetic tables' toxic documents. A part of the toxic labels there is noise, on documents without any.
EXPRESSIONS = r"(?i)\b(trash|scum|clown|idiot|worthless|disgusting|loser|pathetic|moron|stupid)\b"


def test_toxicity_of_held_out_documents(spark):
    marked = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", F.col("text").rlike(EXPRESSIONS).alias("toxic"))
    rows = toxicity.op10_toxicity(spark, MEDIUM).where("held_out").join(marked, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert toxic and sum(a.score > b.score for a in toxic for b in clean) >= 0.95 * len(toxic) * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_toxicity_of_odd_rows(spark, odd, docs):
    net = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    out = toxicity.score(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3, 4)}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(toxicity.labelled(odd, none)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), net).isEmpty()


def test_toxicity_counts_and_backs_off_like_brute_force(spark):
    """Counts are those of a plain count, and ratios those of a plain recursive Kneser-Ney model."""
    rows = [(i, t, i % 2) for i, t in enumerate(["you are kind and  kind", "You are TRASH and trash", "kind words\nare kind", "trash talk", "a kind  of rain"])]
    net = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    lead = "\x01" * (toxicity.ORDER - 1)
    ends = [(k, (lead + " ".join(t.lower().split()) + " ")[i : i + toxicity.ORDER]) for _, t, k in rows for i in range(len(" ".join(t.split())) + 1)]
    count = [Counter(g for k, g in ends if k == c) for c in (0, 1)]
    pack = lambda g: int.from_bytes(g.encode(), "big")
    assert {r.gram: (r.c0, r.c1) for r in net.grams.collect()} == {pack(g): (count[0][g], count[1][g]) for _, g in ends}
    kinds = {toxicity.ORDER - 1: Counter(g[1:] for g in {g for _, g in ends})}
    for j in range(toxicity.ORDER - 2, 0, -1):
        kinds[j] = Counter(g[1:] for g in kinds[j + 1])

    def shared(g):
        if not g:
            return 1 / 256
        after = {x: n for x, n in kinds[len(g)].items() if x[:-1] == g[:-1]}
        if not after:
            return shared(g[1:])
        return (max(after.get(g, 0) - 0.75, 0) + 0.75 * len(after) * shared(g[1:])) / sum(after.values())

    def p(g, c):
        after = {x: n for x, n in count[c].items() if x[:-1] == g[:-1]}
        return (max(after.get(g, 0) - 0.75, 0) + 0.75 * len(after) * shared(g[1:])) / sum(after.values()) if after else shared(g[1:])

    test = sorted({g for _, g in ends} | {"zzzzz", "xkind", "kindz", " trax"})
    want = [math.log(p(g, 1) / p(g, 0)) for g in test]
    assert net.held.ratios(np.array([pack(g) for g in test], dtype=np.uint64)) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_toxicity_joins_like_a_held_model(spark, docs, monkeypatch):
    """More distinct n-grams than a task may hold are joined, and score like those that are held; words longer than a unit too."""
    more = docs.unionByName(spark.createDataFrame([(10_000, "long " + "word" * 60, "en", "a", 1), (10_001, None, None, None, None)], docs.schema))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = lambda: {r.doc_id: r.score for r in toxicity.score(more, toxicity.fit(toxicity.labelled(docs, labels))).collect()}
    held = scores()
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 0)
    assert scores() == pytest.approx(held, abs=1e-4)


def test_toxicity_tasks_hold_a_bounded_part_of_their_n_grams(monkeypatch):
    """N-grams of a batch, or of one long text, are made in parts; counts and features are those of all at once, also across the parts."""
    draw = np.random.default_rng(7)
    words = np.column_stack([draw.integers(97, 123, (300, 5), dtype=np.uint8), np.full(300, 32, np.uint8)])[draw.integers(0, 300, 1_000_000)]
    texts = [words[at : at + 1000].tobytes().decode() for at in range(0, 200_000, 1000)] + [words[200_000:].tobytes().decode(), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts)) % 2, pa.int32()), pa.array(np.arange(len(texts)) // 2 % 2, pa.int32()), pa.array(texts)], names=["part", "toxic", "text"])

    def counted():
        rows = [tuple(r.values()) for b in toxicity._count(iter([batch])) for r in b.to_pylist()]
        out = Counter()
        for gram, *n in rows:
            out.update({(gram, k): v for k, v in enumerate(n) if v})
        return out

    counts = counted()
    gram = np.array(sorted({g for g, _ in counts}), dtype=np.int64)
    c0, c1 = (np.array([counts[g, k] + counts[g, k + 2] for g in gram.tolist()]) for k in (0, 1))
    held = toxicity.Held.of(gram.view(np.uint64), c0, c1, gram.view(np.uint64), np.array([-4.0, 1.0, 1.0, -0.5]))
    tracemalloc.start()
    features = held.features(texts[-3:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(texts[-3])  # the n-grams alone would take 8 bytes each, and sorting them four times that
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1 << 24)
    assert features == pytest.approx(held.features(texts[-3:]), rel=1e-9)
    monkeypatch.setattr(toxicity, "WAITING", 1 << 24)
    assert counted() == counts


def test_embeddings_of_a_null_id_link_with_nothing(spark):
    rows = [(None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.99, 0.05], 0), (None, [0.0, 1.0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (None, 0, None, False)]


def test_join_in_slices_of_signatures(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(ngram_join, "SLICE_SIGNATURES", 500)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == want
    assert any(c != i for i, _, c in want)


def test_common_passages_make_no_large_family(spark, monkeypatch):
    """Documents that only quote the same passages are told apart before blocks of them are multiplied; near copies among them, and a large group of them, still link."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} {' '.join(f'w{x}' for x in rng.integers(0, 10**6, 80))}") for i in range(60)]
    rows += [(i + 60, f"{rows[i][1]} end") for i in range(5)] + [(65 + i, f"{rows[7][1]} {i}") for i in range(12)]
    written = defaultdict(list)
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: written[name].append(got := materialise(df, name)) or got)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "SLICE_ENTRIES", 1000, raising=False)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 5, 80, 100)
    assert 0 < sum(t.count() for t in written["large"]) <= 13


def test_copies_in_many_tasks_share_signatures_with_nothing(spark, monkeypatch):
    """Of a set's copies one document makes signatures, whether most documents are copies or few, and repeated ids link as one document."""
    written = defaultdict(list)
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: written[name].append(got := materialise(df, name)) or got)
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 10**6, 40)) for i in range(10)]
    for copies in (1, 6):
        written.clear()
        rows = [(100 * c + i, t) for c in range(copies) for i, t in enumerate(texts)] + [(903, texts[3]), (903, texts[4]), (904, "unlike"), (904, texts[4])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
        assert got == {i: 3 if i in (903, 904) or i % 100 == 4 else i % 100 for i, _ in rows}
        assert sum(t.count() for t in written["signatures"]) == 0


def test_no_shuffle_stays_after_a_written_table(spark):
    """What a written table was shuffled by goes with the write, and the session's setting is as before."""
    files = lambda: {p.name for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = files()
    got = materialise(spark.range(10_000).repartition(7, "id").groupBy("id").count(), "test")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and got.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_first_of_near_copies_leaves_texts_where_they_are(spark):
    """Few ids go, or few stay: both are sent to the tasks, so the texts meet no shuffle."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for gone in (3, 90):
            docs = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
            links = docs.selectExpr("doc_id", "0L as n_shingles", f"if(doc_id <= {gone}, 0L, doc_id) as component_id")
            kept = ngram_join.keep_first(docs, links)
            assert sorted(r.doc_id for r in kept.collect()) == [0, *range(gone + 1, 100)]
            assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
