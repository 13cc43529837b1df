"""BPE with reuse of chunks against the tokenizers library, text by text."""

import hashlib
import random
import struct
from itertools import pairwise

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorefold.llm import bpe
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["the", " ", "  ", "\n", "\n\n", "\t", "\x00", "é", "<|endoftext|>", "<|endof", "text|>", "'re", "'", "s ", "12", " ", " ", "日本", "😀", ".", "hello world ", "I'll go. ", "Straße", "   x"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_joins_agree_with_the_whole(plain):
    r = random.Random(1)
    for _ in range(600):
        texts = ["".join(r.choices(ODD, k=r.choice([0, 1, 5, 60, 300]))) for _ in range(3)]
        c = bpe.cut(texts, mask=r.choice([2, 3, 5]), least=r.choice([1, 4, 16]), most=r.choice([20, 64]))
        keys = [c.keys(i) for i in range(3)]
        known = [{} for _ in texts]
        for i in range(3):
            assert c.data[c.chunks[i][0] : c.chunks[i][-1]].decode() == texts[i]
            for k, (a, b) in zip(keys[i], pairwise(c.chunks[i]), strict=True):
                if r.random() < 0.6:
                    known[i][k] = bpe.codec(PATH).encode([c.data[a:b].decode()])[0]
        got = bpe.joined(c, bpe.codec(PATH), known, keys)
        assert [g.tolist() for g in got] == [of(plain, t) for t in texts]


def test_plain_characters_are_cut_as_the_library_does(plain):
    """Every character that the pattern is trusted with, beside letters, digits, blanks and marks."""
    codec = bpe.codec(PATH)
    mine = [chr(i) for i in range(0x2100) if bpe.PLAIN.fullmatch(chr(i))]
    assert len(mine) > 500
    texts = [f"a{c}b {c} 1{c}2 {c}{c} .{c}. '{c} {c}s\n{c}\n  {c}  x  {c}" for c in mine]
    assert all(bpe.PLAIN.fullmatch(t) for t in texts)
    assert [x.tolist() for x in codec.encode(texts)] == [of(plain, t) for t in texts]
    assert [x.tolist() for x in codec.encode(["a" * 200 + " <|endoftext|> b", "日本 <|endoftext|>"])] == [of(plain, "a" * 200 + " <|endoftext|> b"), of(plain, "日本 <|endoftext|>")]


def test_cuts_follow_the_content():
    r = random.Random(2)
    shared = "".join(r.choice("abcdefgh ij\n") for _ in range(20_000))
    sets = []
    for head in ("", "Another beginning of some length. " * 9):
        c = bpe.cut([head + shared])
        sets.append(set(c.keys(0)))
    assert len(sets[0] & sets[1]) > 0.8 * len(sets[0])


def test_odd_rows(spark, plain):
    r = random.Random(3)
    passage = "".join(r.choices(ODD, k=400))
    texts = [None, "", passage, passage, "x" + passage, passage * 3, "a" * 30_000, "日本" * 5000, "".join(r.choices(ODD, k=30_000)), " ", "<|endoftext|>" * 50]
    rows = [(i if i % 4 else None, t, i, "own") for i, t in enumerate(texts)] + [(1, passage, 11, "own"), (1, passage, 12, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, ids string").repartition(4)
    out = bpe.encode(docs, PATH, mask=4, least=16, most=256)
    assert out.columns == ["doc_id", "text", "a", "ids"]
    got = {x.a: (x.doc_id, x.text, x.ids) for x in out.collect()}
    assert got == {a: (d, t, of(plain, t)) for d, t, a, _ in rows}
    back = {x.a: x for x in bpe.decode(out, PATH).collect()}
    assert {a: x.decoded for a, x in back.items()} == {a: t or "" for _, t, a, _ in rows}
    empty = bpe.decode(bpe.encode(docs.where("false"), PATH), PATH)
    assert empty.collect() == []


def test_a_hot_chunk_is_broadcast_and_others_join(spark, plain, monkeypatch):
    monkeypatch.setattr("lorefold.llm.common.HOT_ROWS", 20)
    r = random.Random(4)
    hot, warm = ("".join(r.choices(ODD, k=300)) for _ in range(2))
    texts = [f"{i} {hot} {warm if i < 5 else i} {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(bpe.encode(docs, PATH, mask=4, least=16, most=256).select("doc_id", "ids").collect())
    assert got == {i: of(plain, t) for i, t in enumerate(texts)}


def test_files_that_joins_are_not_right_for():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.codec(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, plain):
    got = sorted(tuple(x) for x in bpe.op11_bpe_codec(spark, SMALL).collect())
    want = []
    for d, t in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = of(plain, t)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
