"""BPE encoding and decoding: content-defined chunks that documents share are encoded once, and chunk joins are repaired by re-encoding until they agree exactly."""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, hot_split, materialise, pieces, table

#: A chunk ends where the top MASK bits of the rolling hash of its last 8 bytes are zero, but has LEAST bytes at least and MOST (up to 3 more, for a whole character) at most.
MASK, LEAST, MOST = 10, 256, 8192
#: Bytes of texts that are worked on together, and that the tokenizer gets at once, as what it makes of them is far larger.
PIECE, BATCH = 2 << 20, 1 << 19
#: Chunks with more than one part in HOT_CHUNKS of all occurrences are hot, so fewer than that; they have 2 * MOST bytes of ids at most, 32 MB in all.
HOT_CHUNKS = 2000
#: Words that a worker remembers before it starts anew.
MOST_WORDS = 300_000
#: The pattern of the files named above, for texts of plain characters: ASCII without odd controls, Latin letters, and common punctuation, about which all regular expression libraries agree. The tokenizer takes all others.
_LETTERS, _DIGITS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u20ac]*+")
PATTERN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
#: Bytes of the window of the rolling hash, and the odd number that spreads them over 64 bits.
WINDOW, _ODD = 8, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Codec:
    """A tokenizers file, with what joins need: the bytes that each id stands for."""

    tokenizer: object
    width: np.ndarray
    kind: np.dtype
    added: tuple[str, ...]

    words: dict[str, bytes] = field(default_factory=dict)  # packed ids of words that the pattern finds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts of plain characters without added tokens are cut by the pattern here, and each word is encoded once; the tokenizer takes the others whole."""
        plain = [PLAIN.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        others = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            found = [PATTERN.findall(t) if p else None for t, p in zip(texts[at:end], plain[at:end], strict=True)]
            if len(self.words) > MOST_WORDS:
                self.words.clear()
            new = list({w for f in found if f for w in f}.difference(self.words))
            self.words.update(zip(new, (self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            out += [next(others) if f is None else np.frombuffer(b"".join(map(self.words.__getitem__, f)), self.kind) for f in found]
            if sum(map(len, new)) > 2 * BATCH:
                self.words.clear()
            at = end
        return out

    def pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file, loaded once a worker. The file must describe byte-level BPE with its usual pattern and no normaliser, for which joins() is right."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said["pre_tokenizer"] or {}
    if said["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or said["post_processor"]:
        raise ValueError(f"{path} isn't a byte-level BPE file with the usual pattern, without prefix space, normaliser and post-processor")
    if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in said["added_tokens"]):
        raise ValueError(f"{path} has added tokens with white space")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    width = np.zeros(max([*said["model"]["vocab"].values(), *(t["id"] for t in said["added_tokens"])]) + 1, np.int64)
    for token, i in said["model"]["vocab"].items():
        width[i] = len(token)  # a character stands for a byte
    for t in said["added_tokens"]:
        width[t["id"]] = len(t["content"].encode())
    return Codec(tokenizer, width, np.dtype("<u2" if len(width) <= 1 << 16 else "<u4"), tuple(t["content"] for t in said["added_tokens"]))


def candidates(data: bytes, mask: int = MASK) -> np.ndarray:
    """Places after which the hash of the last WINDOW bytes has `mask` leading zeros. The hash rolls over the bytes as WINDOW rows of windows that don't overlap."""
    found = []
    for k in range(min(WINDOW, max(0, len(data) - WINDOW + 1))):
        window = np.frombuffer(data, "<u8", (len(data) - k) // WINDOW, k)
        found.append(np.flatnonzero(window * _ODD >> np.uint64(64 - mask) == 0) * WINDOW + (k + WINDOW))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Cut:
    """Texts in one buffer, and their chunks."""

    data: bytes
    starts: list[int]  # of texts, and the end of the last
    chunks: list[list[int]]  # of each text: starts, and the end of the last

    def keys(self, i: int) -> list[tuple[int, int]]:
        """128 bits of a hash of each chunk of text i, as two longs."""
        out = []
        for a, b in pairwise(self.chunks[i]):
            h = hashlib.blake2b(self.data[a:b], digest_size=16).digest()
            out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
        return out


    def safe(self) -> np.ndarray:
        """Places that no token crosses: a blank or a newline that follows a visible ASCII character. The usual pattern has no alternative with white space behind anything else, none that
        looks back, and looks ahead only from white space; added tokens have no white space. So a text's ids are those of its parts, cut at safe places."""
        data = np.frombuffer(self.data, np.uint8)
        space = (data == 0x20) | (data == 0x0A)
        return np.flatnonzero(space[1:] & ((data > 0x20) & (data < 0x7F))[:-1]) + 1


def cut(texts: list[str | None], mask: int = MASK, least: int = LEAST, most: int = MOST) -> Cut:
    """Cut texts into chunks at places that their content decides."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"".join(parts)
    ends = candidates(data, mask).tolist()
    starts = [0]
    chunks = []
    for p in parts:
        at, end = starts[-1], starts[-1] + len(p)
        bounds = [at]
        while end - at > least:
            i = bisect.bisect_left(ends, at + least)
            to = min(ends[i] if i < len(ends) else end, at + most, end)
            while to < end and data[to] & 0xC0 == 0x80:
                to += 1
            bounds.append(at := to)
        if at < end or len(bounds) == 1:
            bounds.append(end)
        chunks.append(bounds)
        starts.append(end)
    return Cut(data, starts, chunks)


def joined(c: Cut, codec: Codec, known: list[dict[tuple[int, int], np.ndarray]], keys: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """The ids of each text: known chunks give theirs, the runs between them are encoded, and around each join the text between two safe places is encoded anew.

    A join's part goes from the last safe place at or before it to the first at or after it. Ids of the neighbours are kept outside of it, where an id begins exactly at its end;
    as long as none does, the end moves on to the next safe place.
    """
    plans: list[list[tuple[int, int, np.ndarray | None]]] = []  # of each text: from, to, ids of the whole chunk
    for i, bounds in enumerate(c.chunks):
        runs: list[tuple[int, int, np.ndarray | None]] = []
        for (a, b), key in zip(pairwise(bounds), keys[i], strict=True):
            ids = known[i].get(key)
            if ids is None and runs and runs[-1][2] is None:
                runs[-1] = (runs[-1][0], b, None)
            elif a < b:
                runs.append((a, b, ids))
        plans.append(runs)
    own = iter(codec.encode([c.data[a:b].decode("utf-8", "surrogatepass") for runs in plans for a, b, ids in runs if ids is None]))
    todo: list[tuple[int, int]] = []
    safe = c.safe()
    results: list[list[np.ndarray | int]] = []
    for i, runs in enumerate(plans):
        first, end = c.starts[i], c.starts[i + 1]
        lo_safe, hi_safe = np.searchsorted(safe, first, 'right').item(), np.searchsorted(safe, end).item()
        parts: list[np.ndarray | int] = []
        done = first  # up to here the text has its ids
        for n, (a, b, ids) in enumerate(runs):
            ids = next(own) if ids is None else ids
            ends = np.cumsum(codec.width[ids]) + a
            if n == 0:
                lo, at = a, 0
            else:
                k = bisect.bisect_left(safe, a, lo_safe, hi_safe)
                while True:
                    lo = safe[k].item() if k < hi_safe else end
                    at = 0 if lo == a else int(np.searchsorted(ends, lo)) + 1
                    if lo >= b or lo == a or ends[at - 1] == lo:
                        break
                    k += 1
            if lo < done or lo >= b:
                continue  # the part around the next join, or around the last, takes this run whole
            if b == end:
                hi, to = b, len(ids)
            else:
                k = bisect.bisect_right(safe, b, lo_safe, hi_safe) - 1
                while True:
                    hi = safe[k].item() if k >= lo_safe else first
                    to = int(np.searchsorted(ends, hi)) + 1
                    if hi <= lo or ends[to - 1] == hi:
                        break
                    k -= 1
            if hi <= lo:
                continue
            if lo > done:
                parts.append(len(todo))
                todo.append((done, lo))
            parts.append(ids[at:to])
            done = hi
        if done < end:
            parts.append(len(todo))
            todo.append((done, end))
        results.append(parts)
    mended = codec.encode([c.data[a:b].decode("utf-8", "surrogatepass") for a, b in todo])
    none = np.zeros(0, codec.kind)
    return [np.concatenate([none, *(mended[p] if isinstance(p, int) else p for p in parts)]) for parts in results]


def _counts(sizes: dict):
    """Texts to chunk keys with their occurrences, a row for each key of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            c = cut(b.column("text").to_pylist(), **sizes)
            found = np.array([k for i in range(b.num_rows) for k in c.keys(i)], np.int64).reshape(-1, 2)
            keys, n = np.unique(found, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return run


def _shared_chunks(sizes: dict, shared):
    """Texts to the chunks that may be shared: key and bytes, once a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            c = cut(b.column("text").to_pylist(), **sizes)
            found: dict[tuple[int, int], bytes] = {}
            for i in range(b.num_rows):
                for key, (x, y) in zip(c.keys(i), pairwise(c.chunks[i]), strict=True):
                    if key not in found and key[0] in shared.value:
                        found[key] = c.data[x:y]
            keys = np.array(list(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), pa.binary())], names=["a", "b", "chunk"])

    return run


def _encoded_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "chunk", PIECE):
            ids = codec(path).encode([x.decode("utf-8", "surrogatepass") for x in b.column("chunk").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([x.tobytes() for x in ids], pa.binary())], names=["a", "b", "ids"])

    return run


def _marked(sizes: dict, shared):
    """Texts' keys k1, k2 to the chunks of theirs that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            c = cut(b.column("text").to_pylist(), **sizes)
            found = [(i, *key) for i in range(b.num_rows) for key in {k for k in c.keys(i) if k[0] in shared.value}]
            at = np.array(found, np.int64).reshape(-1, 3)
            take = pa.array(at[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), pa.array(at[:, 1]), pa.array(at[:, 2])], names=["k1", "k2", "a", "b"])

    return run


def _alone(sizes: dict, shared, path: str, names: list[str], others: bool):
    """Rows without any chunk that may be shared, with their ids; or, if others, the other rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            texts = b.column("text").to_pylist()
            c = cut(texts, **sizes)
            mine = pa.array([any(k[0] in shared.value for k in c.keys(i)) == others for i in range(b.num_rows)])
            b = b.filter(mine)
            if others:
                yield b
            elif b.num_rows:
                ids = codec(path).encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _lists(ids)], names=[*names, "ids"])

    return run


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))


def _assemble(sizes: dict, path: str, names: list[str]):
    """Rows sorted by k1, k2, those with ids of chunks before those with texts, to rows with the ids of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, {}
        for b in pieces(batches, "text", PIECE):
            known = []
            rows = []
            key1, key2, is_text = b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("is_text").to_pylist()
            a, z, ids = b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("chunk_ids")
            for i in range(b.num_rows):
                if (key1[i], key2[i]) != of:
                    of, own = (key1[i], key2[i]), {}
                if is_text[i]:
                    rows.append(i)
                    known.append(own)
                else:
                    own[a[i], z[i]] = np.frombuffer(ids[i].as_py(), codec(path).kind)
            if rows:
                kept = b.take(pa.array(rows))
                c = cut(kept.column("text").to_pylist(), **sizes)
                out = joined(c, codec(path), known, [c.keys(i) for i in range(len(rows))])
                yield pa.RecordBatch.from_arrays([*(kept.column("row").field(n) for n in names), _lists(out)], names=[*names, "ids"])

    return run


def encode(docs: DataFrame, path: str, mask: int = MASK, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Add ids, the list of a text's ids under the tokenizers file at `path`, equal to the library's encode(text, add_special_tokens=False).

    All columns of docs pass, whatever their names; one named ids is replaced. A null or empty text has no ids. Rows that repeat a doc_id, null ones included, are encoded each by its text. Texts are
    worked on whole, however long. An empty table stays empty.

    Chunks are counted by a 128-bit hash of their bytes; those found twice or more are shared. Each is encoded in one place, once, and its ids, two bytes each, go to the documents that have it: the hottest,
    fewer than HOT_CHUNKS whatever the input, by broadcast, the others by a join that Spark may split. A document with shared chunks meets their ids in one sort by document, encodes the runs
    between and repairs the joins. Documents without any are encoded where they are read and their texts never move. A sieve of at most 8 MB keeps chunks that aren't shared out
    of the shuffles; where it lets one pass, that chunk is encoded like a shared one.
    """
    sizes = {"mask": mask, "least": least, "most": most}
    spark = docs.sparkSession
    key = [F.xxhash64(F.lit(n), *(docs[c] for c in ("doc_id",) if c in docs.columns), docs["text"]).alias(f"k{n}") for n in (1, 2)]
    text = docs.select("text")
    counted = text.mapInArrow(_counts(sizes), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    shared = materialise(counted, "shared-chunks")
    sieve = spark.sparkContext.broadcast(Sieve.of(shared, "a"))
    chunks = text.mapInArrow(_shared_chunks(sizes, sieve), "a long, b long, chunk binary").groupBy("a", "b").agg(F.first("chunk").alias("chunk"))
    encoded = materialise(chunks.mapInArrow(_encoded_chunks(path), "a long, b long, ids binary"), "encoded-chunks")
    marks = docs.select(*key, "text").mapInArrow(_marked(sizes, sieve), "k1 long, k2 long, a long, b long")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = encoded.join(hot_split(shared, total, parts=HOT_CHUNKS)[0].select("a", "b"), ["a", "b"], "left_semi")
    hot = materialise(hot, "hot-chunks")
    cold = marks.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
    met = [marks.join(F.broadcast(hot), ["a", "b"]), cold.join(encoded, ["a", "b"])]
    names = [c for c in docs.columns if c != "ids"]
    fields = docs.select(*names).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>"])
    named = docs.select(*names)
    alone = named.mapInArrow(_alone(sizes, sieve, path, names, False), schema)
    packed = docs.select(*key, "text", F.struct(*[docs[c] for c in names]).alias("row"))
    others = packed.mapInArrow(_alone(sizes, sieve, path, [], True), packed.schema)
    rows = others.select("k1", "k2", F.lit(True).alias("is_text"), "text", "row", *[F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("chunk_ids", "binary"))])
    lists = met[0].unionByName(met[1]).select("k1", "k2", F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(packed.schema["row"].dataType).alias("row"), "a", "b", F.col("ids").alias("chunk_ids"))
    meeting = rows.unionByName(lists).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "is_text")
    return alone.unionByName(meeting.mapInArrow(_assemble(sizes, path, names), schema))


def _decoded(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = part.column("ids").fill_null([])
                flat, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).tolist()
                ids = [flat[x:y] for x, y in pairwise(ends)]
                digests = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array(digests), pa.array(codec(path).decode([x.tolist() for x in ids]), pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], names=[*names, "n_tokens", "ids_sha256", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Replace ids by n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded, the text that they stand for, special tokens included. Null ids count as none."""
    left = encoded.drop("n_tokens", "ids_sha256", "decoded")
    names = [c for c in left.columns if c != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*names).schema), "n_tokens long, ids_sha256 string, decoded string"])
    return left.mapInArrow(_decoded(path, names), schema)


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


SQL: dict[str, str] = {}
