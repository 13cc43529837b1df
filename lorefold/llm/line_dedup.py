"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold, reassemble by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_split, materialise, pieces, table

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line with ASCII white space stripped at both ends and A-Z in lower case."""
    return line.strip(_STRIP).lower()


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(min_chars: int):
    """(doc_id, text_key, text) rows to (doc_id, text_key, line_hash, at): each distinct key of a text with the positions of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows: list[int] = []
            keys: list[bytes] = []
            places: list[list[int]] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(k := line_key(line)) >= min_chars and _code_points(k) >= min_chars:
                        found.setdefault(k, []).append(at)
                keys += map(_hash, found)
                places += found.values()
                rows += [i] * len(found)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "text_key", "line_hash", "at"])

    return run


def _reassemble(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, gone, texts = [], [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                bad = {at for part in drop or () for at in part}
                n.append(len(lines))
                gone.append(len(bad))
                texts.append(b"\n".join(x for at, x in enumerate(lines) if at not in bad).decode("utf-8", "surrogatepass") if bad else text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "kept_text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Drop each line whose key has at least min_chars code points and occurs in at least min_docs documents, except in the largest doc_id that holds it.

    Returns the columns named in keep (doc_id by default), kept_text, n_lines (before dropping) and n_dropped, a row for each row of docs.
    A doc_id may have any type that has an order. A null or empty text is one empty line; a null text stays null. A row with a null doc_id
    isn't counted and keeps its lines. Rows that repeat a doc_id are one document. Other columns, whatever their names, pass only if kept.
    Texts are worked on whole, however long, a few megabytes of them at a time.

    Each distinct line of a document is one row (hash, document, positions), written once for both passes. The first counts: Spark makes the distinct
    (line, document) pairs before it counts them, so a line in a third of all documents is spread over all tasks. The second brings the lines to be dropped back
    to their documents: hot lines, fewer than common.HOT_PARTS whatever the input, are broadcast, so no task meets all documents of one; the others are joined.
    Texts move once, to meet the positions that they lose.
    """
    names = keep or ["doc_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    keys = materialise(keyed.mapInArrow(_keys(min_chars), f"doc_id {kind}, text_key long, line_hash binary, at array<int>"), "lines")
    counted = keys.select("doc_id", "line_hash").distinct().groupBy("line_hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    frequent = materialise(counted.where(F.col("n") >= min_docs), "frequent")
    hot, rest = hot_split(frequent, keys.count())
    met = [keys.join(part, "line_hash").where("doc_id < last").select("doc_id", "text_key", "at") for part in (F.broadcast(hot), rest)]
    lost = met[0].unionByName(met[1]).groupBy(F.col("doc_id").alias("lost_id"), "text_key").agg(F.collect_list("at").alias("drop"))
    left = docs.select(*names, "text", F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema), "kept_text string", "n_lines long", "n_dropped long"])
    joined = left.join(lost, (left["own_id"] == lost["lost_id"]) & (left["own_key"] == lost["text_key"]), "left").select(*[left[c] for c in names], left["text"], "drop")
    return joined.select(*[F.col(c) for c in names if c != "text"], "text", "drop").mapInArrow(_reassemble(names), schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op8_line_dedup": r"""
with lines as (
  select doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
frequent as (select k, max(doc_id) as last from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.*, f.k is not null and l.doc_id < f.last as gone from lines l left join frequent f on l.k = f.k)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
}
