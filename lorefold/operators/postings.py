"""A persisted inverted index for BM25: postings in blocks by falling impact, generations, and top lists that leave out blocks that can't matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.shared import written
from .ranking import K1, LIST_BYTES, MATRIX_TERMS, QUERY_BYTES, ROWS, B, _long, as_declared, query_terms, top_k, with_items

#: Postings of a block and of a part of a term, buckets of terms, and the rarest terms of a question whose first blocks give its first floor.
BLOCK, PART_ROWS, BUCKETS, LEADS = 128, 50_000, 16, 8
#: Postings that a task sorts or adds up.
TASK_POSTINGS = 2_000_000
#: Share of a question's floor that terms which aren't decisive may add together: more leaves more blocks unread, and more documents to score in full.
SPARE = 0.25
#: Scores are rounded to six digits after their weight; bounds leave room for that.
SLACK = 1e-5
#: First blocks of tiers 1 and 2.
TIERS = (1, 8)

_PEAK = "array<struct<dl:int,tf:int>>"
_PLACE = "generation string, field string"
_ABOUT = "generation string, field string, n long, total long, ids string"


def gain(tf: Column, dl: Column, average: float) -> Column:
    """A posting's share of its term's weight."""
    return tf / (tf + K1 * (1 - B + B * dl / average))


def peaks(entries: Column) -> Column:
    """Of postings (.., tf, dl) those that no other beats in both count and length: the block's bound for every average length."""
    short_first = F.array_sort(F.transform(entries, lambda e: F.struct(e["dl"].alias("dl"), (-e["tf"]).alias("less"))))
    more = lambda a, e: -e["less"] > F.coalesce(F.array_max(F.transform(a, lambda p: p["tf"])), F.lit(0))
    return F.aggregate(short_first, F.array().cast(_PEAK), lambda a, e: F.when(more(a, e), F.concat(a, F.array(F.struct(e["dl"].alias("dl"), (-e["less"]).alias("tf"))))).otherwise(a))


def _sent(df: DataFrame) -> DataFrame:
    """A written table to join with: sent to the tasks while it is small."""
    return F.broadcast(df) if df.count() * LIST_BYTES <= QUERY_BYTES else df


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, t) of tokens to (id, dl, terms, tfs): a document's tokens stand in one row, so they are counted there. Rows without a token go."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            part = part.filter(pc.greater(pc.list_value_length(part.column("t")), 0))
            if not part.num_rows:
                continue
            length = pc.list_value_length(part.column("t")).to_numpy().astype(np.int32)
            words = part.column("t").flatten().dictionary_encode()
            many = len(words.dictionary)
            key, tf = np.unique(np.repeat(np.arange(len(length)), length) * many + words.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(length) + 1) * many).astype(np.int32))
            terms, tfs = words.dictionary.take(pa.array(key % many)), pa.array(tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(length), *(pa.ListArray.from_arrays(ends, v) for v in (terms, tfs))], names=["id", "dl", "terms", "tfs"])


def documents(items: DataFrame, field: str) -> DataFrame:
    """(id, dl, terms, tfs): length, distinct terms and their counts of each item that has a token in the field."""
    kind = items.schema["id"].dataType.simpleString()
    return items.select("id", tokens(F.col(field)).alias("t")).mapInArrow(_counted, f"id {kind}, dl int, terms array<string>, tfs array<int>")


def _parted(whole: DataFrame) -> DataFrame:
    """Postings (term, part, id, dl, tf) of documents with a part number: terms of more than PART_ROWS documents are spread over as many parts as they need."""
    often = whole.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > PART_ROWS)
    hot = written(often.select("term", F.ceil(F.col("df") / PART_ROWS).alias("parts")), "hot-terms")
    one = whole.select("id", "dl", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})
    return one.join(_sent(hot), "term", "left").select("term", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "id", "dl", "tf")


def _cut(size: int):
    """Postings (bucket, term, part, id, dl, tf), sorted by term and part and there by falling impact, to a row for each block of `size`. What waits for its end is one part of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            left = b if left is None else pa.concat_batches([left, b])
            starts = _starts(left)
            if len(starts) > 1:
                yield _blocks(left.slice(0, starts[-1]), starts[:-1], size)
                left = left.slice(starts[-1])
        if left is not None and left.num_rows:
            yield _blocks(left, _starts(left), size)

    return run


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where a term or part begins."""
    term, part = (pc.not_equal(v.slice(1), v.slice(0, max(0, len(v) - 1))) for v in (rows.column("term"), rows.column("part")))
    return np.flatnonzero(np.concatenate([[True], pc.or_(term, part).to_numpy(zero_copy_only=False)])[: rows.num_rows])


def _blocks(rows: pa.RecordBatch, starts: np.ndarray, most: int) -> pa.RecordBatch:
    size = np.diff([*starts, rows.num_rows])
    place = np.arange(rows.num_rows) - np.repeat(starts, size)
    at = np.flatnonzero(place % most == 0)
    block = (place[at] // most).astype(np.int32)
    ends = np.array([*at, rows.num_rows], dtype=np.int32)
    of = np.repeat(np.arange(len(at)), np.diff(ends))
    dl, tf = (rows.column(c).to_numpy().astype(np.int64) for c in ("dl", "tf"))
    order = np.lexsort((-tf, dl, of))
    high = of[order] << 32 | tf[order]
    unbeaten = order[high > np.concatenate([[-1], np.maximum.accumulate(high)[:-1]])]
    peak = pa.StructArray.from_arrays([pa.array(v[unbeaten].astype(np.int32)) for v in (dl, tf)], names=["dl", "tf"])
    peaks_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[unbeaten], minlength=len(at)))]).astype(np.int32)), peak)
    lists = [pa.ListArray.from_arrays(pa.array(ends), rows.column(c)) for c in ("id", "tf", "dl")]
    tier = np.digitize(block, TIERS).astype(np.int32)
    term, part, bucket = (rows.column(c).take(pa.array(at)) for c in ("term", "part", "bucket"))
    return pa.RecordBatch.from_arrays([term, part, pa.array(block), pa.array(np.diff(ends)), peaks_of, *lists, pa.array(tier), bucket], names=["term", "part", "block", "n", "peaks", "ids", "tfs", "dls", "tier", "bucket"])


def _near(model, limit: int):
    """Postings (code, id, g) of whole documents to (qid, id, s, rest): what the decisive terms give a document, where that and the rest may still be among the best `limit`. A task holds its postings and a question's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        code, g = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("code", "g"))
        ids = pa.chunked_array([b.column("id") for b in rows]).combine_chunks().dictionary_encode()
        del rows
        order = np.argsort(code, kind="stable")
        g, place = g[order], ids.indices.to_numpy()[order]
        qids, edge, asked, floors, rests = model.value
        start = np.searchsorted(code[order], np.arange(edge + 1))
        for qid, terms, floor, rest in zip(qids, asked, floors, rests, strict=True):
            s = np.zeros(len(ids.dictionary))
            for k, idf, need in terms:
                mine = slice(start[k], start[k + 1])
                part = g[mine] * idf
                there = part >= need
                s += np.bincount(place[mine][there], part[there], len(s))
            most = floor if len(s) < limit else max(floor, np.partition(s, len(s) - limit)[len(s) - limit] - SLACK)
            found = np.flatnonzero((s > 0) & (s + rest >= most))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(found)), ids.dictionary.take(pa.array(found)), pa.array(s[found]), pa.array(np.full(len(found), rest))], names=["qid", "id", "s", "rest"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a question's terms with the terms of a document to the document's score."""
    for b in batches:
        score = np.zeros(b.num_rows)
        norm = b.column("norm").to_numpy()
        for i in range(b.num_rows):
            asked, idf, terms, tfs = (b.column(c)[i].values for c in ("asked", "idf", "terms", "tfs"))
            at = pc.index_in(asked, value_set=terms)
            there = at.is_valid()
            tf = tfs.take(at.filter(there)).to_numpy(zero_copy_only=False)
            score[i] = (idf.filter(there).to_numpy() * tf / (tf + norm[i])).sum()
        yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(score)], names=["qid", "id", "score"])


@dataclass
class PostingsIndex:
    """An index in a folder of any file system that Spark reads.

    `rows` holds a row for each block: up to BLOCK postings of a term, those of highest impact in the first block, with the peaks that bound what any of them gives. It is partitioned by generation, field, tier
    (first block, next ones, rest) and bucket of terms, so a search reads neither other fields nor the tail of terms that it can leave. `terms` holds each document's terms. A generation is there once its row in `about` is,
    which is written last; one that broke off may be added again under another name.
    """

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def about(self) -> list[T.Row]:
        """A row of counts for each field of each generation."""
        try:
            return self.spark.read.schema(_ABOUT).parquet(f"{self.path}/about").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def add(self, items: DataFrame, fields: tuple[str, ...] = ("content",), generation: str = "1") -> PostingsIndex:
        """Index items (id, and the fields) as a generation. An id that is null or there twice is an error; an item without a token in a field has no place in that field."""
        if any(r.generation == generation for r in self.about()):
            raise ValueError(f"generation {generation} is there already")
        if not items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
            raise ValueError("an id is null or repeated")
        about = []
        for field in fields:
            mark = {"generation": F.lit(generation), "field": F.lit(field)}
            kind = items.schema["id"].dataType.simpleString()
            documents(items, field).withColumns(mark).write.mode("append").partitionBy("generation", "field").parquet(f"{self.path}/terms")
            whole = self.spark.read.schema(f"id {kind}, dl int, terms array<string>, tfs array<int>, {_PLACE}").parquet(f"{self.path}/terms").where((F.col("generation") == generation) & (F.col("field") == field))
            mine = whole.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.sum(F.size("tfs")).alias("postings")).first()
            if not mine.n:
                about.append((generation, field, 0, 0, kind))
                continue
            spread = math.ceil(mine.postings / (BUCKETS * TASK_POSTINGS))
            parted = _parted(whole).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            dealt = parted.repartitionById(BUCKETS * spread, F.col("bucket") * spread + F.pmod(F.xxhash64("term", "part"), F.lit(spread)).cast("int"))
            falling = dealt.sortWithinPartitions("term", "part", gain(F.col("tf"), F.col("dl"), mine.total / mine.n).desc(), "id")
            rows = falling.mapInArrow(_cut(BLOCK), f"term string, part int, block int, n int, peaks {_PEAK}, ids array<{kind}>, tfs array<int>, dls array<int>, tier int, bucket int")
            dealt = rows.withColumns(mark).sortWithinPartitions("generation", "field", "tier", "bucket", "term", "part", "block")
            dealt.write.mode("append").partitionBy("generation", "field", "tier", "bucket").parquet(f"{self.path}/rows")
            about.append((generation, field, mine.n, mine.total, kind))
        self.spark.createDataFrame(about, _ABOUT).coalesce(1).write.mode("append").parquet(f"{self.path}/about")
        return self

    def _search(self, terms: DataFrame, field: str, limit: int, generations: list[str] | None) -> _Search | None:
        mine = [r for r in self.about() if r.field == field and (generations is None or r.generation in generations)]
        n, total = sum(r.n for r in mine), sum(r.total for r in mine)
        if not n:
            return None
        here = F.col("generation").isin([r.generation for r in mine]) & (F.col("field") == field)
        buckets = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
        return _Search(self._read("rows").where(here & F.col("bucket").isin(buckets)), self._read("terms").where(here), terms, n, total / n, limit)

    def search(self, questions: DataFrame, limit: int = 12, weights: dict[str, float] | None = None, generations: list[str] | None = None) -> DataFrame:
        """Top `limit` items (qid, id, score, rank) of questions (qid, text) by the best of the weighted fields, as ranking.bm25 has them over the items of these generations (all, without any named).

        An id must not be in two of the generations that are searched together.
        """
        if limit < 1:
            raise ValueError("limit must be positive")
        terms = written(query_terms(questions), "asked-terms")
        found = []
        for field, weight in (weights or {"content": 1.0}).items():
            s = self._search(terms, field, limit, generations)
            if s is not None:
                found.append(s.top().select("qid", "id", (F.col("score") * weight).alias("score")))
        if not found:
            kind = next((r.ids for r in self.about()), "string")
            return self.spark.createDataFrame([], f"qid {terms.schema['qid'].dataType.simpleString()}, id {kind}, score double, rank int")
        best = reduce(DataFrame.unionByName, found).groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score"))
        return top_k(best, limit, "qid", [F.desc("score"), F.asc("id")])

    def blocks(self, questions: DataFrame, limit: int = 12, field: str = "content", generations: list[str] | None = None) -> DataFrame:
        """What a search reads: a row (term, part, block, n, read) for each block of the questions' terms."""
        return self._search(written(query_terms(questions), "asked-terms"), field, limit, generations).blocks()


class _Search:
    """One field's top lists. A document is scored in full only if what its postings of the decisive terms give, and the most that the others could add, reaches the floor of its question."""

    def __init__(self, rows: DataFrame, whole: DataFrame, terms: DataFrame, n: int, average: float, limit: int) -> None:
        self.rows, self.whole, self.average, self.limit = rows, whole, average, limit
        heads = rows.select("generation", "term", "part", "block", "n", "peaks").join(_sent(written(terms.select("term").distinct(), "asked-words")), "term")
        heads = written(heads.withColumn("most", self._most()).drop("peaks"), "heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.heads = heads
        self.asked = written(terms.join(df.select("term", idf.alias("idf"), (idf * F.col("most")).alias("top")), "term"), "asked")
        self.floors = written(self._floors(), "floors")
        self.needs = written(self._needs(), "needs")

    def _most(self) -> Column:
        """The most that a posting of a block gives of its term's weight."""
        return F.array_max(F.transform("peaks", lambda p: gain(p["tf"], p["dl"], self.average)))

    def _postings(self, rows: DataFrame) -> DataFrame:
        one = rows.select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("e"))
        return one.select("term", F.col("e.ids").alias("id"), gain(F.col("e.tfs"), F.col("e.dls"), self.average).alias("g"))

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """(qid, id, score) of pairs, by the whole terms of their documents."""
        questions = self.asked.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("a")).select("qid", F.col("a.term").alias("asked"), F.col("a.idf").alias("idf"))
        norm = K1 * (1 - B + B * F.col("dl") / self.average)
        both = with_items(pairs.select("qid", "id"), self.whole.select("id", "terms", "tfs", norm.alias("norm"))).join(questions, "qid")
        kind = {f.name: f.dataType.simpleString() for f in both.schema}
        return both.mapInArrow(_scored, f"qid {kind['qid']}, id {kind['id']}, score double")

    def _floors(self) -> DataFrame:
        """The score that each question's list reaches at least: its rarest terms' first blocks propose documents, which are scored in full. Questions with fewer than `limit` of them have none."""
        leads = top_k(self.asked, LEADS, "qid", [F.desc("idf"), F.asc("term")]).select("qid", "term", "idf")
        first = self.rows.where("tier = 0").join(leads.select("term").distinct(), "term")
        some = self._postings(first).join(leads, "term").groupBy("qid", "id").agg(F.sum(F.col("idf") * F.col("g")).alias("part"))
        best = top_k(self._exact(top_k(some, 2 * self.limit, "qid", [F.desc("part"), F.asc("id")])), self.limit, "qid", [F.desc("score"), F.asc("id")])
        return best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == self.limit).select("qid", (F.col("floor") - SLACK).alias("floor"))

    def _needs(self) -> DataFrame:
        """(qid, term, idf, floor, need, rest): the decisive terms. The terms of least weight that together add less than SPARE of the floor aren't (rest is that sum).
        A posting that gives less than `need` is of a document below the floor."""
        of = Window.partitionBy("qid")
        x = self.asked.join(self.floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        x = x.withColumn("sum", F.sum("top").over(of.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("top").over(of))
        x = x.withColumn("small", F.col("sum") < SPARE * F.col("floor"))
        x = x.withColumn("rest", F.coalesce(F.max(F.when(F.col("small"), F.col("sum"))).over(of), F.lit(0.0)))
        return x.where("not small").select("qid", "term", "idf", "floor", (F.col("floor") - (F.col("all") - F.col("top"))).alias("need"), "rest")

    def wanted(self) -> DataFrame:
        least = self.needs.groupBy("term").agg(F.min(F.col("need") / F.col("idf")).alias("least"))
        return self.heads.join(least, "term").where(F.col("most") >= F.col("least")).select("generation", "term", "part", "block")

    def blocks(self) -> DataFrame:
        keys = ["generation", "term", "part", "block"]
        return self.heads.join(self.wanted().withColumn("_r", F.lit(True)), keys, "left").select("term", "part", "block", "n", F.coalesce("_r", F.lit(False)).alias("read"))

    def _found(self, needs: DataFrame) -> DataFrame:
        """(qid, id, s, rest) that may be among the best, for a bounded number of questions, which the driver and the tasks hold. The blocks that may reach a floor are dealt by documents, and added up there: pairs of questions and postings are never rows."""
        spark, terms, of = needs.sparkSession, {}, {}
        for r in needs.collect():
            k, least = terms.get(r.term, (len(terms), math.inf))
            terms[r.term] = k, min(least, r.need / r.idf)
            of.setdefault(r.qid, (r.floor, r.rest, []))[2].append((k, r.idf, r.need))
        model = spark.sparkContext.broadcast((list(of), len(terms), [x[2] for x in of.values()], [x[0] for x in of.values()], [x[1] for x in of.values()]))
        codes = F.broadcast(spark.createDataFrame([(t, k, least) for t, (k, least) in terms.items()], "term string, code int, least double"))
        tasks = math.ceil((self.heads.join(codes, "term").where("most >= least").agg(F.sum("n")).first()[0] or 1) / TASK_POSTINGS)
        read = self.rows.join(codes, "term").where(self._most() >= F.col("least")).select("code", F.inline(F.arrays_zip("ids", "tfs", "dls")))
        one = read.select("code", F.col("ids").alias("id"), "tfs", "dls").repartition(tasks, "id").select("code", "id", gain(F.col("tfs"), F.col("dls"), self.average).alias("g"))
        kind = {f.name: f.dataType.simpleString() for f in (*needs.schema, *one.schema)}
        found = one.mapInArrow(_near(model, self.limit), f"qid {_long(kind['qid'])}, id {kind['id']}, s double, rest double")
        return written(as_declared(found, kind), "near")

    def top(self) -> DataFrame:
        blocks = max(1, math.ceil(self.needs.count() / MATRIX_TERMS))
        near = reduce(DataFrame.unionByName, [self._found(self.needs.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)) for k in range(blocks)])
        least = top_k(near.select("qid", "s"), self.limit, "qid", [F.desc("s")]).groupBy("qid").agg(F.count("*").alias("n"), F.min("s").alias("least")).where(F.col("n") == self.limit)
        near = near.join(least.select("qid", "least"), "qid", "left").where(F.col("s") + F.col("rest") >= F.coalesce(F.col("least") - SLACK, F.lit(0.0)))
        return top_k(self._exact(near), self.limit, "qid", [F.desc(F.round("score", 6)), F.asc("id")])
