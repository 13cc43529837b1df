"""Ranking over many questions at once: BM25, exact vector search, rank fusion, reranking and expansion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import written

K1, B = 1.2, 0.75
#: Terms of all questions, and cells of distinct terms by questions, up to which matrices score them; items that a task scores at once; bytes of query vectors that are sent at once.
MATRIX_TERMS, MATRIX_CELLS, ROWS, QUERY_BYTES = 20_000, 4_000_000, 256, 32 << 20
#: Bytes of a row of a ranked list, as it is sent; scores that a task computes at once, and rows of lists that it merges or hands on at once.
LIST_BYTES, CELLS, MERGE_ROWS = 128, 1 << 21, 50_000
#: Digits of scores, and how far apart two scores may be that are the same when rounded, with room.
DIGITS, ROUNDING = 6, 2e-6


@dataclass(frozen=True)
class SearchConfig:
    """Budgets of retrieval; invalid values are refused."""

    seeds: int = 12
    candidates: int = 100
    rrf_k: int = 30
    heading_weight: float = 2.0
    speaker_weight: float = 2.0
    expansions: int = 2
    rerank_candidates: int = 100
    rerank_limit: int = 12
    expanded: int = 24

    def __post_init__(self) -> None:
        if min(self.seeds, self.candidates, self.rrf_k, self.rerank_candidates, self.rerank_limit) < 1:
            raise ValueError("limits must be positive")
        if self.heading_weight <= 0 or self.speaker_weight <= 0:
            raise ValueError("weights must be positive")
        if not 1 <= self.expansions <= 4 or self.rerank_limit > 12:
            raise ValueError("1 to 4 expansions and at most 12 reranked results")

    def candidate_limit(self, rerank: bool = False) -> int:
        most = max(self.seeds, self.candidates)
        return max(most, self.rerank_candidates) if rerank else most


def top_k(df: DataFrame, k: int, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each `by`, numbered from 1. Spark limits each group before the shuffle."""
    if k < 1:
        raise ValueError("limit must be positive")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def with_items(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """A ranked list with the columns of its items. The list is written once and counted; while it is small it goes to the items, whose texts then stay where they are. A larger one leaves the choice to Spark."""
    ranked = written(ranked, "ranked")
    return items.join(F.broadcast(ranked) if ranked.count() * LIST_BYTES <= QUERY_BYTES else ranked, "id")


def bm25_field(items: DataFrame, terms: DataFrame, field: str) -> DataFrame:
    """(qid, id, score) of one field of items (id, field) for terms (qid, term), with statistics over all items.

    Only postings of query terms are kept: the terms join before anything is grouped. A document's postings stand in one partition, so
    they are counted there before the shuffle. The statistics are one row.
    """
    text = items.select("id", tokens(F.col(field)).alias("t")).where(F.size("t") > 0).withColumn("dl", F.size("t"))
    stats = text.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    postings = text.select("id", "dl", F.explode("t").alias("term")).join(wanted, "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = terms.join(df, "term").crossJoin(stats).select("qid", "term", idf.alias("idf"), "avgdl")
    gain = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(weight, "term").groupBy("qid", "id").agg(F.sum(gain).alias("score"))


def query_terms(questions: DataFrame) -> DataFrame:
    """Distinct (qid, term) of questions (qid, text)."""
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


class Best:
    """The best `limit` scores of each query that a task has seen; equal ones go by the smaller id. It holds `limit` rows a query and at most as many again that wait for the next merge, in columns whose types never change."""

    def __init__(self, limit: int) -> None:
        self.limit, self.waiting = limit, 0
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.least: np.ndarray | None = None

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """Scores of rows (ids) by columns (queries), not rounded yet; minus infinity is none. The caller bounds their number, see rows_at_once."""
        if self.least is None:
            self.least = np.full(scores.shape[1], -np.inf)
        least, n = self.least - ROUNDING, len(ids)
        if n > self.limit and np.count_nonzero(scores >= least) > self.limit * scores.shape[1]:
            least = np.maximum(least, np.partition(scores, n - self.limit, axis=0)[n - self.limit] - ROUNDING)
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        score = np.round(scores[row, query], DIGITS)
        fits = score >= self.least[query]
        if not fits.any():
            return
        self.held.append((ids.take(pa.array(row[fits])), query[fits], score[fits]))
        self.waiting += int(fits.sum())
        if self.waiting >= max(MERGE_ROWS, self.limit * len(self.least)):
            self._merge()

    def _merge(self) -> None:
        ids = pa.concat_arrays([h[0] for h in self.held])
        query, score = (np.concatenate([h[k] for h in self.held]) for k in (1, 2))
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -score, query))
        start = np.searchsorted(query[order], np.arange(len(self.least)))
        order = order[np.arange(len(order)) - start[query[order]] < self.limit]
        self.held, self.waiting = [(ids.take(pa.array(order)), query[order], score[order])], 0
        full = np.flatnonzero(np.bincount(query[order], minlength=len(self.least)) == self.limit)
        self.least[full] = score[order][np.searchsorted(query[order], full, side="right") - 1]

    def rows(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        ids, query, score = self.held[0]
        for at in range(0, len(ids), MERGE_ROWS):
            part = slice(at, at + MERGE_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(queries[query[part]].tolist()), ids[part], pa.array(score[part])], names=["qid", "id", "score"])


def rows_at_once(queries: int) -> int:
    """Rows that are scored against so many queries at once, so that their scores have a bounded number of cells."""
    return max(1, min(ROWS, CELLS // max(1, queries)))


def as_declared(found: DataFrame, kind: dict[str, str]) -> DataFrame:
    """Lists whose qids the tasks hold as long, with the ids in their own types."""
    return found.withColumn("qid", F.col("qid").cast(kind["qid"]))


def _long(kind: str) -> str:
    return "bigint" if kind in ("tinyint", "smallint", "int") else kind


def _incidence(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the vocabulary's terms in each row of tokens, rows by terms, and the rows' lengths."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    place = pc.index_in(column.flatten(), vocabulary).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), length)
    known = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(len(place), dtype=bool)
    flat = row[known] * len(vocabulary) + place[known].astype(np.int64)
    return np.bincount(flat, minlength=len(column) * len(vocabulary)).reshape(len(column), -1), length


def _found_terms(vocabulary, fields: list[str]):
    """Arrow rows (id, fields as tokens) to the vocabulary's terms in each field, as places and counts, and the fields' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                names, columns = ["id"], [b.column("id").slice(at, ROWS)]
                for f in fields:
                    tf, dl = _incidence(b.column(f).slice(at, ROWS), terms)
                    row, term = np.nonzero(tf)
                    start = pa.array(np.searchsorted(row, np.arange(len(dl) + 1)), pa.int32())
                    names += [f"{f}_term", f"{f}_tf", f"{f}_dl"]
                    columns += [*(pa.ListArray.from_arrays(start, pa.array(v, pa.int32())) for v in (term, tf[row, term])), pa.array(dl, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _best_scores(model, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, fields, ids = model.value
        best, step = Best(limit), rows_at_once(len(ids))
        for b in batches:
            for at in range(0, b.num_rows, step):
                scores = None
                for f, weight, weights, average in fields:
                    term, tf, dl = (b.column(f"{f}_{c}").slice(at, step) for c in ("term", "tf", "dl"))
                    row = np.repeat(np.arange(len(dl)), pc.list_value_length(term).to_numpy())
                    tf, dl = tf.flatten().to_numpy(), dl.to_numpy()
                    gain = np.zeros((len(dl), n_terms))
                    gain[row, term.flatten().to_numpy()] = tf / (tf + (K1 * (1 - B + B * dl / average))[row])
                    mine = gain @ weights * weight
                    scores = mine if scores is None else np.maximum(scores, mine)
                best.add(b.column("id").slice(at, step), np.where(scores > 0, scores, -np.inf))
        yield from best.rows(ids)

    return run


def bm25_by_matrix(items: DataFrame, terms: DataFrame, fields: dict[str, float], limit: int) -> DataFrame:
    """(qid, id, score): at least the top `limit` items of each question by its best field, for a bounded set of questions.

    Tasks multiply the matrix of their items by the questions' terms with that of term by question weights and hand on their best items only, so the pairs of questions
    and matching items are never rows. Texts are read and cut into tokens once: the questions' terms in each item are written, counted and scored from there. The terms (qid, term) come to the
    driver and the tasks; the caller bounds their number.
    """
    spark = items.sparkSession
    rows = terms.toArrow()
    vocabulary = pc.unique(rows.column("term").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    place = {t: k for k, t in enumerate(vocabulary.to_pylist())}
    ids = sorted(set(rows.column("qid").to_pylist()))
    of = {q: k for k, q in enumerate(ids)}
    asked = np.zeros((len(place), len(ids)))
    for q, t in zip(rows.column("qid").to_pylist(), rows.column("term").to_pylist(), strict=True):
        asked[place[t], of[q]] = 1
    text = items.select("id", *[tokens(F.col(f)).alias(f) for f in fields])
    kind = {x.name: x.dataType.simpleString() for x in (*items.schema, *terms.schema)}
    found = written(text.mapInArrow(_found_terms(spark.sparkContext.broadcast(vocabulary), list(fields)), f"id {kind['id']}, " + ", ".join(f"{f}_term array<int>, {f}_tf array<int>, {f}_dl int" for f in fields)), "terms")
    whole = found.agg(*[x for f in fields for x in (F.count_if(F.col(f"{f}_dl") > 0).alias(f"{f}_n"), F.coalesce(F.sum(f"{f}_dl"), F.lit(0)).alias(f"{f}_total"))]).first()
    model = []
    for f, weight in fields.items():
        n, total = whole[f"{f}_n"], whole[f"{f}_total"]
        df = np.zeros(len(place))
        for r in found.select(F.explode(f"{f}_term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r.term] = r.n
        model.append((f, weight, asked * np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None], total / max(1, n) or 1.0))
    return as_declared(found.mapInArrow(_best_scores(spark.sparkContext.broadcast((len(place), model, np.array(ids))), limit), f"qid {_long(kind['qid'])}, id {kind['id']}, score double"), kind)


def bm25(items: DataFrame, questions: DataFrame, limit: int = 12, heading_weight: float | None = None, speaker_weight: float | None = None) -> DataFrame:
    """Top `limit` items (qid, id, score, rank) of each question by the best of the fields content, heading and speaker. Scores are rounded, ties go to the smaller id.

    heading and speaker count only with a weight; speaker is one keyword that must equal the whole question. Question sets of a bounded size (see MATRIX_CELLS) are scored by
    matrices in the tasks, larger ones by joins of postings; both give the same.
    """
    terms = query_terms(questions)
    size = terms.agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.count_distinct("qid").alias("questions")).first()
    if size.n <= MATRIX_TERMS and size.terms * size.questions <= MATRIX_CELLS:
        scored = bm25_by_matrix(items, terms, {"content": 1.0, **({"heading": heading_weight} if heading_weight else {})}, limit)
    else:
        scored = bm25_field(items, terms, "content")
        if heading_weight:
            scored = scored.unionByName(bm25_field(items, terms, "heading").withColumn("score", F.col("score") * heading_weight))
    if speaker_weight:
        stats = items.where("speaker is not null").groupBy("speaker").agg(F.count("*").alias("df")).crossJoin(items.agg(F.count("speaker").alias("n")))
        value = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / (1 + K1) * speaker_weight
        same = items.select("id", "speaker").join(stats, "speaker").join(questions.select("qid", F.col("text").alias("speaker")), "speaker")
        scored = scored.unionByName(same.select("qid", "id", value.alias("score")))
    best = scored.groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(best, limit, "qid", [F.desc("score"), F.asc("id")])


def unit(v: Column) -> Column:
    """A vector as doubles of length 1; null where that can't be."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(d, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def checked_vector(v: Column, dim: int) -> Column:
    """A query vector, refused if it isn't of dim numbers."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"a query vector needs {dim} dimensions, not "), F.size(v).cast("string"))))


def _unit_rows(ids: pa.Array, x: pa.Array, size: int) -> tuple[pa.Array, np.ndarray]:
    """Vectors of `size` numbers as rows of length 1, summed in the order of unit(), and their ids; others, and those that have no such form, are left out."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(x), size), False)
    v = x.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.cumsum(v * v, axis=1)[:, -1])
    good = (norm > 0) & (norm < np.inf)
    return ids.filter(fits).filter(pa.array(good)), v[good] / norm[good, None]


def _best_products(matrix, ids: np.ndarray, limit: int):
    """Arrow rows (id, x) to the best `limit` products of each query in a task. Unfit vectors are left out here: a filter over the column would make Spark compute the vectors twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = matrix.value
        best, step = Best(limit), rows_at_once(len(ids))
        for b in batches:
            for at in range(0, b.num_rows, step):
                some, x = _unit_rows(b.column("id").slice(at, step), b.column("x").slice(at, step), q.shape[1])
                if len(some):
                    best.add(some, x @ q.T)
        yield from best.rows(ids)

    return run


def knn(items: DataFrame, queries: DataFrame, limit: int = 12, candidates: int = 100, dim: int | None = None) -> DataFrame:
    """Exact cosine top list (qid, id, score, rank) of items (id, embedding) for queries (qid, embedding).

    Queries are a stated set that every item is compared with once, in blocks of at most QUERY_BYTES that are sent to the tasks; a task multiplies matrices and hands on
    only its best items for each query. Where there are several blocks, each is run, its lists are written to the shared folder and its queries are released before the next, so the driver holds one. Filter items first, so the limit counts visible ones. Null and zero vectors have no place. With dim, a query
    vector of another length is an error; an item's is left out. limit must not exceed candidates.
    """
    if not 1 <= limit <= candidates:
        raise ValueError("limit must be positive and not above candidates")
    x = items.select("id", F.col("embedding").cast("array<double>").alias("x"))
    embedding = F.col("embedding") if dim is None else checked_vector(F.col("embedding"), dim)
    q = queries.select("qid", unit(embedding).alias("q"), F.size(embedding).alias("size")).where("q is not null")
    kind, context = {f.name: f.dataType.simpleString() for f in (*x.schema, *q.schema)}, items.sparkSession.sparkContext
    parts = []
    for r in q.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect():
        blocks = -(-r.n * r["size"] * 8 // QUERY_BYTES)
        for k in range(blocks):
            some = q.where((F.col("size") == r["size"]) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)).select("qid", "q").toArrow()
            if not some.num_rows:
                continue
            matrix = context.broadcast(np.stack(some.column("q").to_numpy(zero_copy_only=False)))
            ids = np.array(some.column("qid").to_pylist())
            best = as_declared(x.mapInArrow(_best_products(matrix, ids, limit), f"qid {_long(kind['qid'])}, id {kind['id']}, score double"), kind)
            if blocks > 1:
                best = written(top_k(best, limit, "qid", [F.desc("score"), F.asc("id")]).drop("rank"), "knn")
                matrix.destroy()
            parts.append(best)
    if not parts:
        return x.limit(0).select(F.lit(None).cast(kind["qid"]).alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return top_k(reduce(DataFrame.unionByName, parts), limit, "qid", [F.desc("score"), F.asc("id")])


def fuse(lists: DataFrame, limit: int, k: int) -> DataFrame:
    """Reciprocal rank fusion of (qid, list_id, rank from 1, id) to (qid, position, id, score).

    An id counts once in a list, at its best rank, though repeats use up ranks; ties go to the id met first, by list and rank.
    """
    if limit < 1 or k < 1:
        raise ValueError("limit and k must be positive")
    once = lists.groupBy("qid", "list_id", "id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_id", "rank")).alias("met"))
    return top_k(fused, limit, "qid", [F.desc("score"), F.asc("met")], "position").select("qid", F.col("position"), "id", "score")


def hybrid(lexical: DataFrame, vector: DataFrame, limit: int, k: int) -> DataFrame:
    """One question's plan: BM25 is the first list, vectors the second."""
    return fuse(lexical.select("qid", F.lit(0).alias("list_id"), "rank", "id").unionByName(vector.select("qid", F.lit(1).alias("list_id"), "rank", "id")), limit, k)


def expanded(lexical: DataFrame | None, vector: DataFrame, limit: int, k: int) -> DataFrame:
    """The plan of several queries of a question, (qid, variant, rank, id) each: for every variant vectors come first, then BM25."""
    lists = vector.select("qid", (2 * F.col("variant")).alias("list_id"), "rank", "id")
    if lexical is not None:
        lists = lists.unionByName(lexical.select("qid", (2 * F.col("variant") + 1).alias("list_id"), "rank", "id"))
    return fuse(lists, limit, k)


def search_queries(questions: DataFrame, expansions: DataFrame, limit: int = 2) -> DataFrame:
    """(qid, variant, text): the question, then its expansions (qid, pos, text) that aren't blank and, without case, not there before, numbered densely."""
    every = questions.select("qid", F.lit(-1).alias("pos"), "text").unionByName(expansions.where(F.col("pos") < limit).select("qid", "pos", "text"))
    clean = every.withColumn("text", F.regexp_replace("text", r"^[\x00-\x20]+|[\x00-\x20]+$", "")).where("text <> ''")
    first = clean.withColumn("n", F.row_number().over(Window.partitionBy("qid", F.lower("text")).orderBy("pos"))).where("n = 1")
    return first.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1).alias("variant"), "text")


def overlap_score(question: Column, passage: Column) -> Column:
    """A deterministic reranker: the share of the question's distinct tokens that the passage has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(passage))) / F.size(q)).otherwise(0.0)


def rerank(ranked: DataFrame, questions: DataFrame, items: DataFrame, limit: int = 12, scorer=overlap_score) -> DataFrame:
    """Candidates (qid, id, rank) by the scorer, then by their old rank; a question with one candidate keeps it. `scorer` may be a pandas UDF over (question, passage)."""
    joined = with_items(ranked.select("qid", "id", "rank"), items.select("id", "content")).join(questions.select("qid", F.col("text").alias("question")), "qid")
    scored = joined.select("qid", "id", F.col("rank").alias("old_rank"), F.round(scorer(F.col("question"), F.col("content")), 6).alias("score"))
    return top_k(scored, limit, "qid", [F.desc("score"), F.asc("old_rank")])


def expand_following(seeds: DataFrame, items: DataFrame, most_seeds: int = 12, limit: int = 24) -> DataFrame:
    """Seeds (qid, id, rank) with the chunk that follows each in its workspace, source and section, in the order seed, follower, seed, ...; an id stays at its first place.

    items: id, workspace_id, source_id, section_id, sequence. More than most_seeds seeds of a question are an error, found by Spark when the result is computed.
    """
    fits = F.when(F.col("rank") > most_seeds, F.raise_error(F.lit(f"a question has more than {most_seeds} seeds"))).otherwise(F.col("rank"))
    seeds = seeds.withColumn("rank", fits.cast(seeds.schema["rank"].dataType))
    place = seeds.join(items, "id")
    following = place.select("qid", "rank", "workspace_id", "source_id", "section_id", (F.col("sequence") + 1).alias("sequence")).join(items, ["workspace_id", "source_id", "section_id", "sequence"])
    both = seeds.select("qid", "id", (2 * F.col("rank")).alias("at")).unionByName(following.select("qid", "id", (2 * F.col("rank") + 1).alias("at")))
    return top_k(both.groupBy("qid", "id").agg(F.min("at").alias("at")), limit, "qid", [F.asc("at")], "position").select("qid", "position", "id")


def first_hits(ranked: DataFrame) -> DataFrame:
    """Each id of a question once, at its first rank."""
    return ranked.groupBy("qid", "id").agg(F.min("rank").alias("rank"))


def retrieve(items: DataFrame, questions: DataFrame, embed=None, expansions: DataFrame | None = None, scorer=None, config: SearchConfig = SearchConfig(), vector_only: bool = False, on_fallback=lambda stage: None) -> DataFrame:
    """The whole plan of many questions (qid, text) at once over items (id, content, heading, speaker, embedding, and their place): (qid, position, id), with following chunks.

    Without `embed` (text column to vectors) BM25 answers. A question without expansions is answered by BM25 and vectors, in this order; one with
    expansions by vectors and BM25 for each variant. `scorer` reranks. A step that fails gives way: expansions to the question alone, a search to BM25 of the question,
    a reranking to the order before it; on_fallback hears the step's name. Each step is computed once, to find its failure, and kept for the next.
    """

    def done(df: DataFrame) -> DataFrame:
        kept = df.persist()
        kept.count()
        return kept

    def attempt(stage: str, build, otherwise) -> DataFrame:
        try:
            return done(build())
        except Exception:  # noqa: BLE001  any failure of a provider or a search gives way to the plainer plan
            on_fallback(stage)
            return otherwise()

    plain = lambda: bm25(items, questions, config.seeds, config.heading_weight, config.speaker_weight).select("qid", "id", "rank")
    follow = lambda ranked: expand_following(ranked.where(F.col("rank") <= config.seeds), items.select("id", "workspace_id", "source_id", "section_id", "sequence"), config.seeds, config.expanded)
    if embed is None:
        on_fallback("unconfigured")
        return follow(plain())
    alone = lambda: questions.select("qid", F.lit(0).alias("variant"), "text")
    variants = alone() if expansions is None else attempt("query_expansion", lambda: search_queries(questions, expansions, config.expansions), alone)
    budget = config.candidate_limit(scorer is not None)

    def search() -> DataFrame:
        asked = variants.select("qid", "variant", F.concat_ws("/", F.col("qid").cast("string"), F.col("variant").cast("string")).alias("key"), "text")
        number = asked.groupBy(F.col("qid").alias("_qid")).agg(F.count("*").alias("_n"))
        searches = [(0, knn(items.select("id", "embedding"), asked.select(F.col("key").alias("qid"), embed(F.col("text")).alias("embedding")), budget, budget))]
        if not vector_only:
            searches.append((1, bm25(items, asked.select(F.col("key").alias("qid"), "text"), budget, config.heading_weight, config.speaker_weight)))
        place = lambda k: F.when(F.col("_n") == 1, 1 - k).otherwise(2 * F.col("variant") + k)
        lists = [found.select(F.col("qid").alias("key"), "id", "rank").join(asked.select("qid", "variant", "key"), "key").join(number, F.col("qid") == F.col("_qid")).select("qid", place(k).cast("int").alias("list_id"), "rank", "id") for k, found in searches]
        return fuse(reduce(DataFrame.unionByName, lists), budget if scorer is not None else config.seeds, config.rrf_k).select("qid", "id", F.col("position").alias("rank"))

    ranked = attempt("search", search, plain)
    if scorer is not None:
        ranked = attempt("reranking", lambda: rerank(ranked.where(F.col("rank") <= config.rerank_candidates), questions, items, config.rerank_limit, scorer).select("qid", "id", "rank"), lambda: ranked)
    return follow(ranked)
