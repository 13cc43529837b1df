"""Registered queries: search, fusion, expansion, visibility, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import index as I
from ..operators import jobs as J
from ..operators import ranking as R
from ..operators.postings import PostingsIndex
from ..operators.vector_index import build
from ..sources.shared import new_path
from ..sources.tables import table

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_HEADING = "split_part(text, chr(10), 1)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bm25_sql(field: str, name: str, weight: float = 1.0) -> str:
    """Common table expressions that end in {name}(qid, id, score)."""
    return rf"""
{name}_t as (select doc_id as id, {_TOKENS.format(field)} as t from documents), {name}_d as (select id, t, len(t) as dl from {name}_t where len(t) > 0),
{name}_p as (select id, dl, term, count(*) as tf from (select id, dl, unnest(t) as term from {name}_d) where term in (select term from qt) group by all),
{name}_f as (select term, count(*) as df from {name}_p group by term), {name}_s as (select count(*) as n, avg(dl) as avgdl from {name}_d),
{name} as (select qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * {weight} as score from qt join {name}_f using (term) join {name}_p using (term), {name}_s group by qid, id)"""


_QT = rf"qt as (select distinct item_id as qid, unnest({_TOKENS.format('text')}) as term from benchmark)"
_TOP = "row_number() over (partition by qid order by score desc, id)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("heading"), F.lit(None).cast("string").alias("speaker"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _lexical(spark: SparkSession, d: str, limit: int = 12, heading: float | None = None) -> DataFrame:
    return R.bm25(_documents(spark, d), _questions(spark, d), limit, heading)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = _lexical(spark, d)
    return R.with_items(top, _documents(spark, d)).select("qid", "id", F.col("rank").cast("long").alias("rank"), "score", T.snippet(F.col("content")).alias("snippet"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


_BM25_TOP = f"with {_QT}, {_bm25_sql('text', 'b')}, top as (select * from (select qid, id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, id) as rank from b) where rank <= 12)"
BM25_SQL = f"{_BM25_TOP} select qid, id, rank, score, substr(text, 1, 500) as snippet, sha256(text) as content_sha256 from top join documents on doc_id = id"


def bm25_multifield_best(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 12, 2.0).select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


_MULTI = f"{_bm25_sql('text', 'b')}, {_bm25_sql(_HEADING, 'h', 2.0)}, best as (select qid, id, round(max(score), 6) as score from (select * from b union all select * from h) group by qid, id)"
MULTI_SQL = f"with {_QT}, {_MULTI} select * from (select qid, id, score, {_TOP} as rank from best) where rank <= 12"


def _postings(spark: SparkSession, d: str, weights: dict[str, float]) -> DataFrame:
    index = PostingsIndex(spark, new_path(spark, "postings")).add(_documents(spark, d), tuple(weights))
    return index.search(_questions(spark, d), 12, weights).select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The lists of bm25_topk from a postings index over all documents, whose blocks below the questions' floors stay unread."""
    return _postings(spark, d, {"content": 1.0})


def bm25_indexed_multifield(spark: SparkSession, d: str) -> DataFrame:
    """The lists of bm25_multifield_best from the same index over two fields."""
    return _postings(spark, d, {"content": 1.0, "heading": 2.0})


INDEXED_SQL = f"{_BM25_TOP} select qid, id, rank, score from top"


def _vectors(spark: SparkSession, d: str, limit: int, where: str | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return R.knn(items.where(where) if where else items, q, limit)


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 12).select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 12, "label = 1").select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


def _indexed(spark: SparkSession, d: str, where: str | None = None, recall: float | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    index = build(e.select(F.col("vec_id").alias("id"), "embedding", "label"), new_path(spark, "vector-index"), keep=("label",))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = index.search(q, 12, where=where, exact=True) if recall is None else index.search(q, 12, probe=index.probes_for(recall), where=where)
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


def knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The lists of knn_topk from an inverted-file index over all vectors: eight cells first, then every cell that may still hold a better one."""
    return _indexed(spark, d)


def knn_indexed_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same with a filter that the index applies to its rows."""
    return _indexed(spark, d, "label = 1")


def knn_indexed_near(spark: SparkSession, d: str) -> DataFrame:
    """Near lists: as many cells as the exact lists of 64 vectors need for a recall of 0.95. A test measures what these lists reach."""
    return _indexed(spark, d, recall=0.95)


def _knn_sql(where: str) -> str:
    u = "list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[])))"
    return f"""with v as (select vec_id, label, {u} as e from embeddings), s as (select q.vec_id as qid, x.vec_id as id, round(list_inner_product(x.e, q.e), 6) as score from v x, v q where q.vec_id % 50 = 0 and {where})
select qid, id, rank, score from (select *, {_TOP} as rank from s) where rank <= 12"""


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _lexical(spark, d, 100), _lexical(spark, d, 100, 2.0)


def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    return R.hybrid(a, b, 12, 30).select("qid", F.col("position").cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


_LISTS = f"""with {_QT}, {_MULTI}, one as (select qid, id, rank from (select qid, id, row_number() over (partition by qid order by round(score, 6) desc, id) as rank from b) where rank <= 100),
two as (select qid, id, rank from (select qid, id, {_TOP} as rank from best) where rank <= 100)"""


def _fused(lists: str) -> str:
    return f"""{_LISTS}, lists as ({lists}), f as (select qid, id, round(sum(1 / (30.0 + rank)), 9) as score, min(list_id * 100000 + rank) as met from lists group by qid, id)
select qid, position, id, round(score, 6) as score from (select *, row_number() over (partition by qid order by score desc, met) as position from f) where position <= 12"""


RRF_SQL = _fused("select qid, id, rank, 0 as list_id from one union all select qid, id, rank, 1 from two")


def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    vector = b.withColumn("variant", F.lit(0)).select("qid", "variant", "rank", "id")
    lexical = a.withColumn("variant", F.lit(0)).select("qid", "variant", "rank", "id")
    return R.expanded(lexical, vector, 12, 30).select("qid", F.col("position").cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


RRF_MULTI_SQL = _fused("select qid, id, rank, 0 as list_id from two union all select qid, id, rank, 1 from one")


def query_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each question with itself in capitals (A-Z only: engines differ in other letters) and with its start."""
    q = _questions(spark, d)
    more = q.select("qid", F.lit(0).alias("pos"), F.translate("text", _LOWER, _UPPER).alias("text")).unionByName(q.select("qid", F.lit(1).alias("pos"), F.concat(F.lit("  "), F.substring("text", 1, 40)).alias("text")))
    return R.search_queries(q, more).select("qid", F.col("variant").cast("long").alias("variant"), "text")


QUERY_DEDUP_SQL = rf"""with e as (select item_id as qid, -1 as pos, text from benchmark union all select item_id, 0, translate(text, '{_LOWER}', '{_UPPER}') from benchmark union all select item_id, 1, '  ' || substr(text, 1, 40) from benchmark),
c as (select qid, pos, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as text from e), f as (select *, row_number() over (partition by qid, lower(text) order by pos) as n from c where text <> '')
select qid, row_number() over (partition by qid order by pos) - 1 as variant, text from f where n = 1"""


def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_lexical(spark, d, 100), _questions(spark, d), _documents(spark, d)).select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


RERANK_SQL = rf"""{_LISTS}, s as (select qid, one.id, rank as old_rank, round(len(list_intersect(list_distinct({_TOKENS.format('q.text')}), {_TOKENS.format('x.text')})) / len(list_distinct({_TOKENS.format('q.text')}))::double, 6) as score
from one join benchmark q on q.item_id = qid join documents x on x.doc_id = one.id)
select qid, id, rank, score from (select *, row_number() over (partition by qid order by score desc, old_rank) as rank from s) where rank <= 12"""


def expand_following(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    items = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("w").alias("workspace_id"), F.col("conv_id").alias("source_id"), F.lit("0").alias("section_id"), F.col("turn").alias("sequence"))
    seeds = items.withColumn("qid", F.col("source_id") % 10).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sequence"), "id"))).where("rank <= 12").select("qid", "id", "rank")
    return R.expand_following(seeds, items).select("qid", F.col("position").cast("long").alias("position"), "id")


EXPAND_SQL = """with i as (select distinct conv_id * 1000 + turn as id, conv_id, turn from conversations), s as (select * from (select conv_id % 10 as qid, id, conv_id, turn, row_number() over (partition by conv_id % 10 order by turn desc, id) as rank from i) where rank <= 12),
b as (select qid, id, 2 * rank as at_ from s union all select s.qid, i.id, 2 * rank + 1 from s join i on i.conv_id = s.conv_id and i.turn = s.turn + 1), m as (select qid, id, min(at_) as at_ from b group by qid, id)
select qid, position, id from (select *, row_number() over (partition by qid order by at_) as position from m) where position <= 24"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items of sources, a third each without a generation, of g1 and of g2."""
    g = F.when(F.col("doc_id") % 3 == 1, "g1").when(F.col("doc_id") % 3 == 2, "g2")
    x = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("w").alias("workspace_id"), F.col("source").alias("source_id"), g.alias("generation"), I.source_generation(F.col("source"), g).alias("source_generation"), "lang",
        F.element_at(F.create_map(*[F.lit(v) for v in ("en", "documents", "fr", "audio", "de", "images", "es", "videos")]), F.col("lang")).alias("source_type"), F.col("text").alias("content"),
        F.timestamp_seconds(F.col("doc_id") % 7).alias("created_at"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5).alias("chunk_sequence"),
    )
    return x


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the sources publish g1, with as many items as they have when their number is even."""
    c = _items(spark, d).where("generation = 'g1'").groupBy("source_id").agg(F.count("*").alias("n"))
    return c.where("source_id <= 'src15'").select("source_id", F.lit("w").alias("workspace_id"), F.lit("g1").alias("active_generation"), F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1).alias("expected_items"))


_ITEMS_SQL = """items as (select doc_id as id, source as source_id, case doc_id % 3 when 1 then 'g1' when 2 then 'g2' end as generation, lang, case lang when 'en' then 'documents' when 'fr' then 'audio' when 'de' then 'images' when 'es' then 'videos' end as source_type,
  text as content, doc_id % 7 as created, case when doc_id % 5 > 0 then doc_id % 5 end as chunk_sequence from documents),
manifests as (select source_id, 'g1' as active_generation, case when n % 2 = 0 then n else n + 1 end as expected_items from (select source_id, count(*) as n from items where generation = 'g1' group by source_id) where source_id <= 'src15')"""


def visible_items(spark: SparkSession, d: str) -> DataFrame:
    return I.visible(_items(spark, d), _manifests(spark, d), "w").select("id", "source_id", "generation")


VISIBLE_SQL = f"""with {_ITEMS_SQL} select id, source_id, generation from items i where (generation is not null and exists (select 1 from manifests m where m.source_id = i.source_id and m.active_generation = i.generation))
or (generation is null and not exists (select 1 from manifests m where m.source_id = i.source_id))"""


def index_completeness(spark: SparkSession, d: str) -> DataFrame:
    return I.completeness(_items(spark, d), _manifests(spark, d))


COMPLETE_SQL = f"""with {_ITEMS_SQL}, c as (select source_id, generation, count(*) as n from items where generation is not null group by all)
select m.source_id, active_generation, expected_items::bigint as expected_items, coalesce(n, 0)::bigint as indexed_items, coalesce(n, 0) = expected_items as complete from manifests m left join c on c.source_id = m.source_id and c.generation = m.active_generation"""


def pruned_items(spark: SparkSession, d: str) -> DataFrame:
    return I.prune(_items(spark, d), _manifests(spark, d)).select("id", "source_id", "generation")


PRUNE_SQL = f"with {_ITEMS_SQL} select id, i.source_id, generation from items i left join manifests m on m.source_id = i.source_id where m.source_id is null or generation = active_generation"


def workspace_scan(spark: SparkSession, d: str) -> DataFrame:
    return I.scan(_items(spark, d)).select("id", "source_id", "chunk_sequence")


SCAN_SQL = f"with {_ITEMS_SQL} select id, source_id, chunk_sequence from items order by created, source_id nulls last, chunk_sequence nulls last, id limit 1000"


def workspace_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each source's items in spans of two seconds, as fingerprints of whole texts."""
    x = _items(spark, d).withColumn("workspace_id", F.col("source_id"))
    k = I.workspace_knowledge(x, 2)
    return k.select("workspace_id", "span", *[F.sha2(F.col(c).cast("binary"), 256).alias(c) for c in I.SOURCE_TYPES.values()])


_PART = "sha256(string_agg(content, chr(10) || chr(10) order by created, source_id nulls last, chunk_sequence nulls last, id) filter (where source_type = '{0}')) as {0}"
KNOWLEDGE_SQL = f"with {_ITEMS_SQL} select source_id as workspace_id, created // 2 as span, {', '.join(_PART.format(k) for k in ('documents', 'audio', 'images', 'videos'))} from items where regexp_matches(content, '[^\\s\\p{{Z}}]') group by source_id, created // 2"


def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    new = x.where("id % 4 = 0").select("id", F.upper("value").alias("value")).unionByName(x.where("id % 50 = 0").select((-F.col("id") - 1).alias("id"), "value"))
    return I.upsert(x, new)


UPSERT_SQL = "select doc_id as id, case when doc_id % 4 = 0 then upper(lang) else lang end as value from documents union all select -doc_id - 1, lang from documents where doc_id % 50 = 0"


def _cited(spark: SparkSession, d: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("documents").alias("source_type"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_id"), F.col("source").alias("source_name"), F.col("lang").alias("job_id"),
        none("string").alias("source_url"), F.lit("0").alias("section_id"), F.substring_index("text", "\n", 1).alias("heading"), none("string").alias("speaker"), F.lit("2024-01-01").alias("created_at"), none("long").alias("start_ms"), none("long").alias("end_ms"),
        (F.col("doc_id") % 9).alias("page_number"), none("int").alias("slide_number"), none("string").alias("sheet_name"),
    )
    return R.with_items(_lexical(spark, d).drop("score"), docs)


_KEY = "case when doc_id % 2 = 0 then 'documents:' || source else 'documents:' || source || ':' || lang end"


def citation_snippets(spark: SparkSession, d: str) -> DataFrame:
    return C.citations(_cited(spark, d)).select("qid", F.col("rank").cast("long").alias("rank"), "id", "file_key", "name", "location", "snippet")


SNIPPETS_SQL = f"{_BM25_TOP} select qid, rank, id, {_KEY} as file_key, source as name, 'page ' || doc_id % 9 as location, substr(text, 1, 500) as snippet from top join documents on doc_id = id"


def citation_files(spark: SparkSession, d: str) -> DataFrame:
    return C.source_files(C.citations(_cited(spark, d))).select("qid", "file_key", F.col("first_rank").cast("long").alias("first_rank"), "name", "first_id", "citations")


FILES_SQL = f"{_BM25_TOP} select qid, {_KEY} as file_key, min(rank) as first_rank, arg_min(source, rank) as name, arg_min(id, rank) as first_id, count(*) as citations from top join documents on doc_id = id group by qid, {_KEY}"


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    return C.context(_cited(spark, d))


_LINES = " || chr(10) || ".join(["'Evidence ' || rank", "'Source type: documents'", "'Source name: ' || source", "'Source id: ' || case when doc_id % 2 = 0 then source else '(empty)' end", "'Job id: ' || lang", "'URL: (empty)'", "'Chunk: ' || id", "'Section: 0'",
    r"'Heading: ' || case when regexp_matches(split_part(text, chr(10), 1), '[^\s\p{Z}]') then split_part(text, chr(10), 1) else '(empty)' end", "'Location: page ' || doc_id % 9", "'Speaker: (empty)'", "'Created: 2024-01-01'", r"'Content: ' || case when regexp_matches(text, '[^\s\p{Z}]') then text else '(empty)' end"])
CONTEXT_SQL = f"{_BM25_TOP} select qid, string_agg({_LINES}, chr(10) || chr(10) order by rank) as context, count(*) as n_items from top join documents on doc_id = id group by qid"


def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """A question's right passages are the documents that hold its text."""
    top = _lexical(spark, d, 12)
    held = R.with_items(top, _documents(spark, d)).join(_questions(spark, d), "qid").withColumn("right", F.contains(F.col("content"), F.col("text")))
    best = held.groupBy("qid").agg(F.min(F.when(F.col("right"), F.col("rank"))).alias("rank")).withColumn("run", F.lit("bm25"))
    out = J.hits(best)
    return out.select("run", *[F.round(f"hit_at_{k}", 6).alias(f"hit_at_{k}") for k in (1, 3, 8)], "questions")


HIT_SQL = f"""{_BM25_TOP}, found as (select qid, min(case when contains(x.text, q.text) then rank end) as rank from top join documents x on doc_id = id join benchmark q on item_id = qid group by qid)
select 'bm25' as run, {", ".join(f"round(avg(coalesce((rank <= {k})::int, 0)), 6) as hit_at_{k}" for k in (1, 3, 8))}, count(*) as questions from found"""

QUERIES = {
    "bm25_topk": bm25_topk, "bm25_multifield_best": bm25_multifield_best, "bm25_indexed": bm25_indexed, "bm25_indexed_multifield": bm25_indexed_multifield, "knn_topk": knn_topk, "knn_filtered": knn_filtered, "knn_indexed": knn_indexed, "knn_indexed_filtered": knn_indexed_filtered, "knn_indexed_near": knn_indexed_near, "rrf_two_lists": rrf_two_lists, "rrf_multi_query": rrf_multi_query, "query_dedup": query_dedup,
    "rerank_overlap": rerank_overlap, "expand_following": expand_following, "visible_items": visible_items, "index_completeness": index_completeness, "pruned_items": pruned_items, "workspace_scan": workspace_scan,
    "workspace_knowledge": workspace_knowledge, "upsert_replace": upsert_replace, "citation_snippets": citation_snippets, "citation_files": citation_files, "answer_context": answer_context, "hit_at_k": hit_at_k,
}
SQL = {
    "bm25_topk": BM25_SQL, "bm25_multifield_best": MULTI_SQL, "bm25_indexed": INDEXED_SQL, "bm25_indexed_multifield": MULTI_SQL, "knn_topk": _knn_sql("true"), "knn_filtered": _knn_sql("x.label = 1"), "knn_indexed": _knn_sql("true"), "knn_indexed_filtered": _knn_sql("x.label = 1"), "rrf_two_lists": RRF_SQL, "rrf_multi_query": RRF_MULTI_SQL, "query_dedup": QUERY_DEDUP_SQL,
    "rerank_overlap": RERANK_SQL, "expand_following": EXPAND_SQL, "visible_items": VISIBLE_SQL, "index_completeness": COMPLETE_SQL, "pruned_items": PRUNE_SQL, "workspace_scan": SCAN_SQL,
    "workspace_knowledge": KNOWLEDGE_SQL, "upsert_replace": UPSERT_SQL, "citation_snippets": SNIPPETS_SQL, "citation_files": FILES_SQL, "answer_context": CONTEXT_SQL, "hit_at_k": HIT_SQL,
}
