"""Registered queries: text, pages, transcripts, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunking as K
from ..operators import embedding as E
from ..operators import index as I
from ..operators import ranking as R
from ..operators import transcripts as X
from ..operators.ingestion import ingest, visible_items
from ..operators.versions import VersionedTables
from ..sources.shared import new_path
from ..sources.tables import table


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalise_plain(F.col("text")).cast("binary"), 256).alias("text_sha256"))


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
NORMALIZE_SQL = (
    "select doc_id, sha256("
    + _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x0B\f]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
    + ") as text_sha256 from documents"
)


#: Line ends that the texts of `paragraphs` get in place of newlines, by doc_id: all kinds that a paragraph may be cut at.
_LINE_ENDS = ("\n", "\r\n", "\r", "\u0085", "\u2028", "\u2029", "\x0b", "\x0c")


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents as they are, and of each once more with its newlines made another kind of line end, doubled around a blank at every other of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ends = F.element_at(F.array(*[F.lit(e) for e in _LINE_ENDS]), (F.col("doc_id") % len(_LINE_ENDS) + 1).cast("int"))
    other = F.replace(F.replace(F.col("text"), F.lit("\n"), ends), F.concat(ends, F.lit("- ")), F.concat(ends, F.lit(" \t "), ends))
    both = docs.select("doc_id", F.lit(0).alias("form"), "text").unionByName(docs.select("doc_id", F.lit(1).alias("form"), F.replace(other, F.lit(". "), F.concat(F.lit("."), ends, F.lit(" "), ends)).alias("text")))
    rows = both.select("doc_id", "form", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.select("doc_id", "form", F.col("pos").cast("long").alias("pos"), "paragraph", T.is_heading(F.col("paragraph")).alias("heading"), T.heading_level(F.col("paragraph")).cast("int").alias("level"))


_SQL_ENDS = "[" + ", ".join(" || ".join(f"chr({ord(c)})" for c in e) for e in _LINE_ENDS) + "]"
_ANY_END = r"(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"
PARAGRAPHS_SQL = rf"""with ended as (select doc_id, text, {_SQL_ENDS}[doc_id % {len(_LINE_ENDS)} + 1] as e from documents),
forms as (select doc_id, 0 as form, text from ended union all select doc_id, 1, replace(replace(replace(text, chr(10), e), e || '- ', e || ' ' || chr(9) || ' ' || e), '. ', '.' || e || ' ' || e) from ended),
p as (select doc_id, form, list_filter(list_transform(regexp_split_to_array(text, '{_ANY_END}[ \t\n\x0B\f\r]*{_ANY_END}'), lambda x: {_TRIM.format('x')}), lambda x: regexp_matches(x, '[^\s\p{{Z}}]')) as ps from forms),
e as (select doc_id, form, unnest(ps) as paragraph, unnest(range(len(ps))) as pos from p)
select doc_id, form, pos, paragraph, regexp_matches(paragraph, '^[IVXLCDM]+\.$') or regexp_matches(paragraph, '^#{{1,6}}\s+[^\r\n]+$') or regexp_matches(paragraph, '(?i)^(chapter|section|part)\s+[\p{{L}}\d]+([.: —-].*)?$')
  or regexp_matches(paragraph, '^[IVXLCDM]+\. [A-Z][A-Z ’''—-]+$') as heading,
  case when starts_with(paragraph, '#') then least(6, length(regexp_extract(paragraph, '^(#+)', 1))) when regexp_matches(paragraph, '^[IVXLCDM]+\.$') or regexp_matches(paragraph, '(?i)^section\s+.*$') then 2 else 1 end::int as level from e"""


def html_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.is_html(F.lit(None).cast("string"), F.col("html")).alias("is_html"), T.is_html(F.lit("text/plain"), F.col("html")).alias("declared_plain"))


SNIFF_SQL = "select page_id, " + " or ".join(f"contains(lower(ltrim(substr(html, 1, 512))), '{m}')" for m in T.HTML_MARKERS) + " as is_html, false as declared_plain from pages"


def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    m = H.main_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", "m.title", F.size("m.blocks").alias("n_blocks"), F.sha2(F.array_join("m.blocks", "\n\n").cast("binary"), 256).alias("text_sha256"))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of the pages' markup, navigation too."""
    found = B.blocks(B.markup_events(table(spark, d, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), F.col("sequence").cast("long").alias("sequence"), "type", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "error_code")


_PLAIN = "replace(replace(replace(replace(replace(replace(t.token, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_ONE_LINE = rf"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(65279), ' '), '{_ANY_END}', chr(10), 'g'), '[\p{{Z}}\t\x0B\f]+', ' ', 'g'), ' *\n *', chr(10), 'g')"
BLOCKS_SQL = rf"""with recursive t as (select page_id, unnest(tokens) as token, unnest(range(len(tokens))) as seq from (select page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<![^>]*>|<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '<[^>]*>|[^<]+') as tokens from pages)),
b as (select * from (select page_id, seq, lower(regexp_extract(token, '^</?\s*([^\s>/]+)', 1)) as name, starts_with(token, '</') as ends from t where starts_with(token, '<')) where regexp_matches(name, '^(h[1-6]|p|li|tr)$')),
span as (select s.page_id, s.name, s.seq as a, e.seq as z from (select * from b where not ends) s asof join (select * from b where ends) e on s.page_id = e.page_id and s.name = e.name and s.seq < e.seq),
nexts as (select x.*, s.seq as following from span x asof left join (select * from b where not ends) s on x.page_id = s.page_id and x.z < s.seq),
chain as (select n.* from nexts n join (select page_id, min(seq) as a from b where not ends group by page_id) f using (page_id, a) union all select n.* from chain c join nexts n on n.page_id = c.page_id and n.a = c.following),
parts as (select c.page_id, c.a, c.name, t.seq, case when not starts_with(t.token, '<') then {_PLAIN} when c.name = 'tr' and regexp_matches(t.token, '(?i)^<(td|th)[\s>]') then chr(1) else '' end as part from chain c join t on t.page_id = c.page_id and t.seq between c.a and c.z),
whole as (select page_id, a, name, replace(regexp_replace(string_agg(part, '' order by seq), chr(1), ''), chr(1), ' | ') as text from parts group by page_id, a, name),
plain as (select page_id, 0, 'p', string_agg(case when starts_with(token, '<') then '' else {_PLAIN} end, '' order by seq) from t where page_id not in (select page_id from whole where regexp_matches(text, '[^\s\p{{Z}}]')) group by page_id),
clean as (select page_id, a, name, {_TRIM.format(rf"regexp_replace(regexp_replace({_ONE_LINE}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' *\| *', ' | ', 'g')")} as text from (from whole union all from plain))
select page_id, row_number() over (partition by page_id order by a) as sequence, case when name like 'h%' then 'HEADING' when name = 'li' then 'LIST_ITEM' when name = 'tr' then 'TABLE_ROW' else 'PARAGRAPH' end as type, sha256(text) as text_sha256, null as error_code
from clean where regexp_matches(text, '[^\s\p{{Z}}]')"""


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    return table(spark, d, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


URL_PARTS_SQL = r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages"


def _hosts() -> list[str]:
    return ["10.0.0.1", "172.20.1.1", "192.168.3.4", "127.0.0.1", "8.8.8.8", "169.254.1.1", "100.64.0.1", "localhost"]


def url_safety(spark: SparkSession, d: str) -> DataFrame:
    hosts = F.array(*[F.lit(h) for h in _hosts()])
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://"), F.element_at(hosts, (F.col("page_id") % 8 + 1).cast("int")), F.lit("/x"))).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.url_error(odd).alias("error"))


URL_SAFETY_SQL = "select page_id, case when page_id % 3 = 0 then case when page_id % 8 = 4 then null else 'address is not public' end when page_id % 3 = 1 then 'unsupported scheme' end as error from pages"


def youtube_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 11)
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), key)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), key)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), key, F.lit("?x=1"))).otherwise(F.concat(F.lit("http://youtube.com/watch?v="), key))
    return table(spark, d, "pages").select("page_id", T.youtube_id(url).alias("video_id"), T.youtube_url(url).alias("url"))


YOUTUBE_SQL = "select page_id, case when page_id % 4 < 3 then substr(md5(page_id::varchar), 1, 11) end as video_id, case when page_id % 4 < 3 then 'https://www.youtube.com/watch?v=' || substr(md5(page_id::varchar), 1, 11) end as url from pages"


def media_types(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("a.PNG", "b.jpeg", "c.mp4", "d.wav", "e", "f.exe")])
    name = F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.media_type(name).alias("media_type"), T.media_error(name, F.col("n_chars") * 1000, "image").alias("error"))


MEDIA_SQL = """select doc_id, case doc_id % 6 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'video/mp4' when 3 then 'audio/wav' end as media_type,
case when n_chars <= 0 then 'file is empty' when n_chars * 1000 > 10485760 then 'file is too large' when doc_id % 6 > 1 then 'unsupported file type' end as error from documents"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("position"), (F.col("turn") * 61_500).alias("start_ms"), (F.col("turn") * 61_500 + 1234).alias("end_ms"), F.col("role").alias("speaker"), "text")


def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    return X.transcript_chunks(_turns(spark, d)).withColumn("sequence", F.col("sequence").cast("long"))


TRANSCRIPT_SQL = rf"""select conv_id as source_id, row_number() over (partition by conv_id order by turn) as sequence, {_TRIM.format('text')} as content, 'Audio transcript' as heading, 'transcript' as section_id, turn * 61500 as start_ms, turn * 61500 + 1234 as end_ms, role as speaker
from conversations where regexp_matches(text, '[^\s\p{{Z}}]')"""


def transcript_render(spark: SparkSession, d: str) -> DataFrame:
    return X.render_transcript(_turns(spark, d))


_TIME = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
RENDER_SQL = rf"""select conv_id as source_id, string_agg('[' || {_TIME.format('(turn * 61500)')} || ' - ' || {_TIME.format('(turn * 61500 + 1234)')} || '] ' || role || ': ' || {_TRIM.format('text')}, chr(10) order by turn) as content, count(*) as n_segments
from conversations where regexp_matches(text, '[^\s\p{{Z}}]') group by conv_id"""


def embedding_input_hash(spark: SparkSession, d: str) -> DataFrame:
    x = I.embedding_input(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(x.cast("binary"), 256).alias("content_hash"))


INPUT_SQL = "select doc_id, sha256(lang || chr(10) || chr(10) || case when doc_id % 2 = 0 then 'Speaker: ' || source || chr(10) || chr(10) else '' end || text) as content_hash from documents"


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    u = R.unit(F.col("embedding"))
    return e.select("vec_id", E.vector_error(F.col("embedding"), 64).alias("error"), F.round(F.element_at(u, 1), 6).alias("first"), F.round(F.sqrt(R.dot(u, u)), 6).alias("norm"))


VECTOR_SQL = """with v as (select vec_id, embedding::double[] as e from embeddings)
select vec_id, null::varchar as error, round(e[1] / sqrt(list_inner_product(e, e)), 6) as first, 1.0::double as norm from v"""


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    p = E.mean_pool(table(spark, d, "embeddings"), "label")
    return p.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


POOL_SQL = """with e as (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings), m as (select label, dim, avg(x) as x from e group by all), n as (select label, sqrt(sum(x * x)) as n from m group by label)
select label, dim, round(x / n, 6) as x from m join n using (label)"""


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = E.windows_by_characters(F.col("text"), E.PASSAGE, 512)
    return table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("pos", "win")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("win").cast("long").alias("n"), F.md5(F.col("win").cast("binary")).alias("md5"))


WINDOWS_SQL = """with w as (select doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 503 + 1)) as pos from documents)
select doc_id, pos, length('passage: ' || substr(text, pos * 503 + 1, 503)) as n, md5('passage: ' || substr(text, pos * 503 + 1, 503)) as md5 from w"""


def chunk_simple(spark: SparkSession, d: str) -> DataFrame:
    c = K.group_sentences(table(spark, d, "documents"), r"[.?!]+\s+")
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


CHUNK_SQL = rf"""with s as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.?!]+\s+'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as s from documents),
e as (select doc_id, unnest(s) as t, unnest(range(len(s))) as i from s) select doc_id, i // 5 as chunk, md5(string_agg(t, ' ' order by i)) as content_md5 from e group by doc_id, i // 5"""


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole chunker over the documents' texts."""
    return K.chunk_text(table(spark, d, "documents")).select("doc_id", "sequence", "section_id", "heading", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the pages' main text, whose headings make sections."""
    blocks = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), H.main_text(F.col("html")).alias("m")).select("doc_id", F.posexplode("m.blocks").alias("sequence", "text"))
    kind = F.when(F.col("text").startswith("# "), "HEADING").when(F.col("text").startswith("- "), "LIST_ITEM").otherwise("PARAGRAPH")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("page_number", "int"), ("slide_number", "int"), ("sheet_name", "string"))]
    c = K.chunk_blocks(blocks.select("doc_id", "sequence", kind.alias("type"), "text", *nothing))
    return c.select(F.col("doc_id").alias("page_id"), "sequence", "section_id", "heading", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def ingested_items(spark: SparkSession, d: str) -> DataFrame:
    """Visible items and quarantined sources after one ingestion: conversations as transcripts, documents as descriptions (kinds whose items SQL can tell), pages under a kind that no path takes."""
    turn = F.struct("turn", F.struct("text", (F.col("turn") * 10).cast("string").alias("start"), (F.col("turn") * 10 + 5).cast("string").alias("end"), F.col("role").alias("speaker")).alias("s"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    named = lambda df, id_, mark, kind, body: df.select(F.lit("w").alias("workspace_id"), F.concat(F.lit(mark), F.col(id_).cast("string")).alias("source_id"), F.lit(kind).alias("kind"), F.lit("file").alias("name"), body.alias("body"))
    sources = named(talks, "conv_id", "c", "AUDIO", F.to_json(F.struct(F.transform("turns", lambda t: t["s"]).alias("segments"))))
    sources = sources.unionByName(named(table(spark, d, "documents"), "doc_id", "d", "IMAGE", F.col("text"))).unionByName(named(table(spark, d, "pages"), "page_id", "p", "BOOKMARK", F.col("html")))
    tables = VersionedTables(spark, new_path(spark, "ingested"))
    ingest(tables, sources, "g1")
    items = visible_items(tables).select("source_id", "id", "source_type", F.col("sequence").cast("long").alias("sequence"), "speaker", "start_ms", "content_hash", F.lit(None).cast("string").alias("error_code"))
    return items.unionByName(tables.read("errors").select("source_id", "error_code"), allowMissingColumns=True)


INGESTED_SQL = rf"""with turns as (select conv_id, row_number() over (partition by conv_id order by turn) as sequence, role, turn * 10000 as start_ms, {_TRIM.format('text')} as content from conversations where regexp_matches(text, '[^\s\p{{Z}}]'))
select 'c' || conv_id as source_id, 'c' || conv_id || ':g1:' || sequence as id, 'audio' as source_type, sequence, role as speaker, start_ms, sha256('Audio transcript' || chr(10) || chr(10) || 'Speaker: ' || role || chr(10) || chr(10) || content) as content_hash, null as error_code from turns
union all select 'd' || doc_id, 'd' || doc_id || ':g1:0', 'images', null, null, null, sha256({_TRIM.format('text')}), null from documents where regexp_matches(text, '[^\s\p{{Z}}]') and length(text) <= 1000000
union all select 'd' || doc_id, null, null, null, null, null, null, case when length(text) > 1000000 then 'EXTRACTION_LIMIT_EXCEEDED' else 'EMPTY' end from documents where text is null or not regexp_matches(text, '[^\s\p{{Z}}]') or length(text) > 1000000
union all select 'p' || page_id, null, null, null, null, null, null, 'UNSUPPORTED_TYPE' from pages"""


QUERIES = {
    "ingested_items": ingested_items,
    "normalize_text": normalize_text, "paragraphs": paragraphs, "html_sniff": html_sniff, "html_main_text": html_main_text, "page_blocks": page_blocks, "url_parts": url_parts, "url_safety": url_safety, "youtube_ids": youtube_ids, "media_types": media_types,
    "transcript_chunks": transcript_chunks, "transcript_render": transcript_render, "embedding_input_hash": embedding_input_hash, "vector_normalize": vector_normalize, "mean_pool": mean_pool, "token_windows": token_windows,
    "chunk_simple": chunk_simple, "chunk_documents": chunk_documents, "chunk_pages": chunk_pages,
}
SQL = {
    "ingested_items": INGESTED_SQL,
    "normalize_text": NORMALIZE_SQL, "paragraphs": PARAGRAPHS_SQL, "html_sniff": SNIFF_SQL, "page_blocks": BLOCKS_SQL, "url_parts": URL_PARTS_SQL, "url_safety": URL_SAFETY_SQL, "youtube_ids": YOUTUBE_SQL, "media_types": MEDIA_SQL, "transcript_chunks": TRANSCRIPT_SQL,
    "transcript_render": RENDER_SQL, "embedding_input_hash": INPUT_SQL, "vector_normalize": VECTOR_SQL, "mean_pool": POOL_SQL, "token_windows": WINDOWS_SQL, "chunk_simple": CHUNK_SQL,
}
