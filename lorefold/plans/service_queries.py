"""Registered queries: rules on texts and requests, provider answers, the store's changes, and the whole retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..operators import citations as C
from ..operators import embedding as E
from ..operators import index as I
from ..operators import jobs as J
from ..operators import ranking as R
from ..operators import transcripts as X
from ..sources.tables import table

_BLANK = r"not coalesce(regexp_matches({}, '[^\s\p{{Z}}]'), false)"
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_TIME = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def normalize_blocks(spark: SparkSession, d: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return _documents(spark, d).select("doc_id", sha(T.normalise_block(F.col("text"))).alias("block"), sha(T.normalise_line(F.col("text"))).alias("line"))


_R = r"'\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'"
BLOCKS_SQL = rf"""with a as (select doc_id, replace(text, chr(65279), ' ') as t from documents),
b as (select doc_id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_R}, chr(10), 'g'), '[\p{{Z}}\t\x0B\f]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' *\| *', ' | ', 'g') as x from a)
select doc_id, sha256({_TRIM.format('x')}) as block, sha256({_TRIM.format(r"regexp_replace(t, '[\p{Z}\s\x0B]+', ' ', 'g')")}) as line from b"""


def decode_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in four encodings, with marks or a declared charset, decoded again."""
    text, k = F.col("text"), F.col("doc_id") % 4
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode(text, c))
    body = F.when(k == 0, mark("EFBBBF", "UTF-8")).when(k == 1, mark("FFFE", "UTF-16LE")).when(k == 2, mark("FEFF", "UTF-16BE")).otherwise(F.encode(text, "UTF-16LE"))
    return _documents(spark, d).select("doc_id", F.sha2(T.decode_bytes(body, F.when(k == 3, "utf-16le")).cast("binary"), 256).alias("text_sha256"))


DECODE_SQL = "select doc_id, sha256(text) as text_sha256 from documents"


def location_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    k, n = F.col("turn") % 5, F.col("turn").cast("int")
    start, end = F.when(k < 2, F.col("turn") * 61_500), F.when(k == 0, F.col("turn") * 61_500 + 1234)
    page, slide, sheet = F.when(k == 2, n), F.when(k == 3, n), F.when(k == 4, F.col("role"))
    return c.select("conv_id", "turn", T.location(start, end, page, slide, sheet).alias("location"), C.location_label(page, start, end, F.col("role")).alias("label"), T.media_range_error(start - 61_500, F.when(k < 4, F.col("turn") * 1000)).alias("error"))


_A, _B = _TIME.format("(turn * 61500)"), _TIME.format("(turn * 61500 + 1234)")
LABELS_SQL = f"""select conv_id, turn, case turn % 5 when 0 then {_A} || ' - ' || {_B} when 1 then {_A} when 2 then 'page ' || turn when 3 then 'slide ' || turn else 'sheet ' || role end as location,
case turn % 5 when 0 then 'Time ' || {_A} || '–' || {_B} || ' · ' when 1 then 'Time ' || {_A} || ' · ' when 2 then 'Page ' || turn || ' · ' else '' end || role as label,
case when turn % 5 < 2 and turn * 61500 - 61500 < 0 then 'start is negative' when turn % 5 in (2, 3) then 'end needs a start' when turn % 5 < 2 and turn * 1000 < turn * 61500 - 61500 then 'end is before start' end as error from conversations"""


def request_rules(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    email = F.when(k == 0, F.concat(F.lit(" User"), n, F.lit("@Example.com "))).when(k == 1, F.concat(n, F.lit("@x@y"))).when(k == 2, "  ").when(k == 3, F.concat(F.repeat(F.lit("a"), 330), F.lit("@b"))).otherwise(F.concat(n, F.lit("@")))
    password = F.when(k == 0, F.concat(F.lit("password"), F.lpad(n, 8, "0"))).when(k == 1, "short").when(k == 2, F.repeat(F.lit("é"), 40)).when(k == 3, "")
    return _documents(spark, d).select(
        "doc_id", T.email_error(email).alias("email_error"), T.password_error(password).alias("password_error"), T.question_error(F.col("text")).alias("question_error"), T.audit_token(F.col("text"), 20).alias("token"), T.fingerprint(F.col("text")).alias("fingerprint"),
        T.error_text(F.when(k > 0, F.col("text")), F.lit("SomeError")).alias("error_text"), T.length_prefixed_digest([F.col("source"), F.when(k > 0, F.col("lang"))]).alias("digest"),
    )


RULES_SQL = rf"""select doc_id, case doc_id % 5 when 2 then 'email is required' when 3 then 'email is too long' when 0 then null else 'email is invalid' end as email_error,
case doc_id % 5 when 1 then 'password is too short' when 2 then 'password is too long' when 0 then null else 'password is required' end as password_error,
case when {_BLANK.format('text')} then 'question is required' when length({_TRIM.format('text')}) > 4000 then 'question is too long' end as question_error,
substr(regexp_replace(text, '[^A-Za-z0-9_.\-]', '_', 'g'), 1, 20) as token, substr(sha256(text), 1, 24) as fingerprint, case when doc_id % 5 > 0 and not ({_BLANK.format('text')}) then substr(text, 1, 1000) else 'SomeError' end as error_text,
sha256(unhex(printf('%08X', strlen(source))) || encode(source) || case when doc_id % 5 > 0 then unhex(printf('%08X', strlen(lang))) || encode(lang) else unhex('FFFFFFFF') end) as digest from documents"""


def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as the JSON of transcription, video and answer providers, and read again."""
    c, n = table(spark, d, "conversations"), F.col("turn")
    segment = F.struct(F.concat(F.lit(" "), F.col("text")).alias("text"), F.concat(n.cast("string"), F.lit(".5")).alias("start"), F.concat(F.lit("0:00:"), n.cast("string")).alias("end"), F.col("role").alias("speaker"))
    video = F.struct(F.col("role").alias("summary"), F.array(F.struct((n * -1.0).alias("startMs"), (n * 10.0).alias("endMs"), F.col("text").alias("description"))).alias("segments"))
    parts = F.array(F.struct(F.col("role").alias("text")), F.struct(F.col("text").alias("text")))
    answer = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))
    heard, seen = X.parse_transcript(F.to_json(F.struct(F.array(segment).alias("segments")))), X.parse_video(F.to_json(video))
    one, two = F.get(heard, F.lit(0)), F.get(seen["segments"], F.lit(0))
    return c.select("conv_id", "turn", one["start_ms"].alias("start_ms"), one["end_ms"].alias("end_ms"), F.md5(one["text"].cast("binary")).alias("heard"), seen["summary"].alias("summary"), two["start_ms"].alias("low"), two["end_ms"].alias("high"), F.md5(X.parse_answer(F.to_json(answer)).cast("binary")).alias("answer"), F.md5(X.ocr_text(parts).cast("binary")).alias("regions"))


ANSWERS_SQL = rf"""select conv_id, turn, case when b then null else turn * 1000 + 500 end as start_ms, case when b then null else turn * 1000 + 500 end as end_ms, case when not b then md5({_TRIM.format('text')}) end as heard, role as summary,
case when not b then 0::bigint end as low, case when not b then turn * 10 end as high, md5({_TRIM.format('role || text')}) as answer, md5(role || chr(10) || text) as regions from (select *, {_BLANK.format('text')} as b from conversations)"""


def rendered_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sequence"), F.when(F.col("role") == "user", "HEADING").otherwise("PARAGRAPH").alias("type"), "text", F.expr("cast(turn div 3 as int)").alias("page_number"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("string").alias("sheet_name"))
    out = K.render_blocks(blocks, 3000)
    return out.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"), "error_code")


RENDERED_SQL = rf"""with b as (select *, turn // 3 as page from conversations where not ({_BLANK.format('text')})),
l as (select *, case when page is distinct from lag(page) over (partition by conv_id order by turn) then '[Page ' || page || ']' || chr(10) || chr(10) else '' end || case when role = 'user' then '# ' else '' end || text as line from b),
t as (select conv_id as doc_id, string_agg(line, chr(10) || chr(10) order by turn) as content from l group by conv_id)
select doc_id, case when length(content) <= 3000 then md5(content) end as content, case when length(content) > 3000 then 'EXTRACTION_LIMIT_EXCEEDED' end as error_code from t"""


def merged_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks of pages; pages of system turns show nothing, and take the text of their OCR."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sequence"), F.col("turn").alias("page_number"), "text")
    blank = F.col("page_number") % 3 == 0
    blocks = c.withColumn("text", F.when(blank, "***").otherwise(F.col("text")))
    ocr = c.select("doc_id", "page_number", F.concat(F.lit("ocr "), F.col("page_number").cast("string")).alias("text"))
    m = X.merge_ocr(blocks, c.select("doc_id", "page_number").distinct(), ocr)
    return m.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "page_number", F.md5(F.col("text").cast("binary")).alias("text"))


OCR_SQL = r"""with b as (select conv_id, turn, turn % 3 = 0 or not regexp_matches(text, '[\p{L}\p{Nd}]') as bare, case when turn % 3 = 0 then '***' else text end as t from conversations),
p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from (select conv_id, turn from b group by conv_id, turn having bool_and(bare))),
u as (select conv_id, turn, turn as s, t from b union all select conv_id, turn, 1 << 30, 'ocr ' || turn from p where n <= 50)
select conv_id as doc_id, row_number() over (partition by conv_id order by turn, s) as sequence, turn as page_number, md5(t) as text from u"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(F.lit("w").alias("workspace_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("sequence"), F.concat(F.lit("  "), F.col("text")).alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ").alias("heading"), F.lit(None).cast("string").alias("speaker"))


def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents as items of a generation, and an update of each source's fields beside them."""
    items = I.items_of_chunks(_chunks(spark, d), "g1")
    more = _chunks(spark, d).groupBy("workspace_id", "source_id").agg(F.lit("a note").alias("content"))
    return I.append_fields(items, more).select("id", "source_generation", "heading", "content_hash", F.col("sequence").isNull().alias("whole"))


_CONTENT = _TRIM.format("text")
INGEST_SQL = rf"""select source || ':g1:' || doc_id as id, source || ':g1' as source_generation, case when doc_id % 2 = 0 then lang end as heading, sha256(case when doc_id % 2 = 0 then lang || chr(10) || chr(10) else '' end || {_CONTENT}) as content_hash, false as whole
from documents where not ({_BLANK.format('text')}) union all select source || ':0', null, null, sha256('a note'), true from (select distinct source from documents)"""


def tolerant_read(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    hits = _documents(spark, d).select("doc_id", F.when(k > 0, F.col("text")).alias("content"), F.when(k > 1, "w").alias("workspace_id"), F.when(k == 3, "audio").otherwise("what").alias("source_type"), F.when(k > 2, F.timestamp_seconds("doc_id")).alias("created_at"))
    return I.from_hits(hits).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"), "workspace_id", "source_type", F.unix_timestamp("created_at").alias("created"))


HITS_SQL = "select doc_id, md5(case when doc_id % 4 > 0 then text else '' end) as content, case when doc_id % 4 > 1 then 'w' else '' end as workspace_id, case when doc_id % 4 = 3 then 'audio' else 'documents' end as source_type, case when doc_id % 4 > 2 then doc_id else 0 end as created from documents"


def replaced_source(spark: SparkSession, d: str) -> DataFrame:
    """One source's rows replaced, another's and a whole workspace deleted."""
    x = _documents(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "other").otherwise("w").alias("workspace_id"), F.col("source").alias("source_id"))
    new = x.where("source_id = 'src1' and workspace_id = 'w'").withColumn("id", -F.col("id"))
    return I.delete_workspace(I.delete_source(I.replace_source(x, new, "w", "src1"), "w", "src2"), "other")


REPLACE_SQL = "select case when source = 'src1' then -doc_id else doc_id end as id, 'w' as workspace_id, source as source_id from documents where doc_id % 10 <> 0 and source <> 'src2'"


def stored_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed files of texts, and the sources whose bytes are there: every third file is lost, every fifth source is an address."""
    docs = _documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    files = I.stored_files(docs)
    sources = files.select(F.col("path").cast("long").alias("doc_id"), "sha256", "size_bytes", F.when(F.col("path").cast("long") % 5 > 0, F.concat_ws("/", "path", "storage_key")).alias("storage_key"))
    return I.content_exists(sources, sources.where("doc_id % 3 > 0 and storage_key is not null")).select("doc_id", "sha256", "size_bytes", "content_exists")


BYTES_SQL = "select doc_id, sha256(text) as sha256, strlen(text)::bigint as size_bytes, doc_id % 5 = 0 or doc_id % 3 > 0 as content_exists from documents"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DOCUMENT", "AUDIO", "IMAGE", "VIDEO", "WEB_PAGE", "YOUTUBE")]), (F.col("doc_id") % 6 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("UPLOADED", "PROCESSING", "PROCESSED", "FAILED")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("workspace_id"), kind.alias("source_type"), status.alias("status"), F.timestamp_seconds("doc_id").alias("created_at"), F.when(F.col("doc_id") % 7 == 0, F.timestamp_seconds(F.lit(1))).alias("deleted_at"))


_SOURCES = """s as (select doc_id, doc_id::varchar as id, source as workspace_id, ['DOCUMENT', 'AUDIO', 'IMAGE', 'VIDEO', 'WEB_PAGE', 'YOUTUBE'][doc_id % 6 + 1] as source_type, ['UPLOADED', 'PROCESSING', 'PROCESSED', 'FAILED'][doc_id % 4 + 1] as status, doc_id % 7 = 0 as deleted from documents)"""


def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """A conditional change of status, then a soft delete, of a few sources; those of a workspace that are left are marked."""
    ids = [str(k) for k in range(60)]
    x = J.soft_delete(J.compare_and_set(_sources(spark, d), ids, ["UPLOADED", "FAILED"], "PROCESSING"), ids[:20], F.timestamp_seconds(F.lit(9)))
    left = J.sources_of(x, "src1").select("id").withColumn("listed", F.lit(True))
    one = J.source_of(x, "src1", "21").select("id").withColumn("single", F.lit(True))
    return x.join(left, "id", "left").join(one, "id", "left").select("id", "status", "changed", F.unix_timestamp("deleted_at").alias("deleted"), F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("single", F.lit(False)).alias("single"))


CHANGED_SQL = f"""with {_SOURCES}, c as (select *, doc_id < 60 and status in ('UPLOADED', 'FAILED') and not deleted as changed, doc_id < 20 and not deleted as dropped from s)
select id, case when dropped then 'DELETED' when changed then 'PROCESSING' else status end as status, changed, case when deleted then 1 when dropped then 9 end::bigint as deleted, workspace_id = 'src1' and not deleted and not dropped as listed, workspace_id = 'src1' and id = '21' and not deleted and not dropped as single from c"""


def requested_sources(spark: SparkSession, d: str) -> DataFrame:
    """Requests of sources, split and gathered by job, with the content type of each."""
    asked = _sources(spark, d).select(F.expr("cast(id as long) div 5").alias("job_id"), F.when(F.col("id").cast("long") % 11 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("source_id"))
    split = J.split_request(_sources(spark, d), asked)
    ids = F.transform(F.map_entries("source_ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return split.join(J.source_ids(split), "job_id", "left").select("job_id", "source_id", "content_type", "decision", F.coalesce(F.array_join(ids, ","), F.lit("")).alias("source_ids"))


REQUESTED_SQL = f"""with {_SOURCES}, a as (select doc_id // 5 as job_id, case when doc_id % 11 = 0 then 'x' || id else id end as source_id from s),
j as (select job_id, source_id, case source_type when 'DOCUMENT' then 'documents' when 'WEB_PAGE' then 'documents' when 'AUDIO' then 'audio' when 'IMAGE' then 'images' when 'VIDEO' then 'videos' when 'YOUTUBE' then 'videos' end as content_type, case when status is not null and status <> 'PROCESSING' then 'SUBMITTED' else 'SKIPPED' end as decision
  from a left join s on s.id = a.source_id and not s.deleted),
g as (select job_id, string_agg(content_type || '=' || low, ',' order by content_type) as ids from (select job_id, content_type, min(source_id) as low from j where decision = 'SUBMITTED' group by all) group by job_id)
select job_id, source_id, content_type, decision, coalesce(ids, '') as source_ids from j left join g using (job_id)"""


def claimed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What tasks do with their jobs' steps, whether their sources may be submitted, and their leases after a reset."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "SCHEDULED").when(k % 3 == 1, "RUNNING").otherwise("COMPLETED")
    tasks = e.select(k.alias("source_id"), k.alias("job_id"), status.alias("status"), F.when(k % 2 == 0, k * 10).alias("lease_expires_at"), k.cast("string").alias("claim_token"))
    steps = e.where("event_id % 5 > 0").select(k.alias("job_id"), F.when(k % 4 < 2, "PENDING").when(k % 4 == 2, "RUNNING").otherwise("FAILED").alias("status"))
    now = F.lit(5000)
    out = J.pending_jobs(tasks, steps, now).join(J.submission_guard(tasks, now), "source_id").join(J.reset_leases(tasks).select("source_id", "lease_expires_at", "claim_token"), "source_id")
    return out.select("source_id", "action", "may_submit", "lease_expires_at", "claim_token")


CLAIMED_SQL = """with t as (select event_id as k, case event_id % 3 when 0 then 'SCHEDULED' when 1 then 'RUNNING' else 'COMPLETED' end as status, case when event_id % 2 = 0 then event_id * 10 end as lease,
  case when event_id % 5 > 0 then case when event_id % 4 < 2 then 'PENDING' when event_id % 4 = 2 then 'RUNNING' else 'FAILED' end end as step from events)
select k as source_id, case when step = 'PENDING' then 'REUSE' when step = 'RUNNING' and coalesce(lease > 5000, false) then 'KEEP' when step = 'RUNNING' then 'FAIL_STALE' else 'NEW' end as action,
  not (status = 'SCHEDULED' or (status = 'RUNNING' and coalesce(lease > 5000, false))) as may_submit, case when status <> 'RUNNING' then lease end as lease_expires_at, case when status <> 'RUNNING' then k::varchar end as claim_token from t"""


def deleted_sources(spark: SparkSession, d: str) -> DataFrame:
    return J.delete_plan(_sources(spark, d)).select("source_id", F.col("position").cast("long").alias("position"), "step")


DELETED_SQL = f"""with {_SOURCES} select id as source_id, position, step from (select id, unnest(case when status = 'PROCESSING' then ['REFUSE'] else ['KNOWLEDGE', 'ASSERT_LEASE', 'BYTES', 'METADATA'] end) as step,
  unnest(range(case when status = 'PROCESSING' then 1 else 4 end)) as position from s where not deleted)"""


def owned_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Orders as workspaces of their customers, those of one owner, with the lines that survive their deletion, in the order of types."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("cast(o_custkey % 10 as string)").alias("owner_id"), F.col("o_orderdate").alias("created_at"))
    mine = I.owned(o, "3")
    kinds = F.element_at(F.array(*[F.lit(c) for c in J.CONTENT_TYPES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("line"), kinds.alias("content_type"))
    return J.ordered_steps(J.surviving(lines, mine.select(F.col("id").alias("job_id")), "job_id"))


OWNED_SQL = "select l_orderkey as job_id, l_linenumber::bigint as line, ['documents', 'audio', 'images', 'videos'][l_linenumber % 4 + 1] as content_type from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey % 10 = 3)"


def indexed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a manifest that counts their items, and others with any item."""
    items = _documents(spark, d).select(F.lit("w").alias("workspace_id"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, F.concat_ws(":", "source", F.lit("g1"))).alias("source_generation"), F.col("doc_id").alias("id"))
    m = items.where("source_id < 'src5' and source_generation is not null").groupBy("source_id").agg(F.lit("w").alias("workspace_id"), F.lit("g1").alias("active_generation"), (F.count("*") + F.when(F.col("source_id") == "src10", 1).otherwise(0)).alias("expected_items"))
    sources = items.select("workspace_id", "source_id").distinct().unionByName(items.select(F.lit("v").alias("workspace_id"), "source_id").distinct())
    return I.has_knowledge(sources, items, m)


INDEXED_SQL = "select w as workspace_id, source as source_id, case when source < 'src5' and even then w = 'w' and source <> 'src10' else w = 'w' end as has_knowledge from (select source, bool_or(doc_id % 2 = 0) as even from documents group by source), (select unnest(['w', 'v']) as w)"


def best_configuration(spark: SparkSession, d: str) -> DataFrame:
    """The best of runs whose hits are shares of the customers' balances."""
    share = lambda k: F.round(F.avg((F.col("c_custkey") % k == 0).cast("double")), 4)
    runs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ordinal")).agg(share(5).alias("hit_at_1"), share(3).alias("hit_at_3"), share(2).alias("hit_at_5"))
    return J.best_run(runs.withColumn("run", F.concat(F.lit("run"), F.col("ordinal").cast("string"))).select("run", F.col("ordinal").cast("long").alias("ordinal"), "hit_at_1", "hit_at_3", "hit_at_5"))


BEST_SQL = """with r as (select c_nationkey::bigint as ordinal, round(avg((c_custkey % 5 = 0)::int::double), 4) as hit_at_1, round(avg((c_custkey % 3 = 0)::int::double), 4) as hit_at_3, round(avg((c_custkey % 2 = 0)::int::double), 4) as hit_at_5 from customer group by c_nationkey)
select 'run' || ordinal as run, * from r order by hit_at_1 desc, hit_at_3 desc, hit_at_5 desc, ordinal limit 1"""


def speaker_search(spark: SparkSession, d: str) -> DataFrame:
    """Turns as items, searched for the name of their role and for the first words of conversations; results are unique by question."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("heading"), F.col("role").alias("speaker")).dropDuplicates(["id"])
    q = spark.sql("select 1L as qid, 'user' as text union all select 2L, 'assistant' union all select 3L, 'user assistant'")
    return R.first_hits(R.bm25(c, q, 12, None, 2.0)).select("qid", "id", F.col("rank").cast("long").alias("rank"))


SPEAKER_SQL = r"""with i as (select conv_id * 1000 + turn as id, any_value(text) as text, any_value(role) as role from conversations group by all), q as (select * from (values (1, 'user'), (2, 'assistant'), (3, 'user assistant')) as q(qid, t)),
qt as (select distinct qid, unnest(string_split(t, ' ')) as term from q), t as (select id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from i), dd as (select id, t, len(t) as dl from t where len(t) > 0), p as (select id, dl, term, count(*) as tf from (select id, dl, unnest(t) as term from dd) where term in (select term from qt) group by all),
f as (select term, count(*) as df from p group by term), s as (select count(*) as n, avg(dl) as a from dd), b as (select qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))) as score from qt join f using (term) join p using (term), s group by qid, id),
k as (select qid, id, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 * 2.0 as score from i join (select role, count(*) as df from i group by role) using (role) join q on q.t = role, (select count(role) as n from i)),
m as (select qid, id, round(max(score), 6) as score from (select * from b union all select * from k) group by qid, id)
select qid::bigint as qid, id, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from m) where rank <= 12"""


def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors joined to their items, all or none."""
    e = table(spark, d, "embeddings")
    out = I.embedded(e.select(F.col("vec_id").alias("id"), "label"), e.select(F.col("vec_id").alias("id"), "embedding"), 64)
    return out.select("id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


EMBEDDED_SQL = "select vec_id as id, label, round(embedding[1]::double, 6) as first from embeddings"


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark question through the whole plan: an expansion, BM25 and vectors, fusion, reranking, following chunks."""
    docs = _documents(spark, d)
    embed = E.hashed_words()
    items = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("heading"), F.lit(None).cast("string").alias("speaker"), embed(F.col("text")).alias("embedding"), F.lit("w").alias("workspace_id"), F.col("source").alias("source_id"), F.lit("0").alias("section_id"), F.col("doc_id").alias("sequence"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    more = q.where("qid % 2 = 0").select("qid", F.lit(0).alias("pos"), F.substring("text", 1, 60).alias("text"))
    return R.retrieve(items, q, embed, more, R.overlap_score).select("qid", F.col("position").cast("long").alias("position"), "id")


QUERIES = {
    "normalize_blocks": normalize_blocks, "decode_texts": decode_texts, "location_labels": location_labels, "request_rules": request_rules, "provider_answers": provider_answers, "rendered_blocks": rendered_blocks, "merged_ocr": merged_ocr,
    "ingest_chunks": ingest_chunks, "tolerant_read": tolerant_read, "replaced_source": replaced_source, "stored_bytes": stored_bytes, "changed_sources": changed_sources, "requested_sources": requested_sources, "claimed_tasks": claimed_tasks,
    "deleted_sources": deleted_sources, "owned_workspaces": owned_workspaces, "indexed_sources": indexed_sources, "best_configuration": best_configuration, "speaker_search": speaker_search, "embedded_items": embedded_items, "retrieve": retrieve,
}
SQL = {
    "normalize_blocks": BLOCKS_SQL, "decode_texts": DECODE_SQL, "location_labels": LABELS_SQL, "request_rules": RULES_SQL, "provider_answers": ANSWERS_SQL, "rendered_blocks": RENDERED_SQL, "merged_ocr": OCR_SQL,
    "ingest_chunks": INGEST_SQL, "tolerant_read": HITS_SQL, "replaced_source": REPLACE_SQL, "stored_bytes": BYTES_SQL, "changed_sources": CHANGED_SQL, "requested_sources": REQUESTED_SQL, "claimed_tasks": CLAIMED_SQL,
    "deleted_sources": DELETED_SQL, "owned_workspaces": OWNED_SQL, "indexed_sources": INDEXED_SQL, "best_configuration": BEST_SQL, "speaker_search": SPEAKER_SQL, "embedded_items": EMBEDDED_SQL,
}
