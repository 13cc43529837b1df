"""Facts of the chunker, the pages, fusion, visibility, expansion, leases and the sinks, on small inline rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorefold.functions import html
from lorefold.functions import text as T
from lorefold.functions.html import html_blocks
from lorefold.operators import chunking as K
from lorefold.operators import embedding as E
from lorefold.operators import index as I
from lorefold.operators import jobs as J
from lorefold.operators import ranking as R
from lorefold.operators import transcripts as X

BLOCK = "doc_id long, sequence int, type string, text string, page_number int, slide_number int, sheet_name string"


def chunks(spark, blocks, most=5):
    return K.chunk_blocks(spark.createDataFrame(blocks, BLOCK), most).orderBy("doc_id", "sequence").collect()


def test_six_sentences_make_two_chunks_of_one_section(spark):
    text = "One is here. Two met Dr. Smith. Three ran. Four sat. Five slept. Six woke."
    got = chunks(spark, [(1, 1, "PARAGRAPH", text, None, None, None)])
    assert [c.content for c in got] == ["One is here. Two met Dr. Smith. Three ran. Four sat. Five slept.", "Six woke."]
    assert len({c.section_id for c in got}) == 1


def test_a_long_sentence_stays_whole(spark):
    text = "word " * 4000
    assert [c.content for c in chunks(spark, [(1, 1, "PARAGRAPH", text, None, None, None)])] == [text.strip()]


def test_a_page_change_closes_the_chunk_but_not_the_section(spark):
    got = chunks(spark, [(1, 1, "PARAGRAPH", "A first one.", 1, None, None), (1, 2, "PARAGRAPH", "A second one.", 1, None, None), (1, 3, "PARAGRAPH", "A third one.", 2, None, None)])
    assert [(c.content, c.page_number) for c in got] == [("A first one.\n\nA second one.", 1), ("A third one.", 2)]
    assert len({c.section_id for c in got}) == 1


def test_headings_open_sections(spark):
    got = chunks(spark, [(1, 1, "PARAGRAPH", "# Top", None, None, None), (1, 2, "PARAGRAPH", "Some text.", None, None, None), (1, 3, "PARAGRAPH", "# Next", None, None, None), (1, 4, "PARAGRAPH", "More text.", None, None, None)])
    assert len({c.section_id for c in got if "text" in c.content}) == 2
    assert all(c.heading for c in got if "text" in c.content)


def test_chunker_refuses_no_sentences_and_takes_no_rows(spark):
    with pytest.raises(ValueError):
        K.chunk_blocks(spark.createDataFrame([], BLOCK), 0)
    assert chunks(spark, []) == []
    assert chunks(spark, [(1, 1, "PARAGRAPH", None, None, None, None), (1, 2, "PARAGRAPH", " \n ", None, None, None)]) == []


def test_page_text_prefers_the_article_and_joins_table_cells():
    title, blocks = html_blocks("<title>T</title><nav>menu</nav><article><h2>Head</h2><p>Body &amp; soul<p>Next<table><tr><td>a<td>b</table><ul><li>one<li>two</ul></article><footer>end</footer>")
    assert title == "T"
    assert blocks == ["# Head", "Body & soul", "Next", "a | b", "- one", "- two"]


@pytest.mark.parametrize("html", [None, "", "<", "<div><p>", "plain words"])
def test_odd_pages(html):
    title, blocks = html_blocks(html)
    assert title == "" and blocks in ([], ["plain words"], ["<"])


def test_fusion_counts_an_item_once_a_list_and_prefers_support(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "c"), (1, 1, 2, "b"), (1, 1, 3, "b")], "qid long, list_id int, rank int, id string")
    assert [r.id for r in R.fuse(lists, 3, 60).orderBy("position").collect()] == ["b", "a", "c"]
    for limit, k in ((0, 60), (3, 0)):
        with pytest.raises(ValueError):
            R.fuse(lists, limit, k)
    assert R.fuse(lists.limit(0), 3, 60).isEmpty()


def test_search_config_refuses_bad_budgets():
    for bad in ({"seeds": 0}, {"heading_weight": 0.0}, {"expansions": 5}, {"rerank_limit": 13}):
        with pytest.raises(ValueError):
            R.SearchConfig(**bad)
    assert R.SearchConfig(seeds=12, candidates=8).candidate_limit() == 12


def test_expansion_puts_each_follower_behind_its_seed(spark):
    items = spark.createDataFrame([(f"i{k}", "w", "s", "0", k) for k in range(6)], "id string, workspace_id string, source_id string, section_id string, sequence int")
    seeds = spark.createDataFrame([(1, "i3", 1), (1, "i1", 2), (1, "i4", 3)], "qid long, id string, rank int")
    assert [r.id for r in R.expand_following(seeds, items).orderBy("position").collect()] == ["i3", "i4", "i1", "i2", "i5"]


def test_generations_show_only_when_published_and_prune_after(spark, tmp_path):
    items = spark.createDataFrame([(f"s:g{g}:{k}", "w", "s", f"g{g}", f"s:g{g}") for g in (1, 2) for k in range(2)] + [("old", "w", "s", None, None), ("free", "w", "t", None, None)], "id string, workspace_id string, source_id string, generation string, source_generation string")
    none = spark.createDataFrame([], "source_id string, workspace_id string, active_generation string, expected_items int")
    assert sorted(r.id for r in I.visible(items, none, "w").collect()) == ["free", "old"]
    m = I.publish(none, "s", "w", "g2", 2)
    assert sorted(r.id for r in I.visible(items, m, "w").collect()) == ["free", "s:g2:0", "s:g2:1"]
    assert sorted(r.id for r in I.prune(items, m).collect()) == ["free", "s:g2:0", "s:g2:1"]
    assert I.completeness(items, m).first().complete
    one = items.where("generation = 'g1'")
    I.stage_generation(one, str(tmp_path), "s", "g1", 2)
    for bad in ((one, 3), (items, 6)):
        with pytest.raises(ValueError):
            I.stage_generation(bad[0], str(tmp_path), "s", "g1", bad[1])


def test_delete_responses_are_checked():
    I.check_delete({"failures": []})
    for bad in ({"timed_out": True}, {"failures": ["x"]}, {"failures": "x"}):
        with pytest.raises(RuntimeError):
            I.check_delete(bad)


def test_history_is_appended_and_read_newest_first(spark, tmp_path):
    a = spark.createDataFrame([(k, "w", k, f"text {k}") for k in range(3)], "id long, workspace_id string, created_at long, answer string")
    I.append_history(a, str(tmp_path / "h"))
    got = I.read_history(spark.read.parquet(str(tmp_path / "h")), "w", "answer string", 2).collect()
    assert [r.answer.answer for r in got] == ["text 2", "text 1"]


def test_leases_fence_stale_tokens(spark):
    e = [("k", 0, 1, "start", "a"), ("k", 10, 2, "start", "b"), ("k", 2000, 3, "start", "b"), ("k", 2001, 4, "complete", "a"), ("k", 2002, 5, "complete", "b")]
    r = J.fold_leases(spark.createDataFrame(e, "key string, ts long, seq long, event string, token string")).first()
    assert (r.status, r.attempts, r.token, r.conflicts) == ("COMPLETED", 2, None, 2)


def test_backoff_doubles_up_to_the_most(spark):
    rows = spark.range(0, 9).select(J.backoff(F.col("id")).alias("s")).collect()
    assert [r.s for r in rows] == [30, 30, 60, 120, 240, 480, 900, 900, 900]


@pytest.mark.parametrize("status, want", [(["SKIPPED"], "COMPLETED"), (["COMPLETED", "SKIPPED"], "COMPLETED"), (["FAILED", "FAILED"], "FAILED"), (["FAILED", "COMPLETED"], "PARTIALLY_FAILED"), (["FAILED", "PENDING"], "RUNNING")])
def test_roll_up(spark, status, want):
    steps = spark.createDataFrame([(1, s, None) for s in status], "job_id long, status string, completed_at timestamp")
    assert J.job_rollup(steps).first().status == want


def test_windows_join_to_the_text_and_refuse_no_room():
    text = "one two three four five six seven"
    got = E.split_windows("p: ", text, 10, len)
    assert "".join(w.removeprefix("p: ") for w in got) == text and all(len(w) <= 10 for w in got)
    with pytest.raises(ValueError):
        E.split_windows("much too long: ", text, 10, len)


def test_transcripts_are_parsed_tolerantly(spark):
    body = '{"segments": [{"text": " a ", "start": "1.5", "end": "1.0", "speaker": "S"}, {"text": " "}, {"text": "b", "timestamps": {"from": "00:00:02,250", "to": "x"}}]}'
    r = spark.createDataFrame([(body,), ("not json",), (None,)], "b string").select(X.parse_transcript(F.col("b")).alias("s")).collect()
    assert [tuple(x) for x in r[0].s] == [(1500, 1500, "S", "a"), (2250, 2250, None, "b")]
    assert not r[1].s and not r[2].s


def test_states_fold_alike_in_one_span_and_in_many(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 3).alias("key"), "ts", F.col("event_id").alias("seq"), F.expr("case event_id % 3 when 0 then 'start' when 1 then 'complete' else 'fail' end").alias("event"))
    one, many = (sorted(map(tuple, J.fold_states(events, span_events=n).collect())) for n in (1 << 40, 7))
    assert one == many and len(one) == 3
    status, moves, refused = "UPLOADED", 0, 0
    for r in sorted(events.where("key = 0").collect(), key=lambda r: (r.ts, r.seq)):
        to = J.MOVES.get((status, r.event))
        status, moves, refused = to or status, moves + (to is not None), refused + (to is None)
    assert one[0] == (0, status, moves, refused)
    assert J.fold_states(events.limit(0)).isEmpty()


def test_files_are_told_by_their_bytes(spark):
    ole = bytes.fromhex("D0CF11E0A1B11AE1") + b"\x00"
    files = [(b"%PDF-1.7", "pdf"), (b"PK\x03\x04..word/document.xml", "wordprocessingml.document"), (b"PK\x03\x04..xl/workbook.xml", "spreadsheetml.sheet"), (b"PK\x03\x04..x", "zip"), (ole + "Workbook".encode("utf-16-le"), "ms-excel"), (b"words", "plain"), (b"a\x00b", None), (b"", None), (None, None)]
    got = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(files)], "i int, b binary").select("i", T.sniffed_type(F.col("b")).alias("t")).orderBy("i").collect()
    assert all(r.t is None if want is None else r.t.endswith(want) for r, (_, want) in zip(got, files, strict=True))


def test_document_errors_in_their_order(spark):
    rows = [(b"", None, None, False, False), (b"x", "image/png", "x", False, False), (b"x", "application/pdf", "x", True, True), (b"x", "application/pdf", None, False, True), (b"x", "text/plain", "x" * 11, False, False), (b"x", "text/plain", " ", False, False), (b"x", "text/plain", None, False, False), (b"x", "text/plain", "ok", False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b binary, t string, x string, locked boolean, failed boolean")
    got = [r.e for r in df.select("i", T.document_error(F.col("b"), F.col("t"), F.col("x"), F.col("locked"), F.col("failed"), 10).alias("e")).orderBy("i").collect()]
    assert got == ["EMPTY_DOCUMENT", "UNSUPPORTED_DOCUMENT_FORMAT", "PASSWORD_PROTECTED_DOCUMENT", "CORRUPT_DOCUMENT", "EXTRACTION_LIMIT_EXCEEDED", "NO_EXTRACTABLE_TEXT", "NO_EXTRACTABLE_TEXT", None]


def test_headings_are_conservative(spark):
    yes = {"IV.": 2, "# One line": 1, "### Three": 3, "Chapter 1": 1, "section two: more": 2, "Part A. the end": 1, "II. THE SECOND": 1, "Part of it all": 1}
    no = ["MIX", "I", "# a line\nand a second", "Part of it\nand more", "IV. ÉTÉ 2", "#none", "A short line"]
    rows = spark.createDataFrame([(x,) for x in [*yes, *no]], "t string").select("t", T.is_heading(F.col("t")).alias("h"), T.heading_level(F.col("t")).alias("level")).collect()
    assert {r.t: r.level for r in rows if r.h} == yes


def test_heading_paths_keep_the_marks_and_pop_by_size(spark):
    texts = ["I. FIRST STORY", "I.", "Text one.", "## A", "## B", "Text two."]
    got = chunks(spark, [(1, k, "PARAGRAPH", t, None, None, None) for k, t in enumerate(texts)])
    assert [(c.heading, c.content) for c in got] == [
        ("I. FIRST STORY", "I. FIRST STORY"), ("I. FIRST STORY > I.", "Text one."), ("I. FIRST STORY > ## A", "I. FIRST STORY > ## A"), ("I. FIRST STORY > ## B", "Text two."),
    ]


def test_deep_pages_are_read():
    deep = "<div>" * 100_000 + "<p>in <b>it</b></p>" + "</div>" * 100_000
    assert html_blocks(deep) == ("", ["in it"])
    assert html_blocks("<main><div><article><p>a</article></div></main><article><p>b</article>")[1] == ["a"]


def test_declared_types_decide(spark):
    rows = spark.createDataFrame([("TEXT/HTML", "x"), ("text/html; charset=utf-8", "<html>"), ("", "<html>"), (None, " <HTML>"), (None, "x")], "c string, b string")
    assert [r[0] for r in rows.select(T.is_html(F.col("c"), F.col("b"))).collect()] == [True, False, False, True, False]


def test_literal_addresses_must_be_public(spark):
    bad = ["[::1]", "[::]", "[fd00::1]", "[fe80::1]", "[fec0::1]", "[ff02::1]", "[2001:db8::1]", "[::ffff:10.0.0.1]", "10.1.2.3", "a.localhost"]
    good = ["[2606:4700::1111]", "[::ffff:8.8.8.8]", "8.8.8.8", "example.org"]
    rows = spark.createDataFrame([(f"http://{h}/x",) for h in [*bad, *good]], "u string").select("u", T.url_error(F.col("u")).alias("e")).collect()
    assert [r.e is not None for r in rows] == [True] * len(bad) + [False] * len(good)


def test_too_many_seeds_and_wrong_vectors_are_errors(spark):
    items = spark.createDataFrame([("i", "w", "s", "0", 1)], "id string, workspace_id string, source_id string, section_id string, sequence int")
    with pytest.raises(Exception, match="12 seeds"):
        R.expand_following(spark.createDataFrame([(1, "i", 13)], "qid long, id string, rank int"), items).collect()
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="2 dimensions"):
        R.knn(vectors, spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 1, 1, 2).collect()
    with pytest.raises(ValueError):
        R.knn(vectors, vectors.withColumnRenamed("id", "qid"), 5, 4)
    got = R.knn(vectors, vectors.withColumnRenamed("id", "qid"), 5).collect()
    assert sorted((r.qid, r.id, r.score) for r in got) == [(1, 1, 1.0), (3, 3, 1.0)]
    with pytest.raises(Exception, match="no single vector"):
        I.embedded(vectors.select("id"), vectors.where("id = 1"), 2).collect()


def test_matrices_and_joins_score_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring("text", 1, 30).alias("heading"), F.col("source").alias("speaker"))
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("qid"), "text").limit(15).unionByName(spark.createDataFrame([(-1, "src1"), (-2, None), (-3, "!?")], "qid long, text string"))
    found = lambda: sorted((r.qid, r.rank, r.id, round(r.score, 4)) for r in R.bm25(docs, q, 7, 2.0, 2.0).collect())
    by_matrix = found()
    monkeypatch.setattr(R, "MATRIX_TERMS", 0)
    assert by_matrix == found() and any(r[0] == -1 for r in by_matrix)


def test_retrieval_degrades_step_by_step(spark):
    items = spark.createDataFrame([(f"i{k}", t, None, None, [float(k), 1.0], "w", "s", "0", k) for k, t in enumerate(["red cat", "blue dog", "red dog", "green bird"])], "id string, content string, heading string, speaker string, embedding array<double>, workspace_id string, source_id string, section_id string, sequence int")
    q = spark.createDataFrame([(1, "red dog"), (2, "bird")], "qid long, text string")
    more = spark.createDataFrame([(2, 0, "green")], "qid long, pos int, text string")
    heard = []
    run = lambda **kw: [(r.qid, r.id) for r in R.retrieve(items, q, on_fallback=heard.append, **kw).orderBy("qid", "position").collect()]
    plain = run()
    assert plain[0] == (1, "i2") and (2, "i3") in plain and heard == ["unconfigured"]
    broken = lambda c: F.raise_error(c)
    heard.clear()
    assert run(embed=broken) == plain and heard == ["search"]
    vector = lambda c: F.when(F.contains(c, F.lit("dog")), F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(3.0), F.lit(1.0)))
    heard.clear()
    whole = run(embed=vector, expansions=more, scorer=R.overlap_score)
    assert heard == [] and whole[0] == (1, "i2") and {i for k, i in whole if k == 2} == {"i0", "i1", "i2", "i3"}
    assert run(embed=vector, expansions=more, scorer=lambda a, b: F.raise_error(a)) and heard == ["reranking"]
    heard.clear()
    bad = more.withColumn("text", F.raise_error("text"))
    assert run(embed=vector, expansions=bad) and heard == ["query_expansion"]


def test_causes_decide_by_the_first_that_is_known(spark):
    rows = [(["RuntimeException", "IOException"], 1), (["IllegalArgumentException", "IOException"], 1), (["IOException"], 5), ([], 1), (None, 1)]
    got = J.retry_decision(spark.createDataFrame(rows, "causes array<string>, attempt_count int")).collect()
    assert [r.outcome for r in got] == ["RETRY", "DEAD", "DEAD", "DEAD", "DEAD"] and got[0].delay_s == 30


def test_sentences_after_titles_and_initials():
    assert K.split_sentences("Dr.\n  Who came. J. R. Smith left. He met É. Zola.") == ["Dr.\n  Who came.", "J. R. Smith left.", "He met É.", "Zola."]
    assert K.split_sentences("By Jean-J. Rousseau. xJ. Then more.") == ["By Jean-J. Rousseau. xJ.", "Then more."]
    assert K.split_sentences(" \n ") == []


def test_best_keeps_its_types_and_bounds():
    """Blocks that add nothing don't change the type of ids, whatever their place; lists equal those of sorting all scores."""
    best = R.Best(2)
    big = 2**60
    best.add(pa.array([1, 2]), np.array([[-np.inf], [-np.inf]]))
    best.add(pa.array([big + 1, big, 3]), np.array([[2.0], [2.0], [1.0]]))
    best.add(pa.array([4]), np.array([[0.5]]))
    (rows,) = best.rows(np.array([7]))
    assert rows.schema.field("id").type == pa.int64() and rows.column("id").to_pylist() == [big, big + 1]
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((3000, 40)), 2)
    best, step = R.Best(12), 97
    for at in range(0, 3000, step):
        best.add(pa.array([f"{i:05d}" for i in range(at, min(3000, at + step))]), scores[at : at + step])
        assert best.waiting < max(R.MERGE_ROWS, 12 * 40)
    got = pa.Table.from_batches(best.rows(np.arange(40))).to_pylist()
    for q in range(40):
        order = np.lexsort((np.arange(3000), -scores[:, q]))[:12]
        assert [(r["id"], r["score"]) for r in got if r["qid"] == q] == [(f"{i:05d}", scores[i, q]) for i in order]


def test_rows_at_once_bound_the_cells():
    assert all(R.rows_at_once(n) * n <= max(R.CELLS, n) and 1 <= R.rows_at_once(n) <= R.ROWS for n in (0, 1, 200, 60_000, 10**8))


def test_pages_are_extracted_a_few_at_a_time(spark, monkeypatch):
    """A batch of any number of pages, with nulls and slices, gives each page's own blocks, and no more than PAGES of them are strings at once."""
    pages = [None, "", *(f"<title>t{i}</title><main><h1>a{i}</h1><p>b</p></main>" for i in range(2 * html.PAGES))]
    held = []
    monkeypatch.setattr(html, "html_blocks", lambda x: held.append(x) or html_blocks(x))
    got = html.extracted(pa.array(pages).slice(1))
    assert [(r["title"], r["blocks"]) for r in got.to_pylist()] == [html_blocks(x) for x in pages[1:]] and held == pages[1:]
    assert len(html.extracted(pa.array([], pa.string()))) == 0
    rows = spark.createDataFrame([(x,) for x in pages], "html string").select(html.main_text(F.col("html")).alias("m")).collect()
    assert [(r.m.title, r.m.blocks) for r in rows] == [html_blocks(x) for x in pages]


def _plain_chunks(blocks, most):
    """The chunker's rules on one document's (head, level, text, page) paragraphs, one at a time."""
    out, stack, section, run, last = [], [], 0, None, None
    for head, level, text, page in blocks:
        if run is None or head or page != last:
            run = {"head": head, "sentences": []}
            out.append(run)
        last = page
        if head:
            section, stack = section + 1, [*stack[: level - 1], text]
        run |= {"section": str(section), "path": " > ".join(stack) if stack else None, "page": page}
        for k, s in enumerate([] if head else K.split_sentences(text)):
            run["sentences"].append((k, s))
    rows = []
    for r in out:
        cut = [r["sentences"][at : at + most] for at in range(0, len(r["sentences"]), most)]
        texts = ["".join(("" if i == 0 else "\n\n" if k == 0 else " ") + s for i, (k, s) in enumerate(c)) for c in cut] or ([r["path"]] if r["head"] else [])
        rows += [(t, r["path"], r["section"], r["page"]) for t in texts]
    return rows


def test_chunks_equal_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    docs, rows = {}, []
    for doc in range(40):
        page = 1
        for n in range(int(rng.integers(1, 40))):
            page += int(rng.random() < 0.1)
            level = int(rng.integers(1, 9)) if rng.random() < 0.35 else 0
            text = f"{'#' * min(6, level)} Title {n}" if level else " ".join(f"Word {n} {k}." for k in range(int(rng.integers(1, 14))))
            docs.setdefault(doc, []).append((level > 0, min(6, level), text, page))
            rows.append((doc, n, "PARAGRAPH", text, page, None, None))
    got = {}
    for c in chunks(spark, rows, 4):
        got.setdefault(c.doc_id, []).append((c.content, c.heading, c.section_id, c.page_number))
    assert got == {doc: _plain_chunks(blocks, 4) for doc, blocks in docs.items()}


def test_pages_are_read_once_and_shuffled_once_for_their_chunks(spark):
    from lorefold.plans.content_queries import chunk_pages

    plan = chunk_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[_extract(") == 1 and plan.count("[_sentences(") == 1
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_texts_are_cut_and_embedded_once_for_their_lists(spark):
    """Lists are scored from written terms, and a provider's vectors are computed once, whatever is left out of them."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = spark.createDataFrame([(1, "red dog")], "qid long, text string")
    assert "regexp_extract_all" not in plan(R.bm25(items, q, 3))
    embed = E.hashed_words(8)
    lists = R.knn(items.select("id", embed("content").alias("embedding")), q.select("qid", embed("text").alias("embedding")), 3)
    executed = lists._jdf.queryExecution().executedPlan().toString()
    assert executed.count("ArrowEvalPython") == 1 and lists.count() == 3


def test_item_vectors_are_those_of_unit_and_unfit_ones_have_no_place(spark):
    rng = np.random.default_rng(11)
    v = [rng.normal(size=5).tolist() for _ in range(20)] + [None, [0.0] * 5, [1.0] * 4, [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0, 0.0], [1e200] * 5]
    df = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    want = {r.id: r.x for r in df.select("id", R.unit(F.col("embedding")).alias("x")).where("x is not null and size(x) = 5").collect()}
    for at in (0, 3):
        ids, x = R._unit_rows(pa.array(range(len(v)))[at:], pa.array(v, pa.list_(pa.float64()))[at:], 5)
        assert dict(zip(ids.to_pylist(), x.tolist(), strict=True)) == {k: r for k, r in want.items() if k >= at}
    got = R.knn(df, df.where("id < 2").withColumnRenamed("id", "qid"), 30).collect()
    assert {r.id for r in got} == set(want) == set(range(20))
