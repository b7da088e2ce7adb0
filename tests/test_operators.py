"""Operators on hand-made rows: rules, quirks and edges."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import jsonflat, logs, text, urls
from millrace.operators import analytics, answers, chunking, evaluation, fusion, lexical, links, rerank, store, vectors
from millrace.plans import answering
from millrace.plugins import Models, hashing_embedder
from millrace.session import scratch
from millrace.sources import files
from millrace.streaming import updates


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


# Expressions


def test_question_hash_ignores_case_and_space(spark):
    a, b, c = values(spark, text.question_hash, " What IS it?\t", "what is it?", "other")
    assert a == b != c and len(a) == 16


def test_clean_html(spark):
    found = values(spark, text.clean_html, None, " none ", "<p>a &amp; b</p>\n\n<b>c</b><script>x<y</script>", "&lt;tag&gt; &copy;d", "")
    assert found == ["", "", "a & b c", "<tag> d", ""]


def test_index_tokens(spark):
    assert values(spark, text.index_tokens, "The COMP1234 and 2024, k17 machine-learning of AI é 7") == [["COMP1234", "2024", "machine", "learning"]]


def test_safety_order(spark):
    with_indicators = lambda c: text.safety(c, indicators=("course",))
    assert values(spark, text.safety, "which course") == ["model"]
    assert values(spark, with_indicators, None, " ", "x" * 10_001, "Hack my course", "which course", "hello") == ["empty", "empty", "too_long", "unsafe", "indicator", "model"]


def test_url_functions(spark):
    assert values(spark, urls.slug, " https://a.b/c?d=é ") == ["https_a_b_c_d_é"]
    assert values(spark, urls.normalized, "https://a/b;p?q#f", "x") == ["https://a/b;p", ""]
    assert values(spark, urls.category, "h://a/courses/1/programs/2", "h://a/x") == ["programs", "other"]
    assert values(spark, urls.display_name, "https://a.b/c/d-e_f/", "https://a.b", "no url at all, and a long one at that") == ["d e f", "a.b", "no url at all, and a long one ..."]
    assert values(spark, urls.is_content_link, "https://a/courses/1", "https://a/x", None) == [True, False, False]


def test_dates_keep_their_offset(spark):
    found = values(spark, logs.own_date, "2025-01-01T10:00:00+11:00", "2025-01-01T23:59:59Z", "nonsense")
    assert [str(x) for x in found] == ["2025-01-01", "2025-01-01", "None"]


def test_history_round_trip(spark):
    t = spark.createDataFrame([(1, i, f"q{i}", "a" * (i * 60)) for i in range(7)], "session_id int, turn int, question string, answer string")
    row = analytics.history(t).select("turns", logs.parsed_turns(F.col("history")).alias("p")).first()
    assert row.turns == 5 and [x.user for x in row.p] == [f"q{i}" for i in range(2, 7)] and row.p[-1].assistant == "a" * 200 + "..."


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.95, 0.85, 0.75, 0.65, 0.55)], "s double").select(logs.band(F.col("s")))
    assert [r[0] for r in df.collect()] == ["excellent", "good", "acceptable", "poor", "poor"]


# JSON


def test_json_documents():
    tree = {"title": "T", "active": True, "level": {"label": "L", "value": 3}, "empty": {}, "items": [{"value": "a"}, "b"], "one": [{"x": 1, "y": {"z": "deep"}}], "learning_outcomes": [{"number": "2", "description": "two"}, {"number": "x", "description": "last"}, {"number": "1", "description": "<b>one</b>"}]}
    out = jsonflat.document(tree)
    assert "## Title\nT" in out and "Active" not in out and "## Level\nL (3)" in out and "- a\n- b" in out and "deep" in out
    assert out.index("1. one") < out.index("2. two") < out.index("x. last")
    assert [p for p, _ in jsonflat.subtrees({"a": {"b": {"c": 1}}, "state": {"d": 1}})] == ["root", "a", "a -> b"]
    assert jsonflat.fields({"a": {"b": 1, "id": 2}, "l": [{"label": "x"}, "y", {"q": {"r": 0}}, {"q": 5}], "_p": 1}) == {"a_b": "1", "l": "x, y", "l_3_q": "5"}
    assert jsonflat.renamed({"description": 1, "curriculumStructure": {"label": "Core"}}) == {"Overview": 1, "Core Structure": {"label": "Core"}}
    assert jsonflat.document({}) == "" and not jsonflat.meaningful(0) and not jsonflat.meaningful("N/A")


def test_json_sections_in_order():
    tree = {"intro": "hello", "modules": [{"value": "m1"}, {"name": "A", "hours": 3}, "m2", {"name": "B"}], "only": [{"deep": {"er": 1}}], "x": {"y": {"z": {"q": {"r": {"s": "far"}}}}}, "none": {"a": {"b": ""}}}
    assert jsonflat.document(tree) == (
        "## Intro\nhello\n\n## Modules\n\n- m1\n- m2\n\n### Name\nA\n\n### Hours\n3\n\n### Name\nB\n\n"
        "## Only\n\n### Deep\n\n#### Er\n1\n\n## X\n\n### Y\n\n#### Z\n\n##### Q\n\n###### R\n\n**S:** far"
    )
    assert jsonflat.document([{"a": 1}, "b", {"c": 2}], ("part",)) == "# Part\n\n## A\n1\n\n- b\n\n## C\n2"
    assert [p for p, _ in jsonflat.subtrees({"l": [{"a": 1}, 2, {"b": {"c": 3}}]})] == ["root", "l", "l -> 0", "l -> 2", "l -> 2 -> b"]


def test_json_pages_and_list_values(spark):
    rows = spark.createDataFrame([("u1", '{"title":"T","description":"D","code":"C1"}'), ("u2", "{}"), ("u3", "broken")], "url string, j string")
    found = jsonflat.structured(rows, "j", "url").collect()
    assert [(r.page_content, r.metadata) for r in found] == [("## Title\nT\n\n## Overview\nD\n\n## Code\nC1", {"source": "u1", "title": "T", "code": "C1", "content_type": "", "content_length": "37"})]
    assert values(spark, jsonflat.list_values, '[{"value":"a"},{"label":"b"},{"value":"","label":"c"},{"q":1}]', "{}", None) == [["a", "b", "c"], [], []]


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a": {"b": "c"}}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in df.select(jsonflat.to_markdown(F.col("j"))).collect()] == ["## A\n\n### B\nc", "", ""]
    page = '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"pageContent":{"a":"1","b":"1"},"program":{"b":"2"},"metadata":{"c":"3"}}}}</script>'
    assert values(spark, jsonflat.page_content, page) == [{"a": "1", "b": "2", "c": "3"}]
    assert values(spark, lambda c: jsonflat.key_value(F.try_parse_json(c), "k", "d"), '{"k":{"value":"v"}}', '{"k":[{"label":"l"}]}', "{}", "x") == ["v", "l", "d", "d"]


# Chunks


def plain_merge(sections):
    done, group, size = [], [], 0
    for s in sections:
        s = s.strip()
        if not s:
            continue
        if s.startswith("## Overview") or len(s) >= 1200:
            done += ["\n\n".join(group)] * bool(group) + [s]
            group, size = [], 0
        elif group and size >= 200 and (size + len(s) > 600 or len(group) >= 8):
            done.append("\n\n".join(group))
            group, size = [s], len(s)
        else:
            group.append(s)
            size += len(s)
    return done + ["\n\n".join(group)] * bool(group)


def test_merge_follows_its_rules(spark):
    cases = [["## Overview" + "x" * 20, "a" * 300, "b" * 300, "c"], ["a" * 1200, "b", " ", "c" * 1199], ["s" * 30] * 20, ["a" * 199, "b" * 599, "c"], [], ["t" * 24] * 9]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").select("i", chunking.merged_sections(F.col("s")).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {i: plain_merge(c) for i, c in enumerate(cases)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1300), max_size=25), min_size=1, max_size=10))
def test_merge_keeps_all_sections(spark, sizes):
    cases = [["y" * n for n in c] for c in sizes]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").select("i", chunking.merged_sections(F.col("s")).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {i: plain_merge(c) for i, c in enumerate(cases)}


def test_split_merged_numbers_before_the_gate(spark):
    docs = spark.createDataFrame([(1, "intro text long enough\n## Overview\n" + "o" * 300 + "\n## B\n" + "b" * 5000, "C1", "T", "web", "https://x")], "doc_id long, text string, code string, title string, content_type string, source string")
    rows = chunking.split_merged(docs).collect()
    assert [(r.chunk_index, r.total_chunks, r.section_title) for r in rows] == [(1, 3, "Overview")]
    assert rows[0].page_content.startswith("**C1 - T**\n**Type:** web\n**Source:** https://x\n\n## Overview")
    assert chunking.split_by_headers(docs).count() == 3


def test_recursive_split():
    parts = chunking.recursive_split("aa bb\n\n" + "c " * 300 + "\n\n" + "d" * 1200, 500, 50)
    assert all(0 < len(p) <= 500 for p in parts) and parts[0] == "aa bb" and sum(p.count("d") for p in parts) >= 1200


def test_route(spark):
    rows = [(1, "One. Two. Three. Four.", "pdf"), (2, "## Overview\n" + "w" * 300, "scraped_web"), (3, "as is", "note")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_type string").withColumns({c: F.lit(None).cast("string") for c in ("code", "title", "source")})
    found = sorted((r.doc_id, r.chunk_index) for r in chunking.route(docs).collect())
    assert found == [(1, 0), (1, 1), (2, 0), (3, 0)]


# Retrieval


def hits(spark, rows, more=""):
    return spark.createDataFrame(rows, "query_id int, doc_id int, content string, rank int" + more)


def test_fusion_rules(spark):
    long = "p" * 100
    rag = hits(spark, [(1, 1, long + "a", 1), (1, 2, long + "b", 2), (1, 3, "other", 3), (1, 9, "", 4)])
    bm = hits(spark, [(1, 4, long + "z", 1, 9.0), (1, 5, "lex", 2, 3.0), (1, 6, "lex", 3, 2.0), (1, 7, "weak", 4, 0.5)], ", bm25_score double")
    out = {r.key[:5]: r for r in fusion.fuse(rag, bm).collect()}
    assert out["ppppp"].doc_id == 1 and out["ppppp"].search_type == "hybrid" and out["ppppp"].hybrid_score == pytest.approx(72.7)
    assert out["lex"].bm25_score == 2.0 and out["lex"].search_type == "hybrid" and out["lex"].doc_id == 5  # the last duplicate's score
    assert "weak" not in out and [r.rank for r in out.values()] and out["other"].rank == 2
    scaled = {r.key[:5]: r for r in fusion.fuse(rag, bm, fusion.TUNER_BASELINE).collect()}
    assert scaled["ppppp"].bm25_score == 90.0
    assert fusion.fuse(rag, bm, fusion.Weights(most=0)).count() == 0


def test_extras_have_no_scores(spark):
    fused = fusion.fuse(hits(spark, [(1, 1, "a", 1)]), hits(spark, [(1, 2, "b", 1, 5.0)], ", bm25_score double"))
    out = fusion.with_extras(fused, hits(spark, [(1, 3, "a", 1), (1, 4, "c", 2)])).orderBy("rank").collect()
    assert [(r.content, r.hybrid_score) for r in out] == [("a", 70.0), ("b", 1.5), ("c", None)]
    assert [r.content for r in fusion.dual(hits(spark, [(1, 1, "x", 1)]), hits(spark, [(1, 2, "x", 1), (1, 3, "y", 2)])).orderBy("priority").collect()] == ["x", "y"]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "apple apple banana"), (2, "apple cherry"), (3, ""), (4, None), (5, "banana durian")], "doc_id int, text string")
    index = lexical.build(docs)
    asked = spark.createDataFrame([(1, "cherry cherry"), (2, "cherry"), (3, "the of")], "query_id int, query string")
    found = {(r.query_id, r.doc_id): r.bm25_score for r in lexical.search(index, asked).collect()}
    assert set(found) == {(1, 2), (2, 2)} and found[1, 2] == pytest.approx(2 * found[2, 2])
    assert lexical.search(index, asked, 0).count() == 0
    assert lexical.search(lexical.build(docs.limit(0)), asked).count() == 0
    assert lexical.stats(docs).first().available == 3


def test_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 3) for i in range(6)], "doc_id int, embedding array<float>, label int")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id int, embedding array<float>")
    out = vectors.nearest(v, q, 3).where("query_id = 0").orderBy("rank").collect()
    assert [(r.doc_id, r.similarity, r.distance) for r in out] == [(1, 1.0, 0.0), (3, 1.0, 0.0), (5, 1.0, 0.0)]
    assert [r.doc_id for r in vectors.nearest_where(v, q, {"label": 0}, 5).where("query_id = 1").orderBy("rank").collect()] == [3, 0]
    blocked = vectors.BLOCK
    vectors.BLOCK = 1
    try:
        assert vectors.nearest(v, q, 3).count() == 9
    finally:
        vectors.BLOCK = blocked


def test_rerank_and_grade(spark):
    h = spark.createDataFrame([(1, "red fox", 1, "a red hat", "s/x.pdf", 1), (1, "red fox", 2, "the red fox", "s/y.pdf", 2), (2, "lone", 3, "lone", None, 1)], "query_id int, query string, doc_id int, content string, source string, rank int")
    out = {(r.query_id, r.rerank): (r.doc_id, r.rerank_score) for r in rerank.rerank(h, 1).collect()}
    assert out == {(1, 1): (2, 1.0), (2, 1): (3, None)}
    graded = rerank.grade(rerank.rerank(h, 5), lambda q, c: F.when(F.contains(c, F.lit("lone")), "Incorrect").otherwise("CORRECT"))
    assert {r.query_id for r in rerank.only_relevant(graded).collect()} == {1}
    assert [r.matched_files for r in rerank.files(h).collect()] == [["x.pdf", "y.pdf"]]
    assert "/docs/x.pdf" in {r.query_id: r.context for r in rerank.context(h).collect()}[1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("abcdé ", min_size=1, max_size=40), min_size=1, max_size=8, unique=True), st.integers(0, 3))
def test_fuzzy_is_the_best_ratio(spark, cached, change):
    asked = [c[:-1] + "x" * (change % 2) for c in cached]
    cache = spark.createDataFrame([(i, str(i), c) for i, c in enumerate(cached)], "cache_id int, question_hash string, question string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    expected = {}
    for i, a in enumerate(asked):
        best = max(((SequenceMatcher(None, a.lower(), c.lower()).ratio(), -k) for k, c in enumerate(cached)), default=(0, 0))
        if a and best[0] > 0.8:
            expected[i] = -best[1]
    assert {r.query_id: r.cache_id for r in answers.fuzzy(q, cache, 0.8).collect()} == expected


# Stores


CACHE_ROW = "question_hash string, question string, answer string, created_at string, updated_at string, answer_quality string, last_used string, cache_id string, user_feedback string, query_type string, usage_count bigint, matched_files array<string>"


def test_cache_life(spark):
    now = F.lit("now")
    new = spark.createDataFrame([("What?", "A", "rag", ["f"], None, None)], "question string, answer string, answer_quality string, matched_files array<string>, user_feedback string, query_type string")
    empty = spark.createDataFrame([], CACHE_ROW)
    once = store.upsert_cache(empty, new, F.lit("then"))
    again = store.upsert_cache(once, new.withColumn("answer", F.lit("B")).withColumn("matched_files", F.lit(None).cast("array<string>")), now).first()
    assert (again.answer, again.usage_count, again.created_at, again.updated_at, again.matched_files) == ("B", 1, "then", "now", ["f"])
    assert store.count_uses(once, once.union(once), now).first().usage_count == 3
    assert store.set_answer(once, once.first().question_hash, "C", now).first().answer_quality == "admin_answered"
    assert store.fill_query_types(once).first().query_type == "rag"
    assert store.delete_where(once, once, "question_hash").count() == 0 and store.emptied(once).count() == 0


def test_log_feedback_cascades(spark):
    logs_ = spark.createDataFrame([("m1", "h", "q", "a", None, None), ("m2", "h", "q", "a", None, None), ("m3", "k", "r", "b", "positive", None)], "message_id string, question_hash string, question string, answer string, user_feedback string, feedback_time string")
    cache = spark.createDataFrame([("h", "q", None, "t"), ("k", "r", None, "t")], "question_hash string, question string, user_feedback string, updated_at string")
    log, cached = store.feedback(logs_, cache, spark.createDataFrame([("m1", "negative")], "message_id string, user_feedback string"), F.lit("now"))
    assert {r.message_id: r.user_feedback for r in log.collect()} == {"m1": "negative", "m2": None, "m3": "positive"}
    assert {r.question_hash: (r.user_feedback, r.updated_at) for r in cached.collect()} == {"h": ("negative", "now"), "k": (None, "t")}


def test_find_message_cascade(spark):
    rows = [("a", "how are you", "2025-01-01T00:00:00", None), ("b", "hello there", "2025-01-02T00:00:00", None), ("c", "bye", "2025-01-03T00:00:00", None)]
    logs_ = spark.createDataFrame(rows, "message_id string, question string, timestamp string, type string")
    asked = spark.createDataFrame([(1, "bye", None), (2, "hello", None), (3, "zzz", "2025-01-01T03:00:00"), (4, "zzz", None)], "request_id int, question string, hint string")
    assert {r.request_id: r.message_id for r in store.find_message(asked, logs_).collect()} == {1: "c", 2: "b", 3: "a", 4: "c"}


def test_nearest_looks_both_ways_across_hours(spark):
    l = spark.createDataFrame([(1, "2025-01-01 12:00:00", 1), (1, "2025-01-05 00:00:00", 2), (2, "2025-01-01 00:00:00", 3)], "k int, at string, lid int")
    r = spark.createDataFrame([(1, "2025-01-01 12:59:00", 10), (1, "2025-01-01 11:30:00", 11), (1, "2025-01-02 00:00:00", 12)], "k int, at string, rid int")
    assert {x.lid: (x.rid, x.gap) for x in store.nearest_in_time(l, r, ["k"], "lid", "rid").collect()} == {1: (11, 1800.0), 2: (12, 259200.0)}


def test_json_lines_and_replace(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"question":"a","ai_answered":true}\nbroken\n{"type":"stats_summary","total_queries":3}\n')
    rows = store.read_json_lines(spark, str(p), store.LOG_SCHEMA)
    assert rows.count() == 2 and [r[0] for r in rows.select(logs.answered(F.col("answered"), F.col("ai_answered"))).collect()] == [True, False]
    assert tuple(analytics.exported(rows).first()) == (2, 0, 2) and analytics.exported(rows, True).first().total == 1
    table = str(tmp_path / "t")
    store.replace(spark.range(3), table)
    store.replace(spark.read.parquet(table).where("id > 0"), table)
    assert spark.read.parquet(table).count() == 2


def test_collection_changes(spark):
    chunks = spark.createDataFrame([("a/x.pdf", "1"), ("b", "2"), (None, "3")], "source string, page_content string")
    assert store.without_suffix(chunks, "/up/x.pdf").count() == 2 and store.without_source(chunks, "b").count() == 2
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert store.changed_names(names("a", "b"), names("a")) and not store.changed_names(names("a", "b"), names("b", "a", "a"))


def test_links(spark):
    u = lambda *x: spark.createDataFrame([(n,) for n in x], "url string")
    assert {r.url: r.state for r in links.add(u("https://a/1"), u("https://a/1", "https://a/2", "a/3")).collect()} == {"https://a/1": "existing", "https://a/2": "added", "a/3": "invalid"}
    assert {r.url: r.state for r in links.consistency(u("a", "b"), u("b", "c")).collect()} == {"a": "orphaned", "c": "missing"}
    assert [r.url for r in links.remove(u("a", "b"), u("b")).collect()] == ["a"]
    row = links.metadata_update(spark.createDataFrame([(["a", "b"],)], "scraped_urls array<string>"), ["b", "c"]).first()
    assert (row.scraped_urls, row.total_scraped) == (["a", "b", "c"], 3)


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 7), st.integers(0, 20))
def test_pages_part_the_rows(spark, size, n):
    rows = spark.range(n)
    pages = analytics.page_count(rows, size).first().pages
    got = [r.id for p in range(1, pages + 1) for r in analytics.page(rows, [F.col("id")], p, size).collect()]
    assert got == list(range(n)) and analytics.page(rows, [F.col("id")], 0, size).count() == 0


# Evaluation


def test_metric_means(spark):
    s = spark.createDataFrame([(i, m, x) for m, xs in {"faithfulness": [0.8, 0.9, 0.7], "relevancy": [0.7, 0.8, float("nan")], "none": [None]}.items() for i, x in enumerate(xs)], "query_id int, metric string, score double")
    assert {r.metric: (r["mean"], r.n) for r in evaluation.metric_means(s).collect()} == {"faithfulness": (0.8, 3), "relevancy": (0.75, 2), "none": (None, 0)}
    assert evaluation.overall(evaluation.metric_means(s.limit(0))).first().band == "unknown"


def test_test_queries(spark):
    truth = spark.createDataFrame([("What is COMP1234?", "t", "c", "easy"), ("Where?", "t", "c", "easy")], "question string, ground_truth string, category string, difficulty string")
    rows = evaluation.test_queries(truth, ["broad one"]).collect()
    assert sorted(r.query for r in rows) == ["Tell me about COMP1234", "What is COMP1234?", "Where?", "broad one"] and sorted(r.query_id for r in rows)[0] == "query_001"


def test_tuner(spark):
    grid = evaluation.grid(spark)
    assert grid.count() == 1944 and evaluation.sampled(grid).count() == 50
    results = grid.withColumn("proxy_score", -F.abs(F.col("rag_weight") - 0.7) - F.abs(F.col("vector_k") - 50) / 100)
    best = evaluation.ranked_configs(results.union(results)).limit(3).collect()
    assert all(r.rag_weight == 0.7 and r.vector_k == 50 for r in best)
    near = evaluation.focused(results.withColumn("proxy_score", F.when((F.col("vector_k") == 50) & (F.col("rag_weight") == 0.7), 1.0).otherwise(0.0)))
    assert 0 < near.count() <= 64 and {r.vector_k for r in near.collect()} <= {40, 50}


def test_configs_as_columns_equal_single_runs(spark):
    rag = hits(spark, [(1, i, f"text {i}", i) for i in range(1, 9)])
    bm = hits(spark, [(1, i, f"text {i}", r, 12.0 / r) for r, i in enumerate(range(6, 14), 1)], ", bm25_score double")
    config = dict(evaluation.BASELINE) | {"vector_k": 5, "max_hybrid_results": 6, "reranker_top_k": 4}
    row = spark.createDataFrame([tuple(config[k] for k in config)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in config.items()))
    many = [(r.doc_id, round(r.hybrid_score, 6)) for r in evaluation.apply_configs(rag, bm, row).orderBy("rank").collect()]
    w = fusion.Weights(0.6, 0.4, 70.0, 25.0, 3.0, 4, True)
    one = [(r.doc_id, round(r.hybrid_score, 6)) for r in fusion.fuse(rag.where("rank <= 5"), bm.where("rank <= 12"), w).orderBy("rank").collect()]
    assert many == one


# Sources, streams, the whole pipeline


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page_content":"x","metadata":{"content_type":"course","source":"https://s/1"},"saved_at":"1"}')
    (tmp_path / "b.json").write_text('{"page_content":"y","metadata":{"source":"https://s/2"},"saved_at":"2"}')
    rows = files.scraped(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].metadata == {"source": "https://s/1", "scraped_from_file": "a.json", "type": "course", "content_type": "scraped_web"}
    (tmp_path / "l.txt").write_text("# c\n\n https://b \nhttps://a\nhttps://b\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "l.txt")).orderBy("place").collect()] == ["https://b", "https://a", "https://b"]
    assert files.url_set(spark, str(tmp_path / "l.txt")).count() == 2
    assert files.metadata(spark, str(tmp_path / "none.json")).first().scraped_urls is None
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.pdf").write_bytes(b"one|two")
    (tmp_path / "p/2.pdf").write_bytes(b"bad")

    def parse(content):
        if b"|" not in content:
            raise ValueError("no pages")
        return content.decode().split("|")

    found = sorted((r.page, r.page_content, r.error) for r in files.pdfs(spark, str(tmp_path / "p"), parse).where("page is not null").collect())
    assert found == [(0, "one", None), (1, "two", None)] and files.pdfs(spark, str(tmp_path / "p"), parse).where("error is not null").count() == 1
    files.write_links(spark.createDataFrame([("https://a/courses/2",), ("https://a/courses/1",), ("https://a/x",)], "url string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# courses", "https://a/courses/1", "https://a/courses/2"]
    assert files.file_status(spark, str(tmp_path / "p")).count() == 2


def test_fetch_keeps_failures(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("429")
        return "<html>"

    out = files.fetched(spark.createDataFrame([("ok",), ("bad",)], "url string"), fetch, pause=lambda s: None)
    assert {r.url: (r.html, r.attempts, r.status) for r in out.collect()} == {"ok": ("<html>", 1, "completed"), "bad": (None, 3, "failed: 429")}


def test_maintenance_stream_equals_batch(spark, tmp_path):
    collection, requests = str(tmp_path / "c"), str(tmp_path / "r")
    spark.createDataFrame([("a", "1", "web"), ("b", "2", "web")], "source string, page_content string, content_type string").write.parquet(collection)
    rows = [("1", "scraped_content_added", "c", "3", "web", "2025-01-01T00:00:00"), ("2", "scraped_content_removed", "a", None, None, "2025-01-01T00:00:01"), ("3", "other reason", "b", "new", "web", "2025-01-01T00:00:02")]
    spark.createDataFrame(rows, "request_id string, reason string, source string, page_content string, content_type string, requested_at string").coalesce(1).write.json(requests)
    q = updates.maintain(spark, requests, collection, str(tmp_path / "s"), str(tmp_path / "k"))
    q.awaitTermination()
    assert {r.source: r.page_content for r in spark.read.parquet(collection).collect()} == {"b": "new", "c": "3"}
    status = spark.read.parquet(str(tmp_path / "s"))
    assert {r.state for r in updates.recent(status).collect()} == {"completed"} and status.count() == 3


def test_windowed_stream(spark, tmp_path):
    d = str(tmp_path / "e")
    spark.createDataFrame([("2025-01-01 00:10:00", "a", 1.0), ("2025-01-01 00:50:00", "a", 2.0), ("2025-01-01 03:00:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(d)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(d)
    out = updates.drained(updates.windowed_counts(stream), "windows", "append", scratch(spark, "w")).collect()
    assert [(r.event_type, r.n) for r in out] == [("a", 2)]


def test_single_flight():
    calls = []
    rebuild = updates.Rebuild(lambda: calls.append(1) or len(calls))
    assert rebuild() == rebuild() == 1 and rebuild(fresh=True) == 2


def test_answering_routes(spark):
    docs = spark.createDataFrame([(1, "The library opens at nine. It closes late. Bring a card.", "pdf", "/d/lib.pdf"), (2, "Parking is free on sunday. Cars only. No trucks.", "pdf", "/d/park.pdf")], "doc_id long, text string, content_type string, source string").withColumns({c: F.lit(None).cast("string") for c in ("code", "title")})
    chunks = answering.build(docs, Models(embed=hashing_embedder(16)))
    cache = store.upsert_cache(spark.createDataFrame([], CACHE_ROW), spark.createDataFrame([("Known?", "Yes.", "rag", None, None, None)], "question string, answer string, answer_quality string, matched_files array<string>, user_feedback string, query_type string"), F.lit("t"))
    asked = spark.createDataFrame([(1, "when does the library close"), (2, "how to cheat"), (3, "known?"), (4, "go away"), (5, "elsewhere")], "query_id int, query string")
    models = Models(embed=hashing_embedder(16), rewrite=lambda p: F.when(F.contains(p, F.lit("go away")), "NAVIGATION_QUERY").when(F.contains(p, F.lit("elsewhere")), "REDIRECT: ask there").otherwise(F.regexp_extract(p, r"alone: (.*)$", 1)))
    out = {r.query_id: r for r in answering.answer(asked, chunks, cache, models).collect()}
    assert out[1].status == "answered" and "library" in out[1].answer.lower() and out[1].matched_files[0] == "lib.pdf" and out[1].query_type == "rag"
    assert out[2].status == "safety_blocked" and out[3].cache_hit and out[3].answer == "Yes."
    assert out[4].status == "unanswered" and out[5].answer == "ask there"
