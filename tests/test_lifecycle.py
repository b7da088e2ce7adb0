"""Collections, requests, sources and evaluation runs."""

import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import collection, evaluation, store
from millrace.plans import answering
from millrace.sources import files, pdf, scans
from millrace.streaming import updates

CHUNKS = "source string, page_content string, content_type string"


def rows(spark, *names, content="x"):
    return spark.createDataFrame([(n, content, "pdf" if n.endswith(".pdf") else "web") for n in names], CHUNKS)


def test_collection_is_made_opened_and_rebuilt(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(collection.Missing):
        collection.opened(spark, path)
    with pytest.raises(collection.Missing):
        collection.create(rows(spark, "a").limit(0), path)
    assert collection.scanned(spark, path, lambda: rows(spark, "q").limit(0), lambda: rows(spark, "q")).count() == 1
    built = []
    build = lambda d: (built.append(1), d)[1]
    docs = rows(spark, "a.pdf", "u1")
    assert collection.refreshed(docs, path, build).count() == 2 and collection.refreshed(docs, path, build).count() == 2 and len(built) == 1
    assert not collection.needs_rebuild(spark, rows(spark, "a.pdf", "u1", content="other"), path)  # by name
    assert collection.refreshed(rows(spark, "a.pdf", "u2", "u3"), path, build).count() == 3 and len(built) == 2
    assert collection.rebuild(docs, path, build).count() == 2 and collection.opened(spark, path).count() == 2
    assert collection.scanned(spark, path).count() == 2


@pytest.mark.parametrize("at", ["before the old one moves", "between the moves", "before the old one is deleted"])
def test_replace_survives_a_crash(spark, tmp_path, at):
    path = str(tmp_path / "t")
    store.replace(rows(spark, "old"), path)
    rows(spark, "new").write.parquet(path + ".staged")
    if at != "before the old one moves":
        (tmp_path / "t").rename(tmp_path / "t.old")
    if at == "before the old one is deleted":
        (tmp_path / "t.staged").rename(tmp_path / "t")
    expected = {"before the old one moves": "old"}.get(at, "new")
    assert [r.source for r in collection.opened(spark, path).collect()] == [expected]
    store.replace(rows(spark, "newer"), path)
    assert [r.source for r in collection.opened(spark, path).collect()] == ["newer"] and not (tmp_path / "t.old").exists()


def test_urls_go_with_all_that_hangs_on_them(spark):
    listed = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    held = spark.createDataFrame([("u1", "h1"), ("u2", "h2")], "url string, html string")
    metadata = spark.createDataFrame([("t", 2, ["u1", "u2"])], "last_scraped string, total_scraped bigint, scraped_urls array<string>")
    out = collection.remove_urls(listed, held, metadata, rows(spark, "u1", "u2", "u2"), spark.createDataFrame([("u2",), ("u9",)], "url string"))
    assert sorted(r.url for r in out.listed.collect()) == ["u1", "u3"] and [r.url for r in out.files.collect()] == ["u1"]
    assert out.metadata.first().scraped_urls == ["u1"] and out.metadata.first().total_scraped == 1 and out.chunks.count() == 1
    assert {r.url: r.state for r in out.states.collect()} == {"u2": "removed", "u9": "missing"} and [r.source for r in out.requests.collect()] == ["u2"]
    fetch = lambda urls: files.fetched(urls, lambda u: "new" if u == "u1" else 1 / 0, retries=1)
    now, got, asked = collection.refresh_urls(listed, held, fetch, spark.createDataFrame([("u1",), ("u2",)], "url string"))
    assert {r.url: r.html for r in now.collect()} == {"u1": "new", "u2": "h2"} and got.count() == 2 and [r.source for r in asked.collect()] == ["u1"]


def test_monitor_says_what_to_do(spark):
    listed, found = (spark.createDataFrame([(u,) for u in x], "url string") for x in (("a", "b"), ("a", "c")))
    held, before = (spark.createDataFrame(x, "url string, hash string") for x in ([("a", "2"), ("b", "1"), ("z", "1")], [("a", "1"), ("b", "1"), ("z", "0")]))
    assert {(r.url, r.action) for r in collection.monitor(listed, found, held, before).collect()} == {("c", "scrape"), ("a", "update"), ("z", "remove")}


def test_suffixes_of_many_paths(spark):
    chunks = rows(spark, "/x/a.pdf", "/y/ba.pdf", "/y/c.pdf", "https://s/d")
    paths = spark.createDataFrame([("in/a.pdf",), ("d",), ("",)], "path string")
    assert [r.source for r in store.without_suffixes(chunks, paths).collect()] == ["/y/c.pdf"]


def test_requests_have_ids_and_states(spark, tmp_path):
    requests, path, status, point = (str(tmp_path / x) for x in "rcsk")
    rows(spark, "a", "b").write.parquet(path)
    asked = spark.createDataFrame([("scraped_content_added", "n", "new", "web"), ("scraped_content_removed", "a", None, None)], "reason string, source string, page_content string, content_type string")
    ids = updates.submit(asked, requests)
    assert len(set(ids)) == 2
    queue = spark.read.schema(updates.REQUESTS).json(requests)
    none = spark.createDataFrame([], "request_id string, reason string, batch bigint, state string, at timestamp")
    every = spark.createDataFrame([(i,) for i in [*ids, "x"]], "request_id string")
    assert sorted(r.state for r in updates.states(queue, none, every).collect()) == ["none", "queued", "queued"]
    updates.maintain(spark, requests, path, status, point).awaitTermination()
    done = spark.read.parquet(status)
    assert sorted(r.state for r in updates.states(queue, done, every).collect()) == ["completed", "completed", "none"]
    q = updates.queue_status(queue, done).first()
    assert (q.queued, q.completed, q.failed, set(q["last"])) == (0, 2, 0, set(ids))
    assert sorted(r.source for r in spark.read.parquet(path).collect()) == ["b", "n"]


def test_a_replayed_batch_counts_once_and_a_failed_one_is_not_lost(spark, tmp_path):
    requests, path, status, point = (str(tmp_path / x) for x in "rcsk")
    rows(spark, "a").write.parquet(path)
    asked = spark.createDataFrame([("scraped_content_added", "n", "new", "web")], "reason string, source string, page_content string, content_type string")
    updates.submit(asked, requests)

    def broken(chunks, batch):
        raise OSError("readonly")

    with pytest.raises(Exception):
        updates.maintain(spark, requests, path, status, point, broken).awaitTermination()
    assert [r.state for r in spark.read.parquet(status).collect()] == ["failed: OSError"]
    updates.maintain(spark, requests, path, status, point).awaitTermination()  # the restart takes the batch again
    assert sorted(r.source for r in spark.read.parquet(path).collect()) == ["a", "n"] and store.has_batch(spark, path, 0)
    commits = tmp_path / "k" / "commits"
    for f in [*commits.glob("0"), *commits.glob(".0*")]:  # a crash after the swap, before the stream's own commit
        f.unlink()
    updates.maintain(spark, requests, path, status, point).awaitTermination()
    assert sorted(r.source for r in spark.read.parquet(path).collect()) == ["a", "n"]


def test_session_runs_steps(spark):
    s = updates.Session(spark, "steps")
    sent = []
    assert s.run_steps([lambda: 1, lambda: 2], sent.append) == [1, 2] and sent == [[1, 2]]
    assert s.progress()["percent"] == 100.0 and s.progress()["state"] == "completed"
    t = updates.Session(spark, "cancelled")
    assert t.run_steps([lambda: t.cancel(), lambda: 2], sent.append) == [True] and len(sent) == 1 and t.progress()["state"] == "cancelled"


def made_pdf(*texts):
    out, numbers = [b"%PDF-1.4"], []
    for i, t in enumerate(texts):
        stream = b"BT /F1 12 Tf 72 720 Td " + t + b" ET"
        packed = zlib.compress(stream)
        numbers += [b"%d 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj" % (20 + i, len(packed), packed), b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj" % (10 + i, 20 + i)]
    return b"\n".join([*out, *numbers, b"%%EOF"])


def test_pdf_pages(spark, tmp_path):
    content = made_pdf(rb"(One \(1\)) Tj T* (two) Tj", rb"[(Hel) 20 (lo) -300 (you)] TJ", b"<48690a> Tj")
    assert pdf.pages(content) == ["One (1)\ntwo", "Hello you", "Hi"]
    (tmp_path / "a.pdf").write_bytes(content)
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    out = files.pdfs(spark, str(tmp_path)).collect()
    assert sorted(r.page for r in out if r.error is None) == [0, 1, 2] and [r.error for r in out if r.error] == ["ValueError: not a PDF file"]


def test_scans_are_data_sources(spark):
    scans.registered(spark)
    assert [(r.place, r.url) for r in spark.read.format("millrace_urls").option("text", "a\n# c\n\n b").load().collect()] == [(0, "a"), (3, "b")]
    out = spark.read.format("millrace_pages").option("urls", "file:///nowhere x:y").option("retries", "1").load().collect()
    assert len(out) == 2 and all(r.html is None and r.status.startswith("failed") and r.attempts == 1 for r in out)


def test_refused_pages_are_not_asked_again(spark):
    def fetch(url, attempt):
        raise files.Refused("HTTP 404") if "gone" in url else OSError(f"429 {attempt}")

    out = files.fetched(spark.createDataFrame([("gone",), ("busy",)], "url string"), fetch, pause=lambda s: None)
    assert {r.url: (r.attempts, r.status) for r in out.collect()} == {"gone": (1, "failed: HTTP 404"), "busy": (3, "failed: 429 2")}


def hit_lists(spark):
    topics = {"q1": "alpha course about rivers and lakes", "q2": "beta degree with statistics", "q3": "gamma campus library"}
    rag = [(q, i, f"{topics[q]} passage {i}" if i % 2 else f"noise {q} {i}", i + 1) for q in topics for i in range(20)]
    words = [(q, 100 + i, f"{topics[q]} words {i}", i + 1, 10.0 - i) for q in topics for i in range(10)]
    truth = spark.createDataFrame([(q, t, t, t.split()[:2]) for q, t in topics.items()] + [("q4", "none", "none such", ["none"])], "query_id string, question string, ground_truth string, keywords array<string>")
    return spark.createDataFrame(rag, "query_id string, doc_id int, content string, rank int"), spark.createDataFrame(words, "query_id string, doc_id int, content string, rank int, bm25_score double"), truth


def test_tuning_scores_all_configurations(spark, tmp_path):
    rag, words, truth = hit_lists(spark)
    out = evaluation.tuned(rag, words, truth, trials=6, near=4, top=2)
    results = out.results.collect()
    assert 6 <= len(results) <= 10 and all(r.n == 4 for r in results)  # the question without a hit counts
    assert [r.proxy_score for r in out.best.collect()] == sorted((r.proxy_score for r in results), reverse=True)[:2]
    one = next(r for r in results)
    config = spark.createDataFrame([one]).select(*evaluation.SPACE)
    alone = evaluation.proxy(evaluation.apply_configs(rag, words, config), truth).agg(F.round(F.avg("proxy_score"), 9)).first()[0]
    assert alone == one.proxy_score and 0 < out.baseline <= 1
    checked = evaluation.validated(rag, words, truth, out.best).collect()
    assert len(checked) == 2 * 4 and all(r.n == 4 for r in checked)
    path = evaluation.save_rows(truth.withColumn("category", F.lit("c")).withColumn("difficulty", F.lit("easy")), str(tmp_path), "truth")
    loaded = evaluation.load_rows(spark, path)
    assert evaluation.chosen(loaded, "c", "easy", 2).count() == 2 and evaluation.chosen(loaded, "d").count() == 0
    answers = loaded.select("query_id", F.col("ground_truth").alias("answer"))
    a, b = evaluation.comprehensive(loaded, answers, rag), evaluation.comprehensive(loaded, answers.limit(0), rag.limit(0))
    assert a.count() == 16
    ab = {r.metric: r for r in evaluation.ab_test(a, b).collect()}
    assert ab["context_recall"].a_wins == 3 and ab["context_recall"].b_wins == 0 and ab["context_recall"].verdict == "regressed"


def test_retrieval_and_chain_give_a_row_for_every_question(spark):
    docs = spark.createDataFrame([(1, "Rivers and lakes flow.", "/a/x.pdf", "pdf", "", ""), (2, "Statistics of beta degrees.", "/a/y.pdf", "pdf", "", "")], "doc_id bigint, text string, source string, content_type string, code string, title string")
    chunks = answering.build(docs, answering.Models())
    asked = spark.createDataFrame([(1, "rivers lakes"), (2, ""), (3, None)], "query_id bigint, query string")
    found = {r.query_id: r for r in answering.retrieved(asked, chunks, k=1).collect()}
    assert found[1].matched_files == ["x.pdf"] and found[1].error is None and found[2].error == found[3].error == "empty question"
    assert answering.retrieved(asked, chunks.limit(0)).where("error = 'nothing found'").count() == 1
    answers = {r.query_id: r.answer for r in answering.chain(asked, chunks, k=1).collect()}
    assert answers == {1: "Rivers and lakes flow.", 2: None, 3: None}
