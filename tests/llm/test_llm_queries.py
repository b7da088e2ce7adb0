"""The registered queries at the smallest size: against DuckDB where there is SQL, else against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_llm_operators import plain_classes, plain_coverage, plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, quality
from millrace.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_rows(spark, duck, name):
    df = llm.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(llm.SQL[name])
    place = [relation.columns.index(c) for c in columns if c in relation.columns]
    assert len(place) == len(relation.columns) == len(columns)
    assert found == sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)


def test_url_lists_are_made_from_all_hosts(spark):
    rows = llm.queries()["op1_url_filters"](spark, DATA).collect()
    assert {(r.verdict, r.list) for r in rows} >= {("block", "spam"), ("allow", "partners"), ("block", "sections")}
    made = llm.entries_of(llm.table(spark, DATA, "pages")).collect()
    assert {r.host for r in rows} - {None} <= {r.key for r in made}
    assert {(r.list, r.action) for r in made} == {("spam", "block"), ("partners", "allow"), ("networks", "block"), ("sections", "block"), ("sections", "allow")}


# Queries that SQL can't express, over all rows of the smallest tables


def rows_of(spark, name):
    return [r.asDict() for r in llm.table(spark, DATA, name).collect()]


def run(spark, name):
    return llm.queries()[name](spark, DATA).collect()


def python_words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_contaminated(text, bench, least=0.8):
    """Items whose coverage by greedy tiling, as it is defined, reaches the bound."""
    doc = python_words(text)
    runs = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
    found = []
    for key, words in bench:
        hits = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in runs]
        if len({i + k for i in hits for k in range(5)}) >= least * len(words) > 0:  # fewer seeds can't cover it
            near = {tuple(words[i : i + 5]) for i in hits}
            inside = {i + k for i in range(len(doc) - 4) if tuple(doc[i : i + 5]) in near for k in range(5)}
            cut = [doc[i] if i in inside else f"\0{i}" for i in range(len(doc)) if i in inside or i - 1 in inside]
            if plain_coverage(words, cut) >= least:
                found.append(key)
    return found


def bench_words(spark):
    return [(r["item_id"], python_words(r["text"])) for r in rows_of(spark, "benchmark")]


def test_op2_is_plain_tiling(spark):
    bench = bench_words(spark)
    expected = {r["doc_id"]: plain_contaminated(r["text"], bench) for r in rows_of(spark, "documents")}
    found = {r.doc_id: sorted(r["items"]) for r in run(spark, "op2_decontamination")}
    assert found == expected and any(found.values())


def test_op3_is_the_definition(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in rows_of(spark, "documents")))
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op3_repeats")} == plain_repeats(docs)


def test_op5_base_is_plain_search(spark):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    for r in run(spark, "op5_license_scan"):
        text = next(x["text"] for x in rows_of_documents(spark) if x["doc_id"] == r.doc_id) or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = sorted((i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places)) and r.base_labels == ",".join(sorted({k for _, k in places}))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


_documents = []


def rows_of_documents(spark):
    if not _documents:
        _documents.extend(rows_of(spark, "documents"))
    return _documents


def test_op6_is_the_library(spark):
    library = Tokenizer.from_file(bpe.default_path())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op6_bpe")}
    assert found == {r["doc_id"]: encoded(library, r["text"]) for r in rows_of_documents(spark)}


def encoded(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_op8_links_all_similar_texts(spark, data):
    """Recall of pairs of similarity 0.8 and more, against all pairs: classes equal those of brute force, on both tables."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_classes(docs)
    found = {r.doc_id: r.class_id for r in llm.op8_near_dedup(spark, data).collect()}
    assert found == expected and len(set(found.values())) < len(found)


def test_op9_counts_and_verdicts(spark):
    patterns, verdict = Counter(), {}
    for r in rows_of_documents(spark):
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = len({k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        vote = quality.votes(quality.measures(text))
        patterns[vote] += 1
        verdict[r["doc_id"]] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, failed, vote)
    posterior = quality.fit(patterns)[2]
    for r in run(spark, "op9_quality"):
        *counts, failed, vote = verdict[r.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == failed and r.kept == (not failed and posterior[vote] >= 0.5)


def test_op9_agrees_with_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in llm.op9_quality(spark, data).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.97 * len(rows) > 50


def test_op10_predicts_what_it_has_not_seen(spark):
    data = "/root/testdata/sf0.01"
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = llm.op10_language_id(spark, data).collect()
    assert {r.doc_id for r in rows} == set(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in langs[r.doc_id][1] or "")) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and langs[r.doc_id][0] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in known) >= 0.97 * len(known) > 100


def test_pipeline_is_a_plain_pipeline(spark):
    """Every stage in plain Python; language ID by its own predictions, which are tested above."""
    stages = dict(corpus_pipeline.STAGES)
    docs = llm.table(spark, DATA, "documents")
    kept = {r.doc_id for r in stages["language ID"](spark, docs, DATA).collect()}
    rows = sorted((r for r in rows_of_documents(spark) if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    assert all(any(c.isalpha() for c in r["text"] or "") == (r["doc_id"] in kept) for r in rows_of_documents(spark))
    sites, first = {}, {}
    for r in rows:
        for p, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                sites.setdefault(line.strip(" \t\n\x0b\f\r"), set()).add(r["source"])
                first.setdefault(line.strip(" \t\n\x0b\f\r"), (r["doc_id"], p))
    texts = []
    for r in rows:
        lines = list(enumerate((r["text"] or "").split("\n")))
        key = lambda x: x.strip(" \t\n\x0b\f\r")
        left = [x for p, x in lines if not key(x) or len(sites[key(x)]) < 10 or first[key(x)] == (r["doc_id"], p)]
        if any(map(key, left)) or not any(key(x) for _, x in lines):
            texts.append((r["doc_id"], "\n".join(left)))
    classes = plain_classes(texts)
    bench = bench_words(spark)
    library = Tokenizer.from_file(bpe.default_path())
    expected = {i: encoded(library, t) for i, t in texts if classes[i] == i and not plain_contaminated(t, bench)}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert found == expected and len(expected) < len(rows)
