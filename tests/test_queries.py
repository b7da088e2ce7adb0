"""Every named query against DuckDB at the smallest size."""

import datetime
import os
import random

import duckdb
import pytest

from millrace.operators import answers
from millrace.operators.chunking import recursive_split
from millrace.plans import queries
from millrace.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(SQL[name])
    place = [relation.columns.index(c) for c in columns]
    assert len(place) == len(relation.columns)
    assert found == sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)


def test_fuzzy_matches_are_those_of_all_pairs(spark):
    cache = queries.cache_rows(spark, DATA).collect()
    found = {r.query_id: (r.cache_id, round(r.similarity, 9)) for r in QUERIES["fuzzy_cache_match"](spark, DATA).collect()}
    expected = {}
    exact = {}
    for c in sorted(cache, key=lambda c: c.cache_id):
        exact.setdefault(c.question_hash, c.cache_id)
    for q in cache:
        asked = q.question + "?"
        scored = [(-round(answers.ratio(asked, c.question), 9), c.cache_id) for c in cache]
        best = min(x for x in scored)
        if -best[0] > answers.LEAST:
            expected[q.cache_id] = (best[1], -best[0])
    ids = [c.cache_id for c in cache]
    once = {i for i in ids if ids.count(i) == 1}  # several questions of one session share an id
    assert {k: v for k, v in found.items() if k in once} == {k: v for k, v in expected.items() if k in once} and len(found) > 10


def test_fuzzy_loses_no_pair_over_the_ratio(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.choice((1, 2, 5, 12, 40)))) for _ in range(60)]

    def edited(s):
        s = list(s)
        for _ in range(r.randint(0, max(1, len(s) // 25))):
            i, op = r.randrange(len(s) + 1), r.choice("idr")
            s[i : i + (op != "i")] = [] if op == "d" else [r.choice("abcde ")]
        return "".join(s)

    cache = [(i, f"h{i}", s) for i, s in enumerate(base + [edited(s) for s in base])]
    asked = [(i, edited(s[2]).upper()) for i, s in enumerate(cache)] + [(900, ""), (901, None)]
    c = spark.createDataFrame(cache, "cache_id int, question_hash string, question string")
    q = spark.createDataFrame(asked, "query_id int, query string")
    for least in (0.95, 0.8):
        found = {x.query_id: (x.cache_id, round(x.similarity, 9)) for x in answers.fuzzy(q, c, least).collect()}
        expected = {}
        for i, s in asked:
            if s:
                best = min((-answers.ratio(s, t), k) for k, _, t in cache)
                if -best[0] > least:
                    expected[i] = (best[1], round(-best[0], 9))
        assert found == expected


def test_recursive_chunks_cover_their_texts(spark):
    rows = {}
    for r in QUERIES["chunk_recursive"](spark, DATA).collect():
        rows.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk))
    for r in queries.table(spark, DATA, "documents").collect():
        chunks = [c for _, c in sorted(rows.get(r.doc_id, []))]
        assert chunks == recursive_split(r.text or "") and all(0 < len(c) <= 500 and c in r.text for c in chunks)
        assert set((r.text or "").split()) == set(" ".join(chunks).split())


def test_tuner_apply_and_run_agree_with_their_scores(spark):
    out = QUERIES["tuner_run"](spark, DATA).collect()
    assert len(out) == 5 and [r.proxy_score for r in out] == sorted((r.proxy_score for r in out), reverse=True)
    rows = QUERIES["tuner_apply"](spark, DATA).collect()
    assert all(r.hits > 0 and r["mean"] > 0 for r in rows)


def test_every_question_is_answered_once(spark):
    rows = QUERIES["answer_batch"](spark, DATA).collect()
    assert sorted(r.query_id for r in rows) == sorted(r.item_id for r in queries.table(spark, DATA, "benchmark").collect())
    assert {r.status for r in rows} <= {"answered", "unanswered", "safety_blocked"} and any(r.query_type == "rag" for r in rows)


def test_queries_without_sql_have_tests():
    assert set(QUERIES) - set(SQL) == {"fuzzy_cache_match", "chunk_recursive", "tuner_apply", "tuner_run", "answer_batch"}
