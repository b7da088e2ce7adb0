"""Queries over all the rows they are due."""

from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators import evaluation, lexical, vectors
from millrace.operators.chunking import sentences
from millrace.plans import queries

DATA = "/root/testdata/sf0.001"


def test_search_takes_every_fiftieth_vector_and_all_items(spark):
    v = {r.query_id for r in queries.QUERIES["vector_topk"](spark, DATA).collect()}
    assert v == {r.vec_id for r in queries.table(spark, DATA, "embeddings").where("vec_id % 50 = 0").collect()}
    words = queries._lists(spark, DATA)[1]
    assert {r.query_id for r in words.collect()} == {r.query_id for r in queries.QUERIES["bm25_topk"](spark, DATA).collect()}


def test_blocks_of_vector_queries_give_the_same_hits(spark, monkeypatch):
    v, q = queries._vectors(spark, DATA), queries._vector_queries(spark, DATA)
    whole = sorted(map(tuple, vectors.nearest(v, q, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.nearest(v, q, 3).collect())) == whole


def test_tuner_tries_its_number_of_configurations_at_full_depth(spark, monkeypatch):
    depths = []
    lists = queries._lists
    monkeypatch.setattr(queries, "_lists", lambda s, d, *k: depths.append(k) or lists(s, d, *k))
    out = queries.QUERIES["tuner_apply"](spark, DATA)
    assert depths == [(50, 100)]
    assert out.count() == evaluation.TRIALS


def test_upsert_covers_all_turns(spark):
    found = {r.question_hash for r in queries.QUERIES["cache_upsert"](spark, DATA).collect()}
    assert found == {r.question_hash for r in queries.cache_rows(spark, DATA).collect()}


def test_searches_shuffle_no_pairs(spark):
    """Each task keeps the first k rows of a query as it reads: with k = 2 and one task, no more leave it."""
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "concat('common word', id % 7) AS text", "array(cast(1 AS float), cast(id % 5 AS float)) AS embedding")
    asked = spark.createDataFrame([(1, "common", [1.0, 0.5]), (2, "nothing common here", [0.0, -1.0])], "query_id long, query string, embedding array<float>")
    index = lexical.build(docs.select("doc_id", "text"))
    words = lexical._scored(index, asked, 2, 0.0)
    assert words.count() <= 2 * 2 * index.tokens.rdd.getNumPartitions()
    near = vectors._scored(docs.select("doc_id", "embedding"), asked.select("query_id", F.col("embedding").alias("q")), 2)
    assert near.count() == 4


def test_searches_equal_all_pairs(spark):
    docs = spark.range(400, numPartitions=3).selectExpr("cast(id AS string) AS doc_id", "concat('alpha ', repeat('beta ', cast(id % 4 AS int)), 'word', id % 11, ' gamma', if(id % 3 = 0, ' rare', '')) AS text")
    docs = docs.withColumn("embedding", F.when(F.col("doc_id") == "7", None).when(F.col("doc_id") == "8", F.array(F.lit(1.0))).when(F.col("doc_id") == "9", F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array((F.col("doc_id").cast("int") % 13).cast("double"), F.lit(0.5))))
    asked = spark.createDataFrame([(i, q, [float(i), 1.0]) for i, q in enumerate(["alpha beta beta", "rare", "none", "gamma rare"])], "query_id long, query string, embedding array<double>")
    index = lexical.build(docs.select("doc_id", "text"))
    for k in (5, 1000):
        rows = lambda d, score: sorted((r.query_id, r.rank, r.doc_id, round(r[score], 9)) for r in d.collect())
        assert rows(lexical.search(index, asked, k), "bm25_score") == rows(lexical.ranked(lexical.scores(index, asked), k).where("bm25_score > 0"), "bm25_score")
        pairs = docs.crossJoin(asked.select("query_id", F.col("embedding").alias("q"))).select("query_id", "doc_id", vectors.dot(F.col("embedding"), F.col("q")).alias("similarity"))
        plain = lexical.ranked(pairs, k, "similarity")
        found = vectors.nearest(docs.select("doc_id", "embedding"), asked.select("query_id", "embedding"), k)
        key = lambda d: sorted((r.query_id, r.rank, r.doc_id, str(r.similarity)) for r in d.collect())
        assert key(found) == key(plain)


def test_sentences_have_no_white_space_at_their_ends(spark):
    text = [" \tOne. Two!  Three?\n", " One.  Two. 　", "", "   ", ".  \n", "No end"]
    old = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    rows = spark.createDataFrame([(t,) for t in text], "text string").select(sentences(F.col("text")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in rows)
