"""The ten operators against plain versions, and on odd rows: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, decontaminate, language_id, licenses, line_dedup, near_dedup, quality, repeats, url_lists, warc
from millrace.session import scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["items", "n_lines", "n_removed", "h", "d", "p", "key", "band", "class", "node", "salt", "gone", "row", "title", "votes", "score"]
rng = random.Random(7)
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "dre", "sol", "vi", "un", "po", "rast", "el"]


def prose(n, r=rng):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    long = prose(30_000)
    twin = prose(120)
    return [
        (1, twin, "en", "s1", 1), (2, twin, "en", "s2", 1), (2, twin, "en", "s2", 1), (3, None, None, None, None), (4, "", "fr", "s1", 0), (None, prose(80), "en", None, 2),
        (5, long, "en", "s3", 3), (6, "one", "de", "s1", 4), (7, "1234 !!", "de", "s1", 4), (8, prose(60), "fr", "s2", 5), (8, prose(70), "fr", "s2", 5), (9, "\n\n  \n", "en", "s1", 6), (10, "é" * 300 + "\u0000 x\r\n", "fr", "s9", 7),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    """Odd rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame(odd_rows, DOCS).select("*", *(F.lit("extra").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1


def entries(spark, rows):
    return spark.createDataFrame(rows, "list string, action string, key string, op string, day string")


def test_url_lists_follow_their_dates(spark):
    e = entries(spark, [("a", "block", "x.org", "add", "2024-02-01"), ("a", "block", "x.org", "remove", "2024-03-01"), ("a", "block", "x.org", "add", "2024-03-01"), ("a", "block", "x.org", "remove", "2025-01-10"), ("b", "allow", "ok.x.org", "add", "2024-02-10"), ("b", "block", "ok.x.org/bad", "add", "2023-01-01"), ("c", None, None, None, None), ("c", "block", "y.org", "remove", "2024-01-01")])
    c = spark.createDataFrame([(1, "http://x.org/", "2024-01-31"), (2, "http://www.x.org/", "2024-02-01"), (3, "https://a.x.org:80/p?q", "2025-01-09"), (4, "http://x.org", "2025-01-10"), (5, "http://ok.x.org/", "2024-02-09"), (6, "http://ok.x.org/", "2024-02-10"), (7, "http://ok.x.org/bad/1", "2024-05-01"), (8, None, "2024-05-01"), (9, "nonsense", "2024-05-01"), (10, "http://x.org/", None), (11, "http://y.org/", "2024-05-01"), (11, "http://y.org/", "2024-05-01")], "page_id int, url string, fetched string")
    found = sorted((r.page_id, r.verdict, r.key) for r in url_lists.judge(c.withColumn("key", F.lit(1)).withColumn("salt", F.lit(1)), e).collect())
    assert found == [(1, "pass", None), (2, "block", "x.org"), (3, "block", "x.org"), (4, "pass", None), (5, "block", "x.org"), (6, "allow", "ok.x.org"), (7, "block", "ok.x.org/bad"), (8, "invalid", None), (9, "invalid", None), (10, "invalid", None), (11, "pass", None), (11, "pass", None)]
    assert url_lists.judge(c.limit(0), e).count() == 0
    assert {r.verdict for r in url_lists.judge(c, e.limit(0)).collect()} == {"pass", "invalid"}


def test_url_keys_have_any_number_of_labels_and_steps(spark):
    deep, path = ".".join(f"a{i}" for i in range(18)) + ".x.org", "/".join(f"s{i}" for i in range(12))
    c = spark.createDataFrame([(1, f"http://{deep}/", "2024-05-01"), (2, f"http://y.org/{path}/end", "2024-05-01"), (3, "http://y.org/s0/s1", "2024-05-01")], "page_id int, url string, fetched string")
    e = entries(spark, [("a", "block", "x.org", "add", "2024-02-01"), ("a", "block", f"y.org/{path}", "add", "2024-02-01")])
    found = sorted((r.page_id, r.verdict, r.key) for r in url_lists.judge(c, e).collect())
    assert found == [(1, "block", "x.org"), (2, "block", f"y.org/{path}"), (3, "pass", None)]


def test_url_lists_hold_in_years_after_the_clock(spark):
    c = spark.createDataFrame([(1, "http://x.org/", "2091-05-01"), (2, "http://y.org/", "2090-12-31"), (3, "http://y.org/", "2091-01-01")], "page_id int, url string, fetched string")
    e = entries(spark, [("a", "block", "x.org", "add", "2024-02-01"), ("a", "block", "y.org", "add", "2024-02-01"), ("a", "block", "y.org", "remove", "2091-01-01")])
    assert sorted((r.page_id, r.verdict) for r in url_lists.judge(c, e).collect()) == [(1, "block"), (2, "block"), (3, "pass")]


# 2


def plain_coverage(item, doc):
    """Greedy string tiling as it is defined."""
    i_marked, d_marked, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (4, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not i_marked[a + n] and not d_marked[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < 5:
            return covered / len(item)
        for k in range(n):
            i_marked[a + k] = d_marked[b + k] = True
        covered += n


def test_tiles_are_greedy():
    r = random.Random(3)
    for _ in range(40):
        item, doc = [[r.choice("abc") for _ in range(r.randint(5, 30))] for _ in range(2)]
        number = {c: i for i, c in enumerate("abc")}
        tiles = decontaminate.tile(np.array([number[c] for c in item]), np.array([number[c] for c in doc]))
        lengths = [n for *_, n in tiles]
        assert lengths == sorted(lengths, reverse=True) and all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)
        plain = plain_coverage(item, doc) * len(item)
        assert not (plain == 0) ^ (not tiles)
        assert abs(sum(lengths) - plain) <= 6  # ties of the longest may be taken in another order


def test_decontamination_finds_reordered_passages(spark, odd, none):
    item = prose(40).split()
    other = prose(40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, other), (3, "too short"), (4, None)], "item_id bigint, text string")
    turned = " ".join(item[20:] + item[:20])
    docs = spark.createDataFrame([(1, prose(50) + " " + turned.upper() + ". " + prose(50)), (2, prose(300)), (3, prose(30) + " ".join(item[:25])), (4, other)], "doc_id bigint, text string")
    found = {r.doc_id: list(r["items"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {1: [1], 2: [], 3: [], 4: [2]}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3}
    assert decontaminate.clean(odd, bench).count() == odd.count() and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_joins_all_seeds_however_full_the_table(spark, monkeypatch):
    items = [(i, prose(30)) for i in range(7)] + [(9, prose(4)), (10, None)]
    rows = [(i, prose(20) + " " + t + " " + prose(20) + " " + items[(i + 1) % 7][1]) for i, t in items[:7]]
    docs, bench = spark.createDataFrame([*rows, rows[0], (99, None)], "doc_id bigint, text string"), spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    expected = sorted((i, sorted([j for j, t in [*items, items[0]] if t and len(t.split()) >= 5 and plain_coverage(t.split(), x.split()) >= 0.8])) for i, x in [*rows, rows[0]]) + [(99, [])]
    for bits in (decontaminate.BITS, 7):
        monkeypatch.setattr(decontaminate, "BITS", bits)
        assert sorted((r.doc_id, list(r["items"])) for r in decontaminate.contaminated(docs, bench).collect()) == expected


# 3


def plain_repeats(rows):
    """Of rows (key, text) in order: (bytes, removed, spans, digest) by key."""
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[key] = (len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [2500, 3])
def test_repeats_match_the_definition(spark, group):
    shared = [prose(r) for r in (18, 25, 40, 60)]
    texts = [prose(20) + rng.choice(shared) + prose(10) + rng.choice(shared) for _ in range(40)] + ["a" * 350, "ab" * 200, "a" * 120, shared[2], shared[2], None, "", "x" * 99, "ü" * 90]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: tuple(r)[1:] for r in repeats.dedup(docs, group, content=False).collect()}
    assert found == plain_repeats(rows)


def test_repeats_of_long_texts_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 12)
    repeats.powers.cache_clear()
    long = prose(3_000)
    rows = [(1, long), (2, prose(50) + long[5_000:9_500] + prose(50)), (3, long[100:])]
    raw = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    assert all(len(r) > 1 << 12 for r in raw[:1])
    monkeypatch.undo()
    repeats.powers.cache_clear()
    found = {r.doc_id: tuple(r)[1:] for r in repeats.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), content=False).collect()}
    assert found == plain_repeats(rows)


def test_repeats_on_odd_rows(spark, odd, none, odd_rows):
    found = repeats.dedup(odd).collect()
    assert len(found) == len(odd_rows)
    twins = sorted(r.n_removed for r in found if r.doc_id in (1, 2))
    assert twins == [0, *[len(odd_rows[0][1])] * 2]  # of repeated rows the first keeps its bytes, here none does after doc 1
    assert repeats.dedup(none).count() == 0
    assert {bytes(r.kept).decode() for r in found if r.doc_id == 6} == {"one"}


# 4


def test_line_dedup_counts_sites(spark, odd, none, odd_rows):
    line = "Shared footer line"
    rows = [(i, f"own {i}\n  {line} \n\nseldom {i % 3}", "en", f"s{i % 12}", 0) for i in range(30)] + [(100 + i, f"x{i}\nnine", "en", f"s{i % 9}", 0) for i in range(40)] + [(200 + i, "ten", "en", f"s{i}", 0) for i in range(10)]
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0  # the first place stays
    assert all(out[i].text == f"own {i}\n\nseldom {i % 3}" and out[i].n_removed == 1 and out[i].n_lines == 3 for i in range(1, 30))
    assert all(out[100 + i].n_removed == 0 for i in range(40))
    assert [out[200 + i].n_removed for i in range(10)] == [0] + [1] * 9
    kept = line_dedup.dedup(odd)
    assert kept.count() == len(odd_rows) and {"n_lines_", "n_removed_"} <= set(kept.columns)
    assert kept.where("doc_id = 3").first().text is None
    assert line_dedup.dedup(none).count() == 0


def test_exact_counts_are_for_lines_near_the_threshold(spark, monkeypatch):
    rows = [(1000 * k + i, f"line {k}\nown {k} {i}", "en", f"s{i}", 0) for k, n in enumerate((2, 5, 9, 10, 11, 16, 40, 300)) for i in range(n)]
    lines = line_dedup.shared(line_dedup.line_rows(spark.createDataFrame(rows, DOCS)))
    assert sorted(r.spread for r in line_dedup.boilerplate(lines).collect()) == pytest.approx([10, 11, 16, 40, 300], rel=0.1)
    monkeypatch.setattr(line_dedup, "ERRORS", 0.0)  # sketches alone decide: without an exact count an estimate of just under ten is lost
    assert {r.h for r in line_dedup.boilerplate(lines).collect()} <= {r.h for r in lines.collect()}
    sketched = {r.spread for r in line_dedup.boilerplate(lines).collect()}
    assert any(x != int(x) or x in (16, 40, 300) for x in sketched)


# 5


def test_license_words_and_phrases():
    s = licenses.Scanner()
    assert licenses.words("The MIT-License, été 2!") == ["the", "mit", "license", "été", "2"]
    w = licenses.words("mit license Mit License general public license apache license")
    assert sorted(s.base_in(w)) == [("apache", 7), ("gpl", 4), ("mit", 0), ("mit", 2)]


def test_templates_allow_only_marked_changes():
    a = licenses.compile_template("t", "alpha <<optional>>beta gamma<<end>> delta <<var max=2>> omega")
    accepts = lambda t: a.accepts_at(t.split(), 0) == len(t.split())
    assert all(map(accepts, ["alpha delta omega", "alpha beta gamma delta omega", "alpha delta x y omega"]))
    assert not any(map(accepts, ["alpha beta delta omega", "alpha delta x y z omega", "alpha delta", "alpha gamma delta omega"]))
    s = licenses.Scanner()
    plain = lambda t: licenses.words(re.sub(r"<<var[^>]*>>", "some one", re.sub(r"<<optional>>|<<end>>", "", t)))
    for label, template in licenses.TEMPLATES.items():
        for text in (template,) if isinstance(template, str) else template:
            whole = plain(text)
            assert [x[0] for x in s.templates_in(["intro", *whole, "end"])] == [label]
            a = licenses.compile_template(label, text)
            shortest = licenses.words(re.sub(r"<<var[^>]*>>", "", re.sub(r"<<optional>>.*?<<end>>", "", text, flags=re.S)))
            assert a.accepts_at(shortest, 0) == len(shortest)
            for k in {0, len(shortest) // 2, len(shortest) - 1}:  # a mandatory word changed, up to the last
                assert not [x for x in s.templates_in([*shortest[:k], "other", *shortest[k + 1 :]]) if x[0] == label]


def test_license_report_on_odd_rows(spark, odd, none, odd_rows):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "GNU General Public License, version 3"), (3, "mit license talk"), (4, None)], "doc_id bigint, text string")
    out = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.report(docs).collect()}
    assert out[1][:6] == (5, 1, 3, 3, "mit", "mit,mit-notice") and 0.5 < out[1][6] < 1
    assert out[2][:6] == (6, 1, 1, 1, "gpl", "gpl,gpl-3.0-notice") and 0.5 < out[2][6] < 1
    assert out[3] == (3, 1, 0, 0, "mit", "mit", 0.5) and out[4] == (0, 0, None, None, "", "", 0.0)
    more = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, "licensed under a CC BY 4.0 license"), (3, prose(20_000) + " mit license " + prose(20_000)), (3, "x"), (3, "x")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.labels) for r in licenses.report(more).collect()) == [(1, "cc-by-nc-notice"), (2, "cc-by-notice"), (3, ""), (3, ""), (3, "mit")]
    assert {(r.n_words, r.n_base, r.labels, r.score) for r in licenses.report(odd).collect() if r.doc_id in (3, 4, 9)} == {(0, 0, "", 0.0)}
    assert licenses.report(odd).count() == len(odd_rows) and licenses.report(none).count() == 0


# 6


def test_bpe_is_that_of_the_library(spark, odd, none, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = ["", "<|endoftext|> a<|endoftext|>", "don't I'LL  we're\n\n x", "a" * 3000, "é x　😀🏽", "x1y2 ²½ªº_-", prose(500)] + [f"a{chr(o)}b {chr(o)}{chr(o)} c" for o in [*range(0x250), 0x1680, 0x180E, 0x2028, 0x3000, 0xFEFF]]
    v = bpe.opened(bpe.default_path())
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert v.encode(t) == ids and v.decode(ids) == library.decode(ids, skip_special_tokens=False)
    out = bpe.round_trip(odd)
    assert out.count() == len(odd_rows) and bpe.round_trip(none).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd.where("doc_id > 2"))).collect()}
    assert back[10] == odd_rows[-1][1] and back[3] == ""


# 7


def test_warc_round_trip(spark):
    big = "<p>" + "y" * 1200
    inside = "z" * 500 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "q" * 700
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c/\r\nX: y", inside), (5, "http://d", "WARC/1.0\r\n"), (6, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "v", inside), (10, "w", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, payload string, salt int").repartition(2)
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()}
    last = {big: 6, inside: 9}
    expected = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html in last and last[html] != i
        expected[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[html] if again else None)
    assert found == expected
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_odd_rows_and_broken_chains(spark, tmp_path):
    long = prose(200_000)
    rows = [(1, "u" * 5000, long), (2, None, long), (2, None, long), (None, "n", "x" * 1500), (None, "n", "y"), (7, "v", "x" * 1500)]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id bigint, url string, html string, payload string, __salt int")
    found = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()))
    assert found == [(0, 1, "response", None), (0, 1500, "revisit", 7), (1, len(long), "revisit", 2), (2, len(long), "response", None), (2, len(long), "response", None), (7, 1500, "response", None)]
    path = warc.write(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    part = next((tmp_path / "w").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1200])  # the last record is cut
    (part.parent / f".{part.name}.crc").unlink()
    assert warc.read(spark, path).count() < len(rows)
    with pytest.raises(warc.Broken):
        warc.read(spark, path, strict=True)


def test_warc_uncompressed_files_in_blocks(spark):
    rows = [(i, f"http://h/{i}", prose(60) + ("\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc" if i % 5 == 0 else "")) for i in range(60)]
    path = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), scratch(spark, "t"), compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r.record_id: r.payload_digest for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"<urn:page:{i}>": hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


# 8


def plain_classes(rows, least=0.8, weighted=True):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        runs = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
        sets[i] = {(x, k) for x, n in runs.items() for k in range(n if weighted else 1)}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in sets}


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = prose(1, r)
    return " ".join(w)


def test_near_dedup_classes(spark, odd, none, odd_rows):
    r = random.Random(5)
    bases = [prose(r.randint(60, 300), r) for _ in range(12)]
    texts = [t for b in bases for t in [b, b, b.upper() + "!", *(edited(b, k, r) for k in (1, 1, 2, 3, 4, 6, 12))]] + ["", None, "a", "a", "b c", "b c"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    assert found == plain_classes(rows)
    kept = near_dedup.representatives(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(plain_classes(rows).values()))
    once = near_dedup.representatives(odd)
    assert once.columns == odd.columns and sorted(x.doc_id or -1 for x in once.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    assert near_dedup.representatives(none).count() == 0


def test_near_dedup_weighs_by_count(spark):
    phrase = "one two three four five six "
    rows = [(1, phrase * 3), (2, phrase * 300), (3, phrase * 290), (4, "x"), (5, "a " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5} == plain_classes(rows)
    assert {x.doc_id: x.class_id for x in near_dedup.classes(docs, weigh="one").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} == plain_classes(rows, weighted=False)


@pytest.mark.parametrize("edits", [(1, 2, 3, 4, 5, 6), (4, 5, 6, 7)])
def test_near_dedup_of_one_large_group(spark, edits):
    """Copies of one text that are similar to some copies only: rare elements, central leaders and what is left."""
    r = random.Random(len(edits))
    base = prose(150, r)
    vocabulary = base.split()[:20]
    def change(k):
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return " ".join(w)
    rows = list(enumerate(change(r.choice(edits)) for _ in range(300)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()} == plain_classes(rows)


def test_links_join_alike_in_one_task_and_in_rounds(spark):
    r = random.Random(9)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(30)]
    df = near_dedup.stored(spark.createDataFrame([(min(x), max(x)) for x in links if x[0] != x[1]], "a bigint, b bigint"), "t")
    one, many = (sorted(map(tuple, near_dedup.components(df, n).select("key", "class").collect())) for n in (1 << 20, 0))
    assert one == many and {c for k, c in one if k >= 1000} == {1000}


def test_representative_of_repeated_rows_is_defined(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "w"), (1, "a b c", "w"), (2, "a b c", "a"), (None, "q", "z"), (None, "q", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(4)
    assert sorted(((x.doc_id or 0, x.key) for x in near_dedup.representatives(docs).collect())) == [(0, "y"), (1, "w")]


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    e = r.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = r.uniform(0.1, 5, 400), r.uniform(0.1, 5, 400)
    wb[:200] = wa[:200]
    same = [near_dedup.signatures(e ^ np.uint64(k), wa, np.array([400])) == near_dedup.signatures(e ^ np.uint64(k), wb, np.array([400])) for k in range(30)]
    assert abs(np.mean(same) - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_signatures_do_not_depend_on_neighbours():
    r = np.random.default_rng(2)
    parts = [r.integers(1, 1 << 62, n).astype(np.uint64) for n in (1, 30, 2000)]
    together = near_dedup.signatures(np.concatenate(parts), np.ones(2031), np.array([1, 30, 2000]))
    assert all((near_dedup.signatures(p, np.ones(len(p)), np.array([len(p)]))[0] == row).all() for p, row in zip(parts, together))


# 9


def test_quality_base_counts():
    text = "a b c a b c x\n# b|b\n\na b c a b c x\n \n"
    m = quality.measures(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (len(words), sum(map(len, words)), 2, 1, len(marked))
    r = random.Random(1)
    for _ in range(50):
        w = [r.choice("ab") for _ in range(r.randint(0, 30))]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert quality.repeated_words([x.encode() for x in w]) == len({k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def test_quality_fit_finds_accurate_rules():
    r = random.Random(4)
    patterns, truth = Counter(), defaultdict(Counter)
    for _ in range(4000):
        good = r.random() < 0.8
        v = tuple((1 if r.random() < 0.97 else -1 if r.random() < 0.2 else 0) if good else (-1 if r.random() < 0.6 else 1) for _ in quality.RULES)
        patterns[v] += 1
        truth[v][good] += 1
    share, table, posterior = quality.fit(patterns)
    right = sum(truth[v][p >= 0.5] for v, p in posterior.items())
    assert abs(share - 0.8) < 0.1 and right / 4000 > 0.95


def test_quality_on_odd_rows(spark, odd, none, odd_rows):
    good = spark.createDataFrame([(i, ". ".join(prose(12).capitalize() for _ in range(9)) + ".") for i in range(60)] + [(100 + i, "*** ".join(prose(1) for _ in range(90)) + "###") for i in range(8)], "doc_id bigint, text string")
    out = quality.judge(good).collect()
    assert all(r.kept == (r.doc_id < 100) for r in out)
    rows = quality.judge(odd).collect()
    assert len(rows) == len(odd_rows) and {r.base_failed for r in rows if r.doc_id in (3, 4, 6, 7, 9)} == {True}
    assert quality.judge(none).count() == 0


# 10


def test_language_id_learns_from_the_open_part(spark, odd, none, odd_rows):
    tongues = {"aa": ["ka", "lo", "mi"], "bb": ["ter", "dre", "sol"], "cc": ["vi", "un", "po"]}
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choices(tongues[lang], k=2)) for _ in range(40)), lang) for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 34", "aa"), (1002, "kalo mika", None)], "doc_id bigint, text string, lang string")
    out = {x.doc_id: x for x in language_id.identify(docs).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0 and out[1002].lang_pred == "aa"
    assert language_id.identify(odd).count() == len(odd_rows) and language_id.identify(none).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {x.doc_id for x in kept.collect()} == {1, 2, None, 5, 6, 8, 10}


def test_language_sums_by_lookup_are_those_of_the_vectors():
    protos = {"x": np.ones(language_id.DIMENSIONS).tolist(), "y": np.arange(language_id.DIMENSIONS).astype(float).tolist()}
    text = "Some text, ünd more"
    ids = np.concatenate(list(language_id.trigrams(text)))
    bundle = language_id.gram_vectors(ids, language_id.DIMENSIONS).astype(float).sum(0)
    dots, length, n = language_id.Comparer(protos).dot(text)
    assert n == len(ids) and abs(length / np.linalg.norm(bundle) - 1) < 0.1 and np.allclose(dots, [bundle @ np.array(protos[k]) for k in ("x", "y")])


def test_language_id_knows_letters_and_scripts(spark):
    r = random.Random(8)
    words = {"el": ["και", "το", "του", "λόγος", "ήταν"], "ru": ["это", "слово", "было", "они", "который"], "he": ["של", "את", "היה", "דבר", "אשר"], "zh": ["的", "一是", "了我", "不人", "在他"], "en": ["the", "and", "word", "was", "which"]}
    rows = [(i, " ".join(r.choices(words[k], k=30)), k) for i in range(200) for k in [list(words)[i % 5]]]
    odd = [(1000, "½ ²", None), (1001, "Ⅷ ①", None), (1002, "a", None), (1003, "ё", None), (1004, "", None), (1005, " ".join(r.choices(["नमस्ते", "दुनिया", "भारत", "लोग"], k=40)), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    out = {x.doc_id: x.lang_pred for x in language_id.identify(docs).collect()}
    assert all(out[i] == k for i, _, k in rows)
    assert [out[i] for i in (1000, 1001, 1004)] == ["und"] * 3
    assert out[1002] != "und" != out[1003]
    kept = {x.doc_id for x in language_id.keep_identified(docs).collect()}
    assert kept == {i for i, *_ in rows} | {1002, 1003}  # an unknown script goes; a letter says too little


def test_trigrams_in_blocks(monkeypatch):
    text = prose(200) + "  Ünï, " + prose(50)
    whole = np.concatenate(list(language_id.trigrams(text)))
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (np.concatenate(list(language_id.trigrams(text))) == whole).all()


# The pipeline


def test_pipeline_is_its_stages(spark, tmp_path, odd):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "BPE"]
    item, base = prose(40), prose(150)
    rows = [(1, base, "en", "s1", 0), (2, base + " " + prose(3), "en", "s2", 0), (3, prose(60) + " " + item, "en", "s1", 0), (4, "99 !!", "en", "s1", 0), (5, prose(80), "en", "s3", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {1, 5}
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0
