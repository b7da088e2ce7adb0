"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the vote patterns of all documents
estimates how often each rule gives each vote on good and on bad documents; the posterior probability of good decides,
instead of a demand that all rules pass. There are at most 3 ** len(RULES) patterns, so what the driver holds is bounded.

Words are runs of characters other than the six ASCII white-space characters. Edge cases: a null text has no words and
fails the base rules; empty tables give empty results; repeated rows are judged alike, each with its weight in the fit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import map_rows, need

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT = 50, 50
RULES = ("length", "word_length", "symbols", "dup_lines", "letters", "distinct", "sentences", "line_length")
#: Pseudo-counts of the fit, of votes bad, none and good: bad documents may pass most rules, good ones seldom fail one.
PRIOR = {"bad": (4.0, 1.0, 5.0), "good": (0.5, 2.5, 97.0)}
ROUNDS, CLOSE = 200, 1e-9


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    code = pair[:-1] * np.int64(len(number)) + ids[2:]
    inverse, count = np.unique(code, return_inverse=True, return_counts=True)[1:]
    twice = count[inverse] > 1
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= twice
    return int(marked.sum())


def measures(text: str | None) -> dict[str, int]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # of bytes: at the six ASCII white-space characters
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": len(text or "") - spaces,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
        "n_ended": sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines),
        "n_letters": len(raw.translate(None, NOT_LETTERS)),
    }


#: ASCII characters that aren't letters, and all bytes of a UTF-8 character but its first: other characters count as letters.
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha()) + bytes(range(128, 192))


def base_failed(m: dict[str, int]) -> bool:
    return m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"]


def band(value: float, bad_below: float, good_from: float, good_to: float = math.inf, bad_above: float = math.inf) -> int:
    return -1 if value < bad_below or value > bad_above else 1 if good_from <= value <= good_to else 0


def votes(m: dict[str, int]) -> tuple[int, ...]:
    """One vote for each of RULES."""
    n, lines = m["n_words"], m["n_lines"]
    if not n:
        return (-1,) * len(RULES)
    return (
        band(n, LEAST_WORDS, 80),
        band(m["word_chars"] / n, 2.5, 3, 10, 14),
        -1 if m["n_symbols"] > 0.15 * n else 1 if m["n_symbols"] <= 0.05 * n else 0,
        -1 if m["n_dup_lines"] > max(2, 0.4 * lines) else 1 if m["n_dup_lines"] <= 0.1 * lines else 0,
        band(m["n_letters"] / max(1, m["word_chars"]), 0.75, 0.88),
        band(m["n_distinct"] / n, min(0.2, 20 / n**0.5 / 10), 0.3),
        -1 if m["n_ended"] < 0.1 * lines else 1 if m["n_ended"] >= 0.5 * lines else 0,
        -1 if n / lines < 2 else 1 if n / lines >= 5 else 0,
    )


def fit(patterns: dict[tuple[int, ...], int]) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Share of good documents, P(vote | class) as [rule, class, vote + 1], and the posterior of good by pattern."""
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), {}
    keys = sorted(patterns)
    v = np.array(keys)
    weight = np.array([patterns[k] for k in keys], float)
    onehot = np.stack([(v == x) for x in (-1, 0, 1)], axis=2).astype(float)
    prior = np.array([PRIOR["bad"], PRIOR["good"]])
    good = np.where((v < 0).any(1), 0.1, 0.9)  # begins with the all-must-pass rule, as a guess only
    share, table = 0.5, None
    for _ in range(ROUNDS):
        by_class = np.stack([(1 - good) * weight, good * weight])
        table = np.einsum("cp,prv->rcv", by_class, onehot) + prior
        table /= table.sum(2, keepdims=True)
        share = (by_class[1].sum() + 1) / (weight.sum() + 2)
        logs = np.einsum("prv,rcv->pc", onehot, np.log(table)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        moved, good = np.abs(new - good).max(), new
        if moved < CLOSE:
            break
    return float(share), table, {k: float(p) for k, p in zip(keys, good)}


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, and the rules' votes as a string of '+', '-' and '0'."""
    need(docs, "doc_id", "text")

    def rows(doc_id, text) -> Iterable[tuple]:
        m = measures(text)
        yield (doc_id, *(m[k] for k in NAMES), base_failed(m), "".join("-0+"[x + 1] for x in votes(m)))

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", F.col("text").cast("string")), lambda: rows, f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in NAMES) + ", base_failed boolean, votes string")


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds posterior and kept: not base_failed and posterior >= least."""
    measured = stored(measure(docs), "quality")
    counted = measured.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    posterior = fit(Counter({tuple("-0+".index(x) - 1 for x in r[0]): r[1] for r in counted}))[2]
    known = {"".join("-0+"[x + 1] for x in k): p for k, p in posterior.items()}
    table = docs.sparkSession.createDataFrame([(k, round(p, 9)) for k, p in known.items()], "votes string, posterior double")
    joined = measured.join(F.broadcast(table), "votes", "left")  # as many rows as patterns
    return joined.select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior", "votes")
