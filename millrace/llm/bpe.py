"""Byte-pair encoding and decoding with a priority queue.

The text is cut into pieces by the byte-level pattern; a piece's symbols form a doubly linked list. A queue holds the
mergeable neighbours by rank, then place; entries whose symbols have changed meanwhile are stale and skipped. Decoding
concatenates the vocabulary's byte strings. Pieces that come again are answered from a bounded memory,
which a worker keeps from task to task.

Edge cases: null and empty texts give no ids; very long texts are encoded whole, and a piece of n bytes takes n log n steps;
repeated rows are encoded one by one; equal ranks merge from the left; an empty table gives an empty result; further columns
are ignored, whatever their names. Bytes that aren't UTF-8 decode to U+FFFD. An added token in the text is one id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, need

#: Fixed value: the pattern of byte-level pre-tokenising.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in each of a worker's two memories, some 150 MB together: with a third as many, encoding takes over half as long again.
REMEMBERED = 300_000
#: Pieces longer than this aren't remembered.
REMEMBER_LENGTH = 64
#: A queue entry is rank * 2**PLACE + place.
PLACE = 40
PLACES = (1 << PLACE) - 1


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, text: str) -> None:
        data = json.loads(text)
        model = data["model"]
        back = {c: b for b, c in byte_letters().items()}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in model["vocab"].items()}
        ids = model["vocab"]
        self.single = [ids.get(byte_letters()[b], -1) for b in range(256)]
        self.size = max(ids.values()) + 1
        self.rank_of: dict[int, int] = {}
        self.made_of: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault(ids[a] * self.size + ids[b], rank)
            self.made_of.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        size = max(self.bytes) + 1
        self.strings = [str(i) for i in range(size)]
        self.byte_list = [self.bytes.get(i, b"") for i in range(size)]
        self.pieces = regex.compile(PIECES)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        symbol = [self.single[b] for b in piece]
        if -1 in symbol:
            raise ValueError("the vocabulary lacks a byte")
        n, size, rank_of, made_of = len(symbol), self.size, self.rank_of, self.made_of
        if n == 1:
            return (symbol[0],)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rank << PLACE) + i for i in range(n - 1) if (rank := rank_of.get(symbol[i] * size + symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & PLACES, entry >> PLACE
            j = after[i]
            if j < 0 or symbol[i] < 0 or rank_of.get(symbol[i] * size + symbol[j]) != rank:
                continue  # stale
            symbol[i] = made = made_of[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of.get(made * size + symbol[k])) is not None:
                    heapq.heappush(queue, (rank << PLACE) + i)
            if (h := before[i]) >= 0 and (rank := rank_of.get(symbol[h] * size + made)) is not None:
                heapq.heappush(queue, (rank << PLACE) + h)
        return tuple([s for s in symbol if s >= 0])

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text) or self.merge(text.encode("utf-8", "replace"))
        if len(text) <= REMEMBER_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.memory, self.older = {}, self.memory  # what is in use moves over again
            self.memory[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        piece = self.piece
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.added:
                out.append(self.added[part])
            else:
                for p in self.pieces.findall(part):
                    out += self.memory.get(p) or piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.byte_list
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def opened(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _each(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    """row(vocabulary, ids) -> values. The file is part of the installation that every worker has."""
    need(docs, "doc_id", "text")

    def make():
        vocabulary = opened(path or default_path())

        def rows(doc_id, text) -> Iterator[tuple]:
            yield (doc_id, *row(vocabulary, vocabulary.encode(text or "")))

        return rows

    return map_rows(docs.select("doc_id", F.col("text").cast("string")), make, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids."""
    return _each(docs, path, "ids array<int>", lambda _, ids: (ids,))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids give an empty text."""
    need(encoded, "doc_id", "ids")

    def make():
        vocabulary = opened(path or default_path())
        return lambda doc_id, ids: [(doc_id, vocabulary.decode(ids or []))]

    return map_rows(encoded.select("doc_id", "ids"), make, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text they decode to."""

    def row(vocabulary: Vocabulary, ids: list[int]) -> tuple:
        strings = vocabulary.strings
        joined = ",".join([strings[i] for i in ids])
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest()

    return _each(docs, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
