"""What a deployment plugs in: embedders, pair scorers and text models. The defaults are deterministic and need nothing.

The first text model that is asked for serves all later requests too, whatever name they give; reset() forgets it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .functions.text import index_tokens

SearchFunction = Callable[[DataFrame, int], DataFrame]


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class PairScorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class TextModel(Protocol):
    def __call__(self, prompt: Column) -> Column: ...


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Unit vectors of signed token counts by hash: built-in expressions give a code to each token, numpy adds them up."""

    @F.arrow_udf(returnType=ArrayType(FloatType()))
    def summed(codes: pa.Array) -> pa.Array:
        n = pc.list_value_length(codes).to_numpy()
        code = codes.flatten().to_numpy()
        cell = np.repeat(np.arange(len(n)) * dimensions, n) + code // 2
        sums = np.bincount(cell, code % 2 * 2.0 - 1, minlength=len(n) * dimensions).reshape(len(n), dimensions)
        norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        unit = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dimensions), pa.array(unit.ravel()))

    def of_tokens(tokens: Column) -> Column:
        place = lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int")
        sign = lambda t: F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)).cast("int")
        return summed(F.transform(tokens, lambda t: place(t) * 2 + sign(t)))

    def embed(text: Column) -> Column:
        return of_tokens(index_tokens(F.coalesce(text, F.lit(""))))

    embed.of_tokens = of_tokens  # for those who have the tokens of the lexical index
    return embed


def lexical_scorer(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text has."""
    q = F.array_distinct(index_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, index_tokens(text))) / F.size(q)).otherwise(0.0)


def echo_model(prompt: Column) -> Column:
    """The stand-in for a text model: the prompt's first line."""
    return F.substring_index(prompt, "\n", 1)


@dataclass
class Models:
    """One set of plug-ins; safety and grade give a verdict column, None leaves the question to the rules."""

    embed: Embedder = hashing_embedder()
    score: PairScorer = lexical_scorer
    rewrite: TextModel | None = None
    hypothesis: TextModel | None = None
    answer: TextModel | None = None
    safety: TextModel | None = None
    grade: PairScorer | None = None


_made: dict[str, object] = {}


def shared(kind: str, make: Callable[[], object]) -> object:
    """The one model of a kind in this process."""
    if kind not in _made:
        _made[kind] = make()
    return _made[kind]


def reset() -> None:
    _made.clear()


def prompt_key(template: str) -> str:
    return hashlib.sha256(template.encode()).hexdigest()[:16]


#: Prompts are content: these short ones are defaults, and any may be replaced.
PROMPTS = {
    "answer": "Answer from the context only.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:",
    "rewrite": "History:\n{history}\n\nMake this question stand alone: {question}",
    "hypothesis": "Write a short passage that would answer: {question}",
    "fallback": "Answer in general terms: {question}",
}


def filled(name: str, **parts: Column) -> Column:
    out = F.lit(PROMPTS[name])
    for k, c in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(c, F.lit("")))
    return out
