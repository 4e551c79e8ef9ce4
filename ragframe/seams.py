"""Seams for models (survey 2.J, C1, A31): protocols as plain callables, with deterministic stand-ins.

No neural model ships with this library; the stand-ins make every pipeline runnable and testable, and
their scores mean nothing beyond that.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from ragframe.functions import fixed

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[str, str], float]
ScoreAll = Callable[[list[tuple[str, str]]], list[float]]
Generate = Callable[[str, str], str]


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Counts of hashed tokens with signs, of length 1: texts with the same words are near."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for token in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(token.encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


#: Bytes of text that are strings of Python at once, beside those of Arrow.
TEXT_BYTES = 1 << 18


def pieces(columns: Sequence[pa.Array], most: int):
    """Rows of columns of texts as tuples of strings, nulls as empty, in lists of at most `most` rows and some TEXT_BYTES."""
    rows, size = [], 0
    for row in zip(*columns, strict=True):
        texts = tuple(x.as_py() or "" for x in row)
        rows.append(texts)
        size += sum(map(len, texts))
        if len(rows) >= most or size >= TEXT_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def embed(text: Column, model: Embed = hashed_embedding, passage: bool = True, batch: int = 32) -> Column:
    """Vectors of texts, in batches; passages and queries get their prefixes."""

    def run(x: pa.Array) -> pa.Array:
        vectors = [np.asarray(model([t for (t,) in rows]), np.float32) for rows in pieces([x], batch)]
        sizes = [v.shape[1] for v in vectors for _ in v]
        flat = np.concatenate([v.ravel() for v in vectors]) if vectors else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(FloatType()))(F.concat(F.lit(fixed.PASSAGE_PREFIX if passage else fixed.QUERY_PREFIX), text))


def lexical_score(query: str, text: str) -> float:
    """A stand-in for a cross-encoder: the share of the query's words that the text has, on a logit-like scale."""
    words = set(re.findall(r"\w+", query.lower()))
    share = len(words & set(re.findall(r"\w+", text.lower()))) / max(1, len(words))
    return round(8 * share - 4, 6)


@dataclass(frozen=True)
class Reranker:
    """A model by name; load() gives a function from a list of (query, text) to their scores, and runs in the workers.

    A name stands for one model in all of a worker's life, unless there is nothing to load and it isn't kept.
    """

    name: str
    load: Callable[[], ScoreAll]
    kept: bool = True


def pairwise(model: Score) -> Reranker:
    """A function of one pair as a model that has nothing to load."""
    return Reranker(model.__qualname__, lambda: lambda pairs: [model(q, t) for q, t in pairs], kept=False)


_LOADED: dict[str, ScoreAll | Exception] = {}  # of this worker process, which serves many tasks


def loaded(model: Reranker) -> ScoreAll | Exception:
    """The model, loaded at its first use in a worker, or why it can't be."""
    if not model.kept:
        return model.load()
    if model.name not in _LOADED:
        try:
            _LOADED[model.name] = model.load()
        except Exception as e:  # noqa: BLE001  what a foreign model raises can't be known
            _LOADED[model.name] = e
    return _LOADED[model.name]


def _scored(pairs: list[tuple[str, str]], models: Sequence[Reranker]) -> list[tuple]:
    """(score, model, error) of each pair: by the first model that can; error is what the ones before it said."""
    done: dict[int, tuple] = {}
    said = [""] * len(pairs)

    def ask(f: ScoreAll, name: str, places: list[int]) -> bool:
        try:
            scores = [float(v) for v in f([pairs[i] for i in places])]
            if len(scores) != len(places) or not all(map(math.isfinite, scores)):
                raise ValueError("no score")
        except Exception as e:  # noqa: BLE001
            if len(places) == 1:
                said[places[0]] += f"{name}: {e}; "
            return False
        done.update((i, (v, name, said[i] or None)) for i, v in zip(places, scores, strict=True))
        return True

    for model in models:
        todo = [i for i in range(len(pairs)) if i not in done]
        if not todo:
            break
        f = loaded(model)
        if isinstance(f, Exception):
            for i in todo:
                said[i] += f"{model.name}: {f}; "
        elif not ask(f, model.name, todo):  # which pair it is that fails shows one by one
            for i in todo if len(todo) > 1 else ():
                ask(f, model.name, [i])
    return [done.get(i, (None, None, said[i] or None)) for i in range(len(pairs))]


def rerank(query: Column, text: Column, models: Sequence[Reranker], batch: int = 32) -> Column:
    """struct<score, model, error> for each pair, scored in batches by the first model, and where that fails by the next.

    A model is loaded once in a worker, when first needed. What fails depends on the pair alone, not on its batch; a
    pair that every model fails has a null score. Nulls count as empty.
    """

    kind = pa.struct([("score", pa.float64()), ("model", pa.string()), ("error", pa.string())])

    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        found = [row for pairs in pieces([q, t], batch) for row in _scored(pairs, models)]
        return pa.array([dict(zip(("score", "model", "error"), row, strict=True)) for row in found], kind)

    run.__annotations__ = {"q": pa.Array, "t": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "score double, model string, error string").asNondeterministic()(query, text)


def extractive_answer(system: str, user: str) -> str:
    """A stand-in for a generator: the first sentence of the first fragment, with its marker."""
    found = re.search(r"<fragmento>\n\[(\d+)\][^\n]*\n(.+?)\n</fragmento>", user, re.S)
    if not found:
        return fixed.ABSTENTION
    return re.split(r"(?<=[.!?])\s+", found[2].strip())[0] + f" [{found[1]}]"


def generate(system: Column, user: Column, model: Generate = extractive_answer) -> Column:
    """The model's text for each pair of prompts; null where it fails.

    The column isn't deterministic, so that a filter on it doesn't ask the model a second time.
    """

    def run(s: pa.Array, u: pa.Array) -> pa.Array:
        def one(a, b):
            try:
                return model(a, b)
            except Exception:  # noqa: BLE001
                return None

        return pa.array((one(*pair) for rows in pieces([s, u], 1) for pair in rows), pa.string())

    run.__annotations__ = {"s": pa.Array, "u": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType()).asNondeterministic()(system, user)
