"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time, then to the pairs of features whose
residuals gain most; each feature and each pair ends up as a lookup table over its bins, and a score is
the sigmoid of a sum of looked-up values, added for a whole batch at once.

Features come from the UTF-8 bytes of whole texts (lengths, shares of character classes, repetition of
words, word pairs and lines).  The model is fitted on the driver, on at most SAMPLE labelled rows, those
whose ids hash lowest; scoring runs in Arrow batches without any state between rows.

Defined results.  Null and empty texts have the features of an empty text and a score like any other.
A null label is no label; a document with several labels counts for each.  Without labelled rows every
score is 0.5.  Every row gives one row, repeated ids too; an empty table gives an empty result.
`keep_good` returns all columns of the rows that score at least 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, crc_mod, mix, slices, span_hashes, utf8, words

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 250, 80, 6, 0.08
FEATURES = ("log_words", "word_bytes", "upper", "punctuation", "digits", "symbols", "exclaimed", "distinct_words", "repeats", "distinct_pairs", "repeated_lines", "line_bytes", "stops", "short_words", "non_ascii", "capitalised", "single_bytes", "spaces")
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"|#*$%&~^=<>{}[]\\_@+")] = 1


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for a, b in ranges:
        out[a : b + 1] = 1
    return out


_CLASSES = {
    "upper": _class((65, 90)), "punctuation": _class((33, 47), (58, 64), (91, 96), (123, 126)), "digits": _class((48, 57)), "symbols": _SYMBOL, "exclaimed": _class((33, 33), (63, 63)), "non_ascii": _class((128, 255)), "spaces": _class((9, 13), (32, 32)),
}


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The number of different hashes in each row."""
    _, first = np.unique(mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(rows[first], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A matrix of FEATURES for the texts in `data`."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some, one = np.maximum(size, 1), np.zeros((n, len(FEATURES)))
    put = lambda name, value: one.__setitem__((slice(None), FEATURES.index(name)), value)
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    for name, kind in _CLASSES.items():
        put(name, sums(kind[data]) / some)
    starts, ends, before = words(data, offsets)
    count = np.diff(before)
    each = np.maximum(count, 1)
    row = np.repeat(np.arange(n), count)
    length = ends - starts
    hashes = span_hashes(data, starts, ends)
    by_row = lambda flags: np.bincount(row, weights=flags, minlength=n)
    put("log_words", np.log1p(count))
    put("word_bytes", by_row(length) / each)
    put("distinct_words", _distinct(row, hashes, n) / each)
    put("short_words", by_row(length <= 3) / each)
    put("single_bytes", by_row(length == 1) / each)
    put("capitalised", by_row(_CLASSES["upper"][data[starts]]) / each)
    put("stops", sums(data == 46) / each)
    same = row[1:] == row[:-1]
    put("repeats", np.bincount(row[1:][same & (hashes[1:] == hashes[:-1])], minlength=n) / each)
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    put("distinct_pairs", _distinct(row[1:][same], pairs, n) / np.maximum(count - 1, 1))
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][size > 0], breaks + 1)
    line_start = line_start[(line_start < len(data))]
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[1:][np.searchsorted(offsets, line_start, "right") - 1])
    line_end = line_end - (data[line_end - 1] == 10)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    put("repeated_lines", 1 - _distinct(line_row, span_hashes(data, line_start, line_end), n) / np.maximum(lines, 1))
    put("line_bytes", np.log1p(size / np.maximum(lines, 1)))
    return one


@dataclass
class Model:
    """Lookup tables: edges of the bins by feature, a table for each feature and for some pairs."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            at = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[at[j]]
            for (j, k), t in self.pairs.items():
                total += t[at[j], at[k]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over the bins of one feature: the value of each bin."""

    def split(a: int, b: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return 0.0, a
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
        k = int(np.argmax(gains))
        return float(gains[k]), a + k + 1

    gain, cut = split(0, len(g))
    cuts = [0, len(g)] if gain <= 0 else [0, cut, len(g)]
    if gain > 0:
        more = max(split(0, cut), split(cut, len(g)))
        if more[0] > 0:
            cuts = sorted({*cuts, more[1]})
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of each of two features, four leaves: the best gain of a few cuts, and the values."""
    best, out = 0.0, np.zeros_like(g)
    sum_g, sum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = range(0, g.shape[0] - 1, max(1, g.shape[0] // 12)), range(0, g.shape[1] - 1, max(1, g.shape[1] // 12))
    for i in rows:
        for j in cols:
            quads = [(s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]) for s in (sum_g, sum_h)]
            gain = sum(_gain(a, b) for a, b in zip(*quads, strict=True)) - _gain(sum_g[-1, -1], sum_h[-1, -1])
            if gain > best:
                best, leaves = gain, [_leaf(a, b) for a, b in zip(*quads, strict=True)]
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the main effects, then of the PAIRS pairs that gain most on what is left."""
    if not len(y):
        return Model()
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    at, total = model.bins(x), np.full(len(y), model.intercept)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]

    def slopes():
        prob = 1 / (1 + np.exp(-total))
        return y - prob, np.maximum(prob * (1 - prob), 1e-6)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[j], g, sizes[j]), np.bincount(at[j], h, sizes[j]))
            table += step
            total += step[at[j]]
    both = lambda j, k, w: np.bincount(at[j] * sizes[k] + at[k], w, sizes[j] * sizes[k]).reshape(sizes[j], sizes[k])
    g, h = slopes()
    ranked = sorted(((_pair_tree(both(j, k, g), both(j, k, h))[0], j, k) for j in range(len(sizes)) for k in range(j)), reverse=True)
    model.pairs = {(j, k): np.zeros((sizes[j], sizes[k])) for gain, j, k in ranked[:PAIRS] if gain > 0}
    for _ in range(PAIR_ROUNDS if model.pairs else 0):
        for (j, k), table in model.pairs.items():
            g, h = slopes()
            step = RATE * _pair_tree(both(j, k, g), both(j, k, h))[1]
            table += step
            total += step[at[j], at[k]]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, y, text) of at most `size` labelled documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    few = known.select("doc_id", F.col("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `size` rows


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, x array<double>"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("y")[a:b], flat], schema=out)

    rows = labelled_sample(docs, labels, size).mapInArrow(run, schema).toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit(np.stack(rows.x.to_numpy()) if len(rows) else np.zeros((0, len(FEATURES))), rows.y.to_numpy())


def scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    parts = [model.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    out = arrow_schema(schema)
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            s = scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=out)

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least 0.5, with all their columns."""
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
