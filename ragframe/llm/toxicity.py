"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: whole words and beginnings of words (3 to 7 bytes) that toxic texts hold far
oftener than others, with their log ratios as weights; Spark counts them over the labelled sample.  Words are
runs of letters in lower case; those with digits or marks within are also looked up as these are read (1 as i, $ as s).
Features are densities of the lexicon, its hits near words of the second person, capitals, punctuation and
signs of obfuscation, all worked out for a whole batch at once.

The labelled sample (SAMPLE rows at most, those whose ids hash lowest) is split into FOLDS.  A text's
features for training come from the lexicon of the other folds, and the scores that the calibration learns from
are those of trees that haven't seen the text; so neither is fitted to what it has memorised.  The trees,
at most 2 ** DEPTH leaves each, are grown on the driver from histograms of bins.

Defined results.  Null and empty texts have the features of an empty text and a score like any other.  A null
label is no label; a document with several labels counts for each.  Without labelled rows, or with labels of
one kind only, every score is that kind's share (0 without any).  Every row gives one row, repeated ids too; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, crc_mod, runs, saved, slices, spans, utf8

#: Labelled rows that the model is fitted on, entries of the lexicon, texts an entry must be in; all at most or at least.
SAMPLE, LEXICON, SEEN = 20_000, 5_000, 3
#: Log ratio from which an entry counts, after an allowance for chance.
RATIO = 2.0
FOLDS, TREES, DEPTH, RATE, BINS, LEAST = 4, 120, 3, 0.1, 32, 1.0
THRESHOLD = 0.7
#: Words between a hit and a word of the second person, at most; words whose findings a task remembers; length of a word of the lexicon.
NEAR, PREFIXES = 5, (3, 4, 5, 6, 7)
#: Lengths in bytes of words that are entries of the lexicon, at most.
LONGEST = 64
SECOND = "you your yours yourself yourselves ya u ur du dich dir dein deine deinen deiner deinem ihr euch euer eure sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo tuya tus usted ustedes vosotros vuestro vuestra os".split()
FEATURES = ("density", "hits", "strongest", "distinct", "near", "read_hits", "lines", "second", "capitals", "shouted", "exclaimed", "asked", "marks", "runs_of_marks", "mixed", "stretched", "starred", "spelled_out", "log_words")
_TABLE = lambda chosen: np.isin(np.arange(256), np.frombuffer(chosen, np.uint8))
_UPPER, _LETTER = _TABLE(bytes(range(65, 91))), _TABLE(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_MARK = _TABLE(b"!\"#$%&'()*+,/:;<=>?@[\\]^`{|}~")
#: Digits and marks that stand for letters: beside a letter, and only between two.
_READ = np.arange(256, dtype=np.uint8)
_READ[list(b"01345789@$!|+")] = list(b"oieastbgasiit")
_BESIDE, _BETWEEN = _TABLE(b"01345789@$"), _TABLE(b"!|+")


def lowered(text: np.ndarray) -> np.ndarray:
    """UTF-8 in lower case: A to Z, and the capitals of Latin-1."""
    after = np.concatenate(([0], text[:-1])) == 0xC3
    return np.where((text >= 65) & (text <= 90) | after & (text >= 0x80) & (text <= 0x9E) & (text != 0x97), text + np.uint8(32), text)


def beside(flags: np.ndarray, by: int) -> np.ndarray:
    """The flag of the byte `by` places on (before, if negative); False beyond the ends."""
    out = np.zeros(len(flags), bool)
    if by > 0:
        out[:-by] = flags[by:]
    else:
        out[-by:] = flags[:by]
    return out


@dataclass
class Read:
    """Texts as lower-cased words: where they are, the distinct ones and each word's number among them."""

    rows: int
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    words: pa.Array
    number: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> Read:
        """Runs of letters; with `only` those that hold one of these bytes."""
        start, end, before = runs(_LETTER[text], offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        if only is not None:
            at = np.flatnonzero(only)
            some = np.searchsorted(at, end) > np.searchsorted(at, start)
            start, end, row = start[some], end[some], row[some]
        coded = spans(text, start, end).dictionary_encode()
        return cls(len(offsets) - 1, start, end, row, coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))

    def entries(self):
        """For each kind of entry (0: whole words, else the length of a beginning) those of the distinct words, null where there is none."""
        size = pc.binary_length(self.words)
        yield 0, pc.if_else(pc.less_equal(size, LONGEST), self.words, pa.scalar(None, pa.binary()))
        for k in PREFIXES:
            yield k, pc.if_else(pc.greater_equal(size, k), pc.binary_slice(self.words, 0, k), pa.scalar(None, pa.binary()))


def read_as(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text with digits and marks within words read as letters, and where."""
    letter, changed = _LETTER[text], np.zeros(len(text), bool)
    for _ in range(2):  # two in a row at most
        before, after = beside(letter, -1), beside(letter, 1)
        new = ~letter & ((_BESIDE[text] & (before | after)) | (_BETWEEN[text] & before & after))
        letter, changed = letter | new, changed | new
    return np.where(changed, _READ[text], text), changed


def _chunks(batch, column: int):
    """Pieces of a batch of bounded bytes: rows a to b, their text and its offsets."""
    data, offsets = utf8(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, y, digest, fold, text) of at most `size` labelled documents outside the held-out fold, written once; copies share a fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    few = known.select("doc_id", F.col("toxic").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(size)
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    return saved(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", digest.alias("digest"), F.pmod(digest, F.lit(FOLDS)).cast("int").alias("fold"), "text"), "toxicity-sample")  # at most `size` rows


def lexicons(sample: DataFrame) -> list[dict[tuple[int, bytes], float]]:
    """A lexicon without each fold, then that of all: entries and the log ratios of the shares of texts that hold them; copies count once."""
    sample = sample.dropDuplicates(["digest", "y"]).select("y", "fold", "text")
    schema = "kind int, entry binary, fold int, toxic long, clean long"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            y, fold = batch.column(0).to_numpy(zero_copy_only=False) > 0, batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, text, own in _chunks(batch, 2):
                read = Read.of(lowered(text), own)
                n = max(1, len(read.words))
                pairs = np.unique(read.row * n + read.number)  # distinct words of each text
                word, doc = pairs % n, pairs // n
                for kind, entries in read.entries():
                    coded = entries.dictionary_encode()
                    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
                    some, m = code >= 0, max(1, len(coded.dictionary))
                    held = np.unique(doc[some] * m + code[some])
                    whose, code = held // m, held % m
                    key, back = np.unique(code * FOLDS + fold[a:b][whose], return_inverse=True)
                    toxic = np.bincount(back, y[a:b][whose], len(key)).astype(np.int64)
                    columns = [pa.array(np.full(len(key), kind, np.int32)), coded.dictionary.take(pa.array(key // FOLDS)), pa.array((key % FOLDS).astype(np.int32)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(key)) - toxic)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    counts = sample.mapInArrow(run, schema).groupBy("kind", "entry").pivot("fold", list(range(FOLDS))).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).fillna(0)
    sizes = {(r.fold, r.y > 0): r["count"] for r in sample.groupBy("fold", "y").count().collect()}  # FOLDS rows a label
    total = lambda y, skip: sum(sizes.get((f, y), 0) for f in range(FOLDS) if f != skip)
    found = []
    for skip in [*range(FOLDS), None]:
        held = lambda c, skip=skip: sum((F.col(f"{f}_{c}") for f in range(FOLDS) if f != skip), F.lit(0))
        t, c, of_t, of_c = held("t"), held("c"), total(True, skip), total(False, skip)
        found.append((F.log((t + 0.5) / (of_t + 1.0)) - F.log((c + 0.5) / (of_c + 1.0)) - F.sqrt(1.0 / t), t, f"w{len(found)}"))
    columns = [F.when((t >= SEEN) & (ratio > RATIO), ratio).alias(name) for ratio, t, name in found]
    table, books = saved(counts.select("kind", "entry", *columns).filter(F.coalesce(*[F.col(name) for *_, name in found]).isNotNull()), "toxicity-lexicon"), []
    for *_, name in found:
        rows = table.filter(F.col(name).isNotNull()).orderBy(F.desc(name), "kind", "entry").select("kind", "entry", name).limit(LEXICON).collect()  # LEXICON rows
        books.append({(r.kind, bytes(r.entry)): r[name] for r in rows})
    return books


class Reader:
    """Features of texts by one lexicon."""

    def __init__(self, lexicon: dict[tuple[int, bytes], float]):
        self.kinds = {}
        for kind in (0, *PREFIXES):
            own = [(e, w) for (k, e), w in lexicon.items() if k == kind]
            if own:
                self.kinds[kind] = pa.array([e for e, _ in own], pa.binary()), np.array([w for _, w in own] + [0.0])
        self.second = pa.array([w.encode() for w in SECOND], pa.binary())

    def weights(self, read: Read) -> np.ndarray:
        """For each word the largest weight of its entries."""
        best = np.zeros(len(read.words))
        for kind, entries in read.entries():
            if kind in self.kinds:
                known, weight = self.kinds[kind]
                best = np.maximum(best, weight[pc.fill_null(pc.index_in(entries, known), len(weight) - 1).to_numpy(zero_copy_only=False)])
        return best[read.number]

    def features(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        small = lowered(text)
        read = Read.of(small, offsets)
        n, row, weight = read.rows, read.row, self.weights(read)
        again = Read.of(*(lambda t, changed: (t, offsets, changed))(*read_as(small)))
        again_weight = self.weights(again)
        count = np.bincount(row, minlength=n)
        some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
        by = lambda x: np.bincount(row, x, n)
        read_by = lambda x: np.bincount(again.row, x, n)
        hit = weight > 0
        strongest = np.zeros(n)
        np.maximum.at(strongest, row[hit], weight[hit])
        np.maximum.at(strongest, again.row, again_weight)
        distinct = np.zeros(n, np.int64)
        for own, some_of in ((read, hit), (again, again_weight > 0)):
            different = max(1, len(own.words))
            distinct += np.bincount(np.unique(own.row[some_of] * different + own.number[some_of]) // different, minlength=n)
        second = pc.is_in(read.words, self.second).to_numpy(zero_copy_only=False)[read.number] if len(read.words) else np.zeros(0, bool)
        near, of, at = np.zeros(len(row), bool), np.flatnonzero(second), np.flatnonzero(hit)
        if len(of):
            for side in (np.searchsorted(of, at) - 1, np.searchsorted(of, at)):
                other = of[np.clip(side, 0, len(of) - 1)]
                near[at] |= (np.abs(other - at) <= NEAR) & (row[other] == row[at])
        sums = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), offsets))
        length = read.end - read.start
        letter, upper, mark = _LETTER[text], _UPPER[text], _MARK[text]
        capitals = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
        shouted = (length > 2) & (capitals[read.end] - capitals[read.start] == length)
        same = lambda by: np.concatenate((np.zeros(by, bool), small[by:] == small[:-by]))[: len(small)]
        stretched = letter & (small < 128) & same(1) & same(2)
        starred = (text == 42) & (beside(letter, -1) & beside(letter, 1))
        mixed = ~letter & (_BESIDE | _BETWEEN)[text] & beside(letter, -1) & beside(letter, 1)
        spelled = np.zeros(len(row), bool)
        if len(row) > 2:
            spelled[2:] = (length[2:] == 1) & (length[1:-1] == 1) & (length[:-2] == 1) & (row[2:] == row[:-2])
        return np.column_stack(
            [
                (by(weight) + read_by(again_weight)) / some, by(hit) + read_by(again_weight > 0), strongest, distinct, by(near * weight), read_by(again_weight > 0) / some, (by(hit) + read_by(again_weight > 0)) / (sums(text == 10) + 1), by(second) / some, sums(upper) / size, by(shouted) / some,
                sums(text == 33) / size, sums(text == 63) / size, sums(mark) / size, sums(mark & beside(mark, -1)) / size, sums(mixed) / some, sums(stretched) / some, sums(starred) / some, by(spelled) / some, np.log1p(count),
            ]
        )


@dataclass
class Trees:
    """Boosted trees: for each level of each tree the split of every node, then the leaves."""

    start: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting on histograms; a node without a gain sends all its rows to the left."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    out = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.concatenate((np.quantile(c, np.linspace(0, 1, BINS)[:-1]), np.quantile(c[c > c.min()], np.linspace(0, 1, BINS // 2)[:-1]) if (c > c.min()).any() else []))) for c in x.T]
    width = max(len(e) for e in edges) + 1
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    flat = binned + np.arange(x.shape[1]) * width
    total, trees = np.full(len(y), out.start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, here = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, x.shape[1]), here * x.shape[1] * width).reshape(here, x.shape[1], width).cumsum(2) for w in (g, h)]
            (lg, lh), (ag, ah) = hist, (hist[0][:, :, -1:], hist[1][:, :, -1:])
            gain = lg**2 / (lh + LEAST) + (ag - lg) ** 2 / (ah - lh + LEAST) - ag**2 / (ah + LEAST)
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        own = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + LEAST)
        total += leaf[own]
        trees.append((feature, cut, leaf))
    out.feature, out.cut, out.leaf = (np.array(c) for c in zip(*trees, strict=True))
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ends of the pools and their shares, for linear interpolation."""
    pools: list[list[float]] = []  # sum, weight, first, last
    for r, t in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        if pools and pools[-1][3] == r:  # equal scores are one pool
            pools[-1][0] += t
            pools[-1][1] += 1
        else:
            pools.append([t, 1, r, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
    return np.array([e for p in pools for e in p[2:]]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


@dataclass
class Model:
    lexicon: dict[tuple[int, bytes], float]
    trees: Trees
    ends: np.ndarray
    shares: np.ndarray

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return np.interp(raw, self.ends, self.shares) if len(self.ends) else np.zeros(len(raw))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    sample = _sample(docs, labels, size)
    books = lexicons(sample)
    kind = sample.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, y double, fold int, x array<double>"
    out = arrow_schema(schema)

    def run(batches):
        readers = [Reader(book) for book in books[:FOLDS]]
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, text, own in _chunks(batch, 3):
                x = np.zeros((b - a, len(FEATURES)))
                for f in np.unique(fold[a:b]):
                    x[fold[a:b] == f] = readers[f].features(text, own)[fold[a:b] == f]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in range(3)), flat], schema=out)

    rows = sample.select("doc_id", "y", "fold", "text").mapInArrow(run, schema).toPandas().sort_values(["doc_id", "y"], kind="stable")  # `size` rows of numbers
    x, y, fold = np.stack(rows.x.to_numpy()) if len(rows) else np.zeros((0, len(FEATURES))), rows.y.to_numpy(float), rows.fold.to_numpy()
    unseen = np.zeros(len(y))
    for f in np.unique(fold):
        unseen[fold == f] = grow(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(books[-1], grow(x, y), *isotonic(unseen if len(y) and y.min() < y.max() else np.zeros(len(y)), y))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    out = arrow_schema(schema)

    def run(batches):
        reader = Reader(model.lexicon)
        for batch in batches:
            parts = [model.calibrated(reader.features(text, own)) for _, _, text, own in _chunks(batch, 2)]
            s = np.concatenate([*parts, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=out)

    return docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(run, schema)
