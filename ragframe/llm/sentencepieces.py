"""SentencePiece encoding and decoding in numpy, for model files of type unigram or BPE.

Texts are cut into words where no piece can reach across; the distinct words of a batch are encoded, those
of one length together, as the rows of a matrix of code points.

* Viterbi (unigram): positions advance for all rows at once; the hashes of all substrings that end at a
  position, by prefix sums, probe the sorted hashes of the pieces, and vectorised maxima store the
  best scores and backpointers.
* Merging (BPE): a BPE model's scores are ranks of merges, so the path of the best sum isn't the model's
  segmentation.  Each row merges its best pair per step, the pairs' hashes probing the same sorted keys;
  after a step all unfinished rows have the same number of symbols.

"auto" takes the one that the model file is for, so that ids equal the library's; Viterbi can be asked
for with any model, its scores then counting as log-probabilities.

Defined results.  Null and empty texts have no ids and decode to the empty string.  Characters without a
piece become bytes where the model falls back to them, else the unknown id.  Every row gives one row,
repeated ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, mix

SPACE = "▁"
TEXTS = 500  # encoded at once
#: Words that a worker remembers, at most; longer words than LONG are merged with a heap, each by itself.
REMEMBERED, LONG = 600_000, 192
UNKNOWN_PENALTY = 10.0  # fixed by the format: an unknown character scores this much less than any piece


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of the fields of a serialised message; length-delimited values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            n = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        scores, self.bpe, self.prefix, self.squeeze, self.rules = [], False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(np.frombuffer(own[2], "<f4")[0] if 2 in own else np.float32(0))
                self.kinds.append(own.get(3, 1))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                self.rules, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.rules:
            raise ValueError("a model with normalisation rules isn't supported; texts have to be normalised before")
        self.scores = np.array(scores, np.float32)
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        usual = [i for i, k in enumerate(self.kinds) if k in (1, 4) and self.pieces[i]]
        self.longest = max((len(self.pieces[i]) for i in usual), default=1)
        keys = np.array([_hash(self.pieces[i]) for i in usual], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usual, np.int64)[order]
        self.known = np.zeros(1 << 20, bool)  # most substrings are no pieces: their 20 lowest bits tell
        self.known[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.by_piece = {self.pieces[i]: i for i in usual}
        self.low = np.float32((self.scores[usual].min() if usual else 0) - np.float32(UNKNOWN_PENALTY))
        shared = {c for i in usual if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        across = any(SPACE in p[1:] and p.strip(SPACE) and SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in usual))
        # a word: spaces and what follows, or one character that no longer piece has
        inner = "".join(sorted(re.escape(c) for c in shared - {SPACE}))
        self.word = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|(?s:.)") if shared and not across else re.compile("(?s:.+)")
        self.table = [self._shown(i) for i in range(len(self.pieces))]

    def _shown(self, i: int) -> bytes:
        if self.kinds[i] == 6:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if self.kinds[i] == 3 else " ⁇ ".encode() if self.kinds[i] == 2 else self.pieces[i].replace(SPACE, " ").encode()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(keys.shape, -1, np.int64)
        may = self.known[(keys & np.uint64((1 << 20) - 1)).view(np.int64)]
        some = keys[may]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out

    def words(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.word.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def spell(self, char: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode()] if len(self.bytes) == 256 else [self.unknown]


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = [1], [1]
    inverse = pow(_BASE, -1, 1 << 64)
    for _ in range(4096):
        up.append(up[-1] * _BASE % (1 << 64))
        down.append(down[-1] * inverse % (1 << 64))
    return np.array(up, np.uint64), np.array(down, np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows; codes: a matrix of code points."""
    n = codes.shape[1]
    up = _powers()[0][:n] if n <= 4096 else np.array([pow(_BASE, i, 1 << 64) for i in range(n)], np.uint64)
    out = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=out[:, 1:])
    return out


def _between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [a, b) of each row; a and b by row, or by row and column."""
    row = np.arange(len(sums)).reshape(-1, *[1] * (np.ndim(a) - 1))
    down = _powers()[1]
    factor = down[a] if sums.shape[1] <= 4097 else np.array([pow(pow(_BASE, -1, 1 << 64), int(x), 1 << 64) for x in np.ravel(a)], np.uint64).reshape(np.shape(a))
    return mix((sums[row, b] - sums[row, a]) * factor + (b - a).astype(np.uint64))


def _span(sums: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of the substring [a, b) of every word; sums: a column for each."""
    factor = _powers()[1][a] if a <= 4096 else np.uint64(pow(pow(_BASE, -1, 1 << 64), a, 1 << 64))
    return mix((sums[b] - sums[a]) * factor + np.uint64(b - a))


def _hash(piece: str) -> np.uint64:
    codes = np.array([[ord(c) for c in piece]], np.uint32)
    return _between(_sums(codes), np.array([0]), np.array([len(piece)]))[0]


Ragged = tuple[np.ndarray, np.ndarray]  # the ids of all rows one after another, and how many each has


def _spelled(m: Model, flat: np.ndarray, sizes: np.ndarray) -> Ragged:
    """The same with unknown characters spelled; -2 - c stands for a character c."""
    unknown = np.flatnonzero(flat < 0)
    if not len(unknown):
        return flat, sizes
    spelled = {c: m.spell(chr(-2 - c)) for c in np.unique(flat[unknown]).tolist()}
    count = np.ones(len(flat), np.int64)
    count[unknown] = [len(spelled[c]) for c in flat[unknown].tolist()]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.repeat(flat, count)
    at = np.cumsum(count) - count
    for k in unknown.tolist():
        out[at[k] : at[k] + count[k]] = spelled[int(flat[k])]
    return out, np.bincount(row, weights=count, minlength=len(sizes)).astype(np.int64)


def viterbi(m: Model, codes: np.ndarray) -> Ragged:
    """The ids of each row's best path; codes: words of one length, a row of code points each."""
    n, size = codes.shape
    sums = np.ascontiguousarray(_sums(codes).T)
    best = np.full((size + 1, n), -np.inf, np.float32)
    best[0] = 0
    back, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int64)
    for end in range(1, size + 1):
        for start in range(max(0, end - m.longest), end):  # the longest first: it stays where sums tie
            ids = m.find(_span(sums, start, end))
            if end - start > 1:
                rows = np.flatnonzero(ids >= 0)
                own, score = ids[rows], m.scores[ids[rows]]
            else:
                rows, own = np.arange(n), np.where(ids >= 0, ids, -2 - codes[:, start].astype(np.int64))
                score = np.where(ids >= 0, m.scores[ids], m.low)
            total = best[start, rows] + score
            more = total > best[end, rows]
            rows = rows[more]
            best[end, rows], back[end, rows], piece[end, rows] = total[more], start, own[more]
    at, row, steps, live = np.full(n, size), np.arange(n), [], []
    while at.any():
        live.append(at > 0)
        steps.append(piece[at, row])
        at = np.where(at > 0, back[at, row], 0)
    live, steps = np.array(live[::-1]).reshape(-1, n).T, np.array(steps[::-1]).reshape(-1, n).T
    return _spelled(m, steps[live], live.sum(1))


def merge(m: Model, codes: np.ndarray) -> Ragged:
    """The ids of each row's segmentation by merges."""
    n, size = codes.shape
    sums, rows = _sums(codes), np.arange(n)
    bounds = np.tile(np.arange(size + 1), (n, 1))
    done_rows: list[np.ndarray] = []
    done_ids: list[np.ndarray] = []

    def rank(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ids = m.find(_between(s, a, b))
        return np.where(ids >= 0, m.scores[ids], -np.inf).astype(np.float32)

    pairs = rank(sums, bounds[:, :-2], bounds[:, 2:]) if size > 1 else np.zeros((n, 0), np.float32)
    while len(rows):
        best = pairs.max(1) if pairs.shape[1] else np.full(len(rows), -np.inf)
        done = best == -np.inf
        if done.any():
            a, b = bounds[done, :-1], bounds[done, 1:]
            ids = m.find(_between(sums[done], a, b))
            done_rows.append(rows[done])
            done_ids.append(np.where(ids >= 0, ids, -2 - codes[rows[done][:, None], a].astype(np.int64)))
            keep = ~done
            rows, bounds, pairs, sums = rows[keep], bounds[keep], pairs[keep], sums[keep]
            if not len(rows):
                break
        at, row = pairs.argmax(1), np.arange(len(rows))
        keep = np.ones(bounds.shape, bool)
        keep[row, at + 1] = False
        bounds = bounds[keep].reshape(len(rows), -1)
        keep = np.ones(pairs.shape, bool)
        keep[row, at] = False
        pairs = pairs[keep].reshape(len(rows), -1)
        for side in (at - 1, at):  # the pairs of the new symbol with its neighbours
            ok = (side >= 0) & (side < pairs.shape[1])
            if ok.any():
                r, c = row[ok], side[ok]
                pairs[r, c] = rank(sums[r], bounds[r, c], bounds[r, c + 2])
    sizes = np.zeros(n, np.int64)
    for own, ids in zip(done_rows, done_ids, strict=True):
        sizes[own] = ids.shape[1]
    first, flat = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int64)
    for own, ids in zip(done_rows, done_ids, strict=True):
        flat[first[own][:, None] + np.arange(ids.shape[1])] = ids
    return _spelled(m, flat, sizes)


def merge_long(m: Model, word: str) -> Ragged:
    """`merge` for one long word, with a heap of pairs."""
    known = m.by_piece
    after, before, end = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    alive, heap = [True] * len(word), []

    def push(a: int) -> None:
        b = after[a]
        if a >= 0 and b < len(word) and (i := known.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-float(m.scores[i]), a, end[a], end[b]))

    for a in range(len(word)):
        push(a)
    while heap:
        _, a, x, y = heapq.heappop(heap)
        b = after[a]
        if not alive[a] or end[a] != x or b >= len(word) or end[b] != y:
            continue
        alive[b], end[a], after[a] = False, y, after[b]
        if after[b] < len(word):
            before[after[b]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    ids = [known.get(word[a : end[a]], -2 - ord(word[a])) for a in range(len(word)) if alive[a]]
    return _spelled(m, np.array(ids, np.int64), np.array([len(ids)]))


class Grown:
    """An array that is added to at the end, in room that doubles."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            room = np.zeros(2 * (self.size + len(more)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)


class Encoder:
    """Encodes texts by some algorithms, remembering the ids of words in flat arrays: all ids, and where those of each word begin.

    A call costs what its texts and their new words cost, however many words are remembered.
    """

    def __init__(self, path: str, *algorithms: str):
        self.model = model(path)
        own = "merge" if self.model.bpe else "viterbi"
        self.algorithms = [own if a == "auto" else a for a in algorithms or ("auto",)]
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = [Grown(np.uint32) for _ in self.algorithms]
        self.first, self.sizes = ([Grown(np.int64) for _ in self.algorithms] for _ in range(2))

    def _learn(self, new: list[str]) -> None:
        m, by_size = self.model, {}
        for w in new:
            by_size.setdefault(len(w), []).append(w)
        for size, own in by_size.items():
            step = max(1, (1 << 18) // size)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                self.words.update(zip(part, range(len(self.words), len(self.words) + len(part)), strict=True))
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                for k, algorithm in enumerate(self.algorithms):
                    if algorithm == "merge" and size > LONG:
                        each = [merge_long(m, w) for w in part]
                        flat, sizes = np.concatenate([f for f, _ in each]), np.concatenate([s for _, s in each])
                    else:
                        flat, sizes = (merge if algorithm == "merge" else viterbi)(m, codes)
                    self.first[k].add(self.flat[k].size + np.cumsum(sizes) - sizes)
                    self.sizes[k].add(sizes)
                    self.flat[k].add(flat)

    def encode_all(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each algorithm the ids of each text."""
        split = [self.model.words(t or "") for t in texts]
        if len(self.words) > REMEMBERED:
            self._forget()
        self._learn(list(dict.fromkeys(w for ws in split for w in ws if w not in self.words)))
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        ends = np.cumsum([len(ws) for ws in split])
        out = []
        for k in range(len(self.algorithms)):
            flat, first, own = self.flat[k].room, self.first[k].room[index], self.sizes[k].room[index]
            upto = np.cumsum(own)
            ids = flat[np.repeat(first - upto + own, own) + np.arange(int(own.sum()))]
            cuts = np.concatenate(([0], upto))[np.concatenate(([0], ends)).astype(np.int64)]
            out.append([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_all(texts)[0]


def decode_ids(path: str, ids) -> str:
    m = model(path)
    text = b"".join([m.table[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if m.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str | None = None, algorithm: str = "auto", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the key and ids (array<int>)."""
    path = path or default_model()
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>"
    out = arrow_schema(schema)

    def run(batches):
        encoder = Encoder(path, algorithm)
        for batch in batches:
            for a in range(0, len(batch), TEXTS):
                part = batch.slice(a, TEXTS)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))], schema=out)

    return docs.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document: the key and text."""
    path = path or default_model()
    schema = f"{key} {encoded.schema[key].dataType.simpleString()}, text string"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(path, x.as_py() or ()) for x in batch.column(1)], pa.string())], schema=out)

    return encoded.select(key, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_pieces and ids_crc32 (the model's own segmentation), viterbi_pieces and
    viterbi_crc32 (the best sum of scores), exact: whether both decode to the text (null: empty)."""
    path = path or default_model()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, viterbi_pieces long, viterbi_crc32 long, exact boolean"
    out = arrow_schema(schema)

    def run(batches):
        both = Encoder(path, "auto", "viterbi")
        for batch in batches:
            for a in range(0, len(batch), TEXTS):
                part = batch.slice(a, TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns, exact = [], np.ones(len(texts), bool)
                for ids in both.encode_all(texts):
                    columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    exact &= np.fromiter((decode_ids(path, x.tolist()) == t for x, t in zip(ids, texts, strict=True)), bool, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(exact)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
