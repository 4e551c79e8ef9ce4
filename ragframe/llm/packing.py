"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most LENGTH tokens.  The histogram of piece lengths (at most LENGTH
numbers, whatever the input's size) is all that the driver sees.  Patterns of one to three lengths that
fill a sequence exactly are fitted to it by non-negative least squares, an active-set method over all
such patterns; repeat counts are rounded (never above what there is), and what is left is packed by best fit, longest first,
on the histogram.  The plan is a short list of (pattern, repeats); a piece finds its place from its rank
among the pieces of its length, ranks being taken over salted keys so that no length is one task's work.

Defined results.  Null text counts as empty; an empty text is the end token alone.  A document longer
than LENGTH is cut from its end: all its pieces are full but, perhaps, the first.  Repeated rows are
packed each for itself; rows without doc_id too.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, saved

LENGTH = 1024
END_ID = 2
#: Active-set rounds and the patterns that a round may add.
ROUNDS, ADDED = 12, 160


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A run of white space from which a text goes through `tokenizers`: the other library's regular expression
#: recurses on such runs and overflows its stack at a million characters.  Both give the same ids.
LONG_SPACE = 100_000
_SPACE = re.compile(r"\s{1000,}")


def _long_space(text: str) -> bool:
    return len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in _SPACE.finditer(text))


#: The pre-tokenizer of the vocabulary's family, as its README gives it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, as `tokenizers` gives them without special tokens added.

    The byte-level vocabulary of the file runs in tiktoken, which is several times as fast and gives the
    same ids; a text that holds a special token's string or a very long run of white space goes through
    `tokenizers` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", ())]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids if any(s in text for s in special) or _long_space(text) else fast.encode_ordinary(text)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = path or default_tokenizer()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    out = arrow_schema(schema)

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i), piece.append(k), start.append(a), size.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(length: int, histogram: np.ndarray) -> np.ndarray:
    """All multisets of one to three occurring lengths that fill a sequence exactly; rows padded with 0."""
    have = histogram > 0
    rows = [(length, 0, 0)] if have[length] else []
    rows += [(length - b, b, 0) for b in range(1, length // 2 + 1) if have[b] and have[length - b]]
    for c in range(1, length // 3 + 1):
        if have[c]:
            b = np.arange(c, (length - c) // 2 + 1)
            a = length - c - b
            ok = have[b] & have[a]
            rows += zip(a[ok].tolist(), b[ok].tolist(), [c] * int(ok.sum()), strict=True)
    return np.array(rows, np.int64).reshape(-1, 3)


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS, added: int = ADDED) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - histogram)|^2, A the patterns' lengths.

    Lawson and Hanson's active set in blocks: up to `added` patterns that share no length enter at once,
    and all that turn negative leave.  W weighs an error by the tokens it is about, since short pieces
    that are left over are easily packed and long ones aren't.
    """
    x, size = np.zeros(len(found)), len(histogram)
    one = (found > 0).astype(float)
    weight = (np.arange(size) / size) ** 6
    target = histogram.astype(float)

    def product(idx: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(found[idx].ravel(), (one[idx] * v[:, None]).ravel(), size)

    idx = np.zeros(0, np.int64)
    for _ in range(rounds):
        left = (target - product(idx, x[idx])) * weight
        slope = (one * left[found]).sum(1)
        slope[idx] = 0
        taken, new = np.zeros(size, bool), []
        for k in np.argsort(-slope, kind="stable")[: 40 * added]:
            if slope[k] <= 1e-6 or len(new) >= added:
                break
            own = found[k][found[k] > 0]
            if not taken[own].any():
                taken[own] = True
                new.append(k)
        if not new:
            break
        idx = np.concatenate((idx, new))
        while True:
            matrix = np.zeros((size, len(idx)))
            np.add.at(matrix, (found[idx].ravel(), np.repeat(np.arange(len(idx)), found.shape[1])), one[idx].ravel())
            scaled = matrix * weight[:, None]
            gram = scaled.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-9
            best = np.linalg.solve(gram, scaled.T @ target)
            if (best > 0).all():
                break
            idx = idx[best > 0]
        x[:] = 0
        x[idx] = best
    return x


def best_fit(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that pack what a histogram counts, longest first, each into the fullest sequence it fits."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {length: []}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, left: int) -> None:
        if n:
            (open_.setdefault(left, []) if left else done).append((pattern, n))

    for size in range(length, 0, -1):
        c = int(histogram[size])
        while c:
            room = min((r for r, x in open_.items() if r >= size and x), default=None)
            pattern, n = open_[room].pop() if room else ((), c)
            room = room or length
            k = room // size  # copies that one sequence takes
            whole = min(n, c // k)
            put(pattern + (size,) * k, whole, room - k * size)
            c -= whole * k
            n -= whole
            if n and 0 < c < k:
                put(pattern + (size,) * c, 1, room - c * size)
                c, n = 0, n - 1
            if pattern:
                put(pattern, n, room)
    return done + [x for rows in open_.values() for x in rows]


def plan(histogram: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) for all pieces that the histogram counts (index: a length)."""
    found = patterns(length, histogram)
    left, out = histogram.astype(np.int64).copy(), []
    repeats = np.floor(fit(found, histogram) + 0.5).astype(np.int64) if len(found) else []
    for k in np.argsort(-np.asarray(repeats), kind="stable"):
        own = [int(v) for v in found[k] if v]
        n = min([int(repeats[k]), *(int(left[v]) // own.count(v) for v in own)])
        if n <= 0:
            continue
        out.append((tuple(own), n))
        for v in own:
            left[v] -= n
    return out + best_fit(left, length)


def places(plan_: list[tuple[tuple[int, ...], int]], histogram: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of ranks: `first` (over all pieces by length and rank), the first sequence, offset, copies and size."""
    base = np.concatenate(([0], np.cumsum(histogram)[:-1]))
    used = np.zeros(len(histogram), np.int64)
    rows, sequence = [], 0
    for pattern, n in plan_:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            copies = pattern.count(size)
            rows.append((base[size] + used[size], sequence, offset, copies, size))
            used[size] += copies * n
            offset += copies * size
        sequence += n
    rows.sort()
    return dict(zip(("first", "sequence", "offset", "copies", "size"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True)) | {"base": base}


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    salts = max(8, partitions(spark))
    cut = saved(pieces(docs, path, length).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(salts)).cast("int")), "pieces")
    counts = saved(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        histogram[r.length] = r.n
    at = places(plan(histogram, length), histogram)
    # the sums are dealt like the ranks, so that the table (lengths x salts) is sorted beside them, never broadcast
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(before.hint("merge"), ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            place = at["base"][size] + batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(at["first"], place, "right") - 1
            index = place - at["first"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at["sequence"][k] + index // at["copies"][k]), pa.array(at["offset"][k] + index % at["copies"][k] * size)], schema=out)

    return ranked.mapInArrow(run, schema)
