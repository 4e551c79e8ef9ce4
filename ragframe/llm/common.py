"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch for Python.
ARROW_BYTES = 1 << 21
#: Bytes of text that one vectorised step works on at once.
CHUNK_BYTES = 1 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a run on one machine (as in tests) gets a folder of its own; a cluster is told to set it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ragframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of batches for Python in this session; for applications (the queries and the pipeline), not operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    While it is written, batches for Python are of ARROW_BYTES at most; the session's own setting comes back.
    """
    spark = df.sparkSession
    path, limit = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, ARROW_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(path)


class IdFilter:
    """Which ids may be among those given: a Bloom filter of two bits for each id.

    It has 16 bits for each id, in MOST_BITS at most (32 MB): with ever more ids it lets ever more others
    through, which costs time and never a result, since whoever uses it joins what it lets through anyway.
    The bits are set by tasks, in blocks; the driver only puts the blocks side by side.
    """

    MOST_BITS, BLOCK = 1 << 28, 16

    def __init__(self, ids: DataFrame, column: str):
        size = min(self.MOST_BITS, max(1 << self.BLOCK, 1 << (16 * max(1, ids.count()) - 1).bit_length()))
        mask, shift = size - 1, self.BLOCK
        h = self.hashed(column)
        slots = ids.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftright(h, 32).bitwiseAND(mask))).alias("slot"))
        out = arrow_schema("block long, bits binary")

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                slot = np.sort(batch.column("slot").to_numpy(zero_copy_only=False))
                found, first = np.unique(slot >> shift, return_index=True)
                for block, own in zip(found.tolist(), np.split(slot, first[1:]), strict=False):
                    held.setdefault(block, np.zeros(1 << shift, bool))[own & ((1 << shift) - 1)] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], schema=out)

        self.bits, self.mask = np.zeros(size // 8, np.uint8), mask
        width = (1 << shift) // 8
        for r in slots.repartition(F.shiftright("slot", shift)).mapInArrow(run, "block long, bits binary").collect():  # at most 4,096 blocks
            self.bits[r.block * width : (r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)

    @staticmethod
    def hashed(column: str):
        return F.xxhash64(column)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether its id may be one of those given."""
        one, two = hashes & self.mask, (hashes >> 32) & self.mask
        return ((self.bits[one >> 3] >> (one & 7)) & (self.bits[two >> 3] >> (two & 7)) & 1).astype(bool)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parted(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id is certainly not in ids, and the others (those without id among them).

    So only the others need be joined to ids: a table of long rows isn't dealt to drop a few of them.
    """
    known, out = IdFilter(ids, column), df.schema
    rows = df.withColumn(unused(df, "__hash"), IdFilter.hashed(column)).withColumn(unused(df, "__none"), F.col(column).isNull())

    def pick(other: bool):
        def run(batches):
            for batch in batches:
                held = known.may_hold(batch.columns[-2].to_numpy(zero_copy_only=False)) | batch.columns[-1].to_numpy(zero_copy_only=False)
                yield batch.select(batch.schema.names[:-2]).filter(pa.array(held == other))

        return rows.mapInArrow(run, out)

    return pick(False), pick(True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and the n+1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most `limit` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


#: A prime modulus beside 2**64: words built so that a polynomial modulo a power of two can't tell them apart differ here.
_PRIME, _PRIME_BASE = np.uint64((1 << 31) - 1), 1_103_515_245


def _prime_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and PRIME_BASE**-i modulo PRIME, for i < n at least."""
    if len(_powers.get("prime_up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, int(_PRIME)))):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, int(_PRIME))) % _PRIME
                have *= 2
            _powers[name] = out
    return _powers["prime_up"], _powers["prime_down"]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of codes[start:end] (bytes, or code points if salt's table is a mixer), by prefix sums.

    Two polynomials are mixed, one modulo 2**64 and one modulo a prime.
    """
    up, down = _power(len(codes) + 1)
    values = _BYTE[codes] if codes.dtype == np.uint8 else mix(codes.astype(np.uint64) + np.uint64(1))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * up[: len(codes)], out=sums[1:])
    first = (sums[ends] - sums[starts]) * down[starts]
    up, down = _prime_power(len(codes) + 1)
    np.cumsum((values >> np.uint64(33)) * up[: len(codes)] % _PRIME, out=sums[1:])  # under 2**31 each
    second = (sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME
    return mix(mix(first + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)) + second * np.uint64(0x9FB21C651E98DF25))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are `inside`, cut at rows, and the number of runs before each row (n+1)."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside))[: len(inside)]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the number of words before each row (n+1)."""
    return runs(~ASCII_SPACE[data], offsets)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of `data` (in order, not overlapping) as byte strings."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] = 1
    mark[ends] -= 1  # a span may begin where another ends
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
