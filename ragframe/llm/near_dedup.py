"""Near-duplicate detection: MinHash with banding, verification on full sets, connected components.

A document's set is that of its word shingles.  Documents with the same set form one class, and only
classes are compared.  A class gets `bands * rows` universal hash minima; classes that agree in all rows
of a band share a bucket.  The bands are chosen so that a pair at the threshold misses all buckets with a
probability under MISS.

Candidates are compared without making all pairs of a bucket:

1. Star: in each bucket every class is compared with one pivot, the class that meets most others.  Pairs
   whose signatures agree too little are dropped (far below what the threshold allows), the others are
   decided on the full sets.  Links give components.
2. Buckets that still hold several components are the rest.  In those of up to SMALL classes the pairs
   across components are compared as before.  Larger ones are joined to clusters, and the classes outside
   a cluster's largest component are compared with all of its classes of nearly the same size, in blocks of
   BLOCK: a block pair is one sparse product of set memberships, which yields a spanning forest of its
   links, not all of them.

Both steps are exact on the candidates: classes in one component needn't be compared again.  Then the
components of all links follow by alternating large-star and small-star.

Defined results.  Words are runs without ASCII white space, with A-Z in lower case.  A document with
fewer words than a shingle has its whole sequence as one shingle; without words, or with null text, its
set is empty and it is linked with nothing.  component_id is the smallest doc_id reachable (null only
where all are null).  Rows with the same doc_id count as one document where their sets agree and as
several where they don't.  Every row gives one row; an empty table gives an empty result; other columns
are ignored by `report` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, arrow_schema, lower_ascii, mix, parted, saved, slices, span_hashes, utf8, words
from .components import connected_components

HASHES, MISS = 130, 1e-6
SMALL, BLOCK, BLOCK_BYTES = 64, 512, 1 << 23
CELL = ("size_a", "main_a", "block_a", "size_b", "main_b", "block_b")
#: Standard deviations of a signature's estimate below the threshold at which a pair is dropped unseen.
SIGMAS = 5.0
_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) of at most HASHES minima: the most rows with which a pair at the threshold is missed by under MISS."""
    t = percent / 100
    fit = [r for r in range(1, 17) if (1 - t**r) ** (HASHES // r) < MISS]
    rows = max(fit, default=1)
    return HASHES // rows, rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles."""
    data = lower_ascii(data)
    starts, ends, before = words(data, offsets)
    own = span_hashes(data, starts, ends)
    count = np.diff(before)
    chains, chain = {}, own
    for m in range(1, k + 1):
        if m > 1:
            chain = mix(chain[:-1] * np.uint64(0x9FB21C651E98DF25) + own[m - 1 :])
        chains[m] = chain if m == k else mix(chain + np.uint64(m))
    out = []
    for i, n in enumerate(count):
        a = before[i]
        m = min(int(n), k)
        out.append(np.unique(chains[m][a : a + n - m + 1]) if m else own[:0])
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """HASHES universal minima (multiply-add-shift) of a set of hashes, 32 bits each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 2048):
        np.minimum(low, (values[a : a + 2048, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _prints(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    return tuple(int(x) for x in np.array([np.add.reduce(mix(values)), np.bitwise_xor.reduce(mix(values ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64).view(np.int64))


def _sets(batches, k: int):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def _described(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """uid, doc_id, n, fp1, fp2 and the bucket of each band, for every row."""
    schema = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, fp1 long, fp2 long, buckets array<long>"
    out = arrow_schema(schema)
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for part, sets in _sets(batches, k):
            prints = [_prints(s) for s in sets]
            sigs = np.array([minima(s) for s in sets], np.uint64).reshape(len(sets), HASHES)[:, : bands * rows].reshape(-1, bands, rows)
            keys = mix((sigs * weights).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(sets))), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), flat], schema=out)
            uid += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _full(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """node, n, sig and the full set of each needed class, from the text of one of its documents.

    Texts are read once more, and an IdFilter drops the others where they are read; only sets are dealt.
    """
    schema = "fp1 long, fp2 long, n long, sig binary, full binary"
    out = arrow_schema(schema)
    ids = need.select("doc_id").filter("doc_id is not null").distinct()
    known = IdFilter(ids, "doc_id")

    def run(batches):
        for batch in batches:
            keep = known.may_hold(batch.column("hash").to_numpy(zero_copy_only=False)) | batch.column("none").to_numpy(zero_copy_only=False)
            for _, sets in _sets([batch.filter(pa.array(keep))], k):
                prints = [_prints(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([minima(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=out)

    found = docs.select(IdFilter.hashed("doc_id").alias("hash"), F.col("doc_id").isNull().alias("none"), "text").mapInArrow(run, schema)
    return found.dropDuplicates(["fp1", "fp2"]).join(need.select("node", "fp1", "fp2"), ["fp1", "fp2"]).select("node", "n", "sig", "full")


def _sides(pairs: DataFrame, full: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """pairs (u, v) with columns of full for both."""
    for x in "uv":
        pairs = pairs.join(full.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in own]), x)
    return pairs


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar: sizes and signatures first, then the full sets of those left."""
    t = percent / 100
    cut = (t - SIGMAS * (t * (1 - t) / HASHES) ** 0.5) * HASHES
    near = (100 * F.col("n_u") >= percent * F.col("n_v")) & (100 * F.col("n_v") >= percent * F.col("n_u"))
    out = arrow_schema("u long, v long")

    def kept(batch, columns, type_, test):
        rows = zip(*[batch.column(c) for c in columns], strict=True)
        keep = [i for i, (x, y) in enumerate(rows) if test(np.frombuffer(x.as_buffer(), type_), np.frombuffer(y.as_buffer(), type_))]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("u", "v")], schema=out)

    def similar(a, b):
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= percent * (len(a) + len(b) - shared)

    def signed(batches):
        for batch in batches:
            yield kept(batch, ("sig_u", "sig_v"), np.uint32, lambda x, y: np.count_nonzero(x == y) >= cut)

    def exact(batches):
        for batch in batches:
            yield kept(batch, ("full_u", "full_v"), np.uint64, similar)

    few = _sides(pairs, full, ("n", "sig")).filter(near).select("u", "v", "sig_u", "sig_v").mapInArrow(signed, "u long, v long")
    return _sides(saved(few, "likely"), full, ("full",)).select("u", "v", "full_u", "full_v").mapInArrow(exact, "u long, v long")


def block_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix of which sets of a and b are similar, by products of membership matrices of 32 MB or less."""
    width = max(256, min(4096, (1 << 23) // max(1, len(a) + len(b))))
    sizes = [np.array([len(s) for s in x], np.int64) for x in (a, b)]
    values = np.concatenate([*a, *b]) if len(a) + len(b) else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    found, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    shared = np.zeros((len(a), len(b)), np.float64)
    for c in range(0, len(found), width):
        x, y = np.searchsorted(column, (c, c + width))
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[rows[x:y], column[x:y] - c] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    shared = np.rint(shared).astype(np.int64)
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None] - shared)


def _forest(u: np.ndarray, v: np.ndarray, comp: dict) -> list[tuple[int, int]]:
    """Of the links u-v those that join components not joined yet."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        p, q = root(comp[x]), root(comp[y])
        if p != q:
            up[p] = q
            out.append((x, y))
    return out


def _in_blocks(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) across components within clusters; members: (cluster, node, comp).

    Sets are dealt by classes of size so that similar ones are in the same class or in neighbouring ones, and
    within a class by blocks of BLOCK sets or BLOCK_BYTES.  A cell is a pair of blocks that may hold links.
    """
    sizes = members.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    best = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).filter("top.n < all").select("cluster", F.col("top.comp").alias("main"))
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    rows = members.join(best, "cluster").join(full.select("node", "n"), "node")
    rows = saved(rows.select("cluster", "node", "comp", (F.col("comp") == F.col("main")).alias("main"), F.floor(F.log("n") / step).alias("size"), "n"), "rows")
    count = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("blocks")
    units = saved(rows.groupBy("cluster", "main", "size").agg(count), "units")
    rows = rows.join(units, ["cluster", "main", "size"]).select("cluster", "main", "size", "node", "comp", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    # a few units for each cluster, each with those of its own size and the next; two blocks of the main component have no links to tell
    one, two = (units.select("cluster", *[F.col(c).alias(f"{c}_{x}") for c in ("main", "size", "blocks")], F.explode(F.expr(shift)).alias("size")) for x, shift in (("a", "array(size, size + 1)"), ("b", "array(size)")))
    ordered = "not (main_a and main_b) and (size_a < size_b or main_a <= main_b)"
    each = lambda x: F.explode(F.expr(f"sequence(0, blocks_{x} - 1)")).alias(f"block_{x}")
    cells = one.join(two, ["cluster", "size"]).filter(ordered).select("*", each("a")).select("*", each("b"))
    cells = saved(cells.filter("size_a < size_b or main_a <> main_b or block_a <= block_b").select("cluster", *CELL), "cells")
    sides = []
    for x in "ab":
        own = cells.select("*", *[F.col(f"{c}_{x}").alias(c) for c in ("main", "size", "block")])
        if x == "b":  # a block that meets itself is dealt once
            own = own.filter("not (size_a = size_b and main_a = main_b and block_a = block_b)")
        sides.append(rows.join(own, ["cluster", "main", "size", "block"]).select("cluster", *CELL, "node", "comp", F.lit(x).alias("side")))

    def run(_, group):
        import pandas as pd  # here, so that the other workers don't hold it

        a, b = (group[group.side == x] for x in "ab")
        b = b if len(b) else a
        sets = [[np.frombuffer(x, np.uint64) for x in g.full] for g in (a, b)]
        x, y = np.nonzero(block_links(*sets, percent))
        links = _forest(a.node.to_numpy()[x], b.node.to_numpy()[y], dict(zip(group.node, group.comp, strict=True)))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return sides[0].unionByName(sides[1]).join(full.select("node", "full"), "node").groupBy("cluster", *CELL).applyInPandas(run, "u long, v long")


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Enough verified links (u, v) between classes to connect whatever is connected.

    What is known of a bucket is written before it is joined to the bucket's members, and the joined rows
    before they are counted again, so that each such join stands alone and adaptive execution can split it.
    """
    nodes = rows.join(classes.select("node"), rows.uid == classes.node, "left_semi")
    buckets = saved(nodes.select(F.col("uid").alias("node"), F.explode("buckets").alias("bucket")), "buckets")
    shared = saved(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    held = saved(buckets.join(shared, "bucket"), "shared")
    degree = saved(held.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    held = saved(held.join(degree, "node"), "members")
    # the class that meets most others
    order = F.col("degree") * 4096 + F.pmod(F.xxhash64("node"), F.lit(4096))
    pivots = saved(held.groupBy("bucket").agg(F.max_by("node", order).alias("pivot")), "pivots")
    star = saved(held.join(pivots, "bucket").filter("node <> pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct(), "star")
    need = rows.select(F.col("uid").alias("node"), "doc_id", "fp1", "fp2").join(degree.select("node"), "node", "left_semi")
    full = saved(_full(docs, saved(need, "need"), k), "full")
    first = saved(_verified(star, full, percent), "links")

    comps = saved(connected_components(first), "components")
    told = saved(held.join(comps, "node", "left").select("bucket", "size", "node", F.coalesce("root", "node").alias("comp")), "told")
    mixed = saved(told.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket"), "mixed")
    rest = saved(told.join(mixed, "bucket"), "rest")
    few = rest.filter(F.col("size") <= SMALL).select("bucket", "node", "comp")
    pairs = few.alias("a").join(few.alias("b"), "bucket").filter("a.node > b.node and a.comp <> b.comp").select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    second = _verified(saved(pairs.join(star, ["u", "v"], "left_anti"), "pairs"), full, percent)

    many = rest.filter(F.col("size") > SMALL)
    hub = saved(many.groupBy("bucket").agg(F.min("node").alias("hub")), "hubs")
    clusters = connected_components(many.join(hub, "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    members = saved(many.select("node", "comp").distinct().join(clusters, "node").select(F.col("root").alias("cluster"), "node", "comp"), "clusters")
    third = _in_blocks(members, full, percent)
    return first.unionByName(second).unionByName(third)


def report(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    bands, width = banding(percent)
    rows = saved(_described(docs, k, bands, width), "described")
    classes = saved(rows.filter("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("label"), F.min("uid").alias("node")), "classes")
    roots = saved(connected_components(saved(_links(docs, rows, classes, k, percent), "alllinks")), "roots")
    rooted = classes.join(roots, "node", "left").select("fp1", "fp2", "label", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("label").alias("component_id"))
    named = saved(rooted.join(least, "root").select("fp1", "fp2", "component_id"), "named")
    some = rows.filter("n > 0").select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"]).select("doc_id", "n", "component_id")
    both = some.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component, that of the smallest doc_id."""
    found = saved(report(docs, k, percent), "report")
    gone = found.filter("not kept").select("doc_id").distinct()
    gone = saved(gone.join(found.filter("kept").select("doc_id").distinct(), "doc_id", "left_anti"), "gone")
    clear, rest = parted(docs, gone.filter("doc_id is not null"), "doc_id")
    return clear.unionByName(rest.join(gone, "doc_id", "left_anti").select(*docs.columns))
