"""Nearest neighbours: inverted file, product-quantised residuals, exact reranking and an exact check.

Coarse centroids and the codebooks of residuals are fitted on the driver, on a sample of 32 vectors for
each list (4,096 at least, SAMPLE at most, SAMPLE_BYTES in all), those whose ids hash lowest.  Every
distinct vector is encoded: the nearest centroid and one byte for each sub-vector of the residual.  Lists
of near centroids are gathered in shards; a shard is dealt in blocks of vectors and its queries in chunks,
so a crowded list is shared out.  A query goes to the blocks of the shards that hold its probed lists,
scores their codes with tables of asymmetric distances, and keeps RERANK candidates (more in large
tables); those are ranked by the exact distance of the original vectors.

|q - c - r|^2 is |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r: the first term is one number for each query and list,
the second one for each vector, and the last comes from one table for each query, whatever the list.

Codes tell vectors of many components, of tight groups or of very different lengths badly apart, so an exact
check follows: the distance of the K-th vector found bounds what can still be missing.  Vectors are packed in
blocks by list; a query leaves out the blocks that lie beyond that bound, and in the others products of matrices
tell which vectors may lie within it; those are ranked by their exact distance too.  So the K nearest are found
whatever the vectors; the codes only decide how much is compared.

How many lists a query probes is calibrated on the sample: as few as hold COVER of the true neighbours of
sample queries.  Vectors without structure need most lists, clustered ones few.

Equal vectors are one entry of the index, with the K + 1 smallest ids as members: no other copy can be
among the K nearest, since all tie.

Defined results.  Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without id.  Rows that repeat an id and its vector count once.  An
id with several vectors is one candidate, at the distance of its nearest vector found; as a query it uses
the one that hashes lowest.  With fewer than K candidates all are returned.  Ties go to the smaller id.
The index sees components scaled and bounded, so that very large ones can't overflow; scores are those of
the vectors as they are (infinite only where the distance is no double).  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

K, RERANK = 10, 200
SAMPLE, SAMPLE_BYTES, COVER = 65_536, 1 << 27, 0.985
#: Vectors of a block and queries of a chunk; blocks grow with the table, so that queries aren't copied to ever more of them.
LEAST_BLOCK, MOST_BLOCK, CHUNK, FAN_IN = 4096, 1 << 17, 2048, 64
SUBVECTORS, CODES = 16, 256
#: Scaled components are cut off here; only the index sees that.
BOUND = 1e4
#: Of the exact check: bytes and rows of a block of vectors, queries of a block, pairs of which rows are held at once.
CHECK_BYTES, CHECK_ROWS, CHECK_QUERIES, CHECK_PAIRS = 1 << 21, 1024, 256, 1 << 21


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    bias = (centres**2).sum(1)
    return np.concatenate([(bias - 2 * x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(k))
        count = np.bincount(own, minlength=k)
        sums = np.add.reduceat(np.concatenate((x[order], np.zeros((1, x.shape[1])))), first)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _vectors(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))


@dataclass
class Index:
    """Scale of components, coarse centroids and their shards, codebooks of residuals, number of lists to probe."""

    scale: float
    centres: np.ndarray
    shards: np.ndarray
    books: list
    probes: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -BOUND, BOUND)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centres)
        left = x - self.centres[own]
        return own, np.column_stack([_nearest(left[:, a:b], book) for a, b, book in self.books]).astype(np.uint8)

    def to_lists(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries and centroids."""
        return (q**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * q @ self.centres.T

    def probed(self, far: np.ndarray) -> np.ndarray:
        """The lists to probe, as a matrix of truth values."""
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, : self.probes], True, 1)
        return out

    def search(self, q: np.ndarray, codes: np.ndarray, lists: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the n smallest (asymmetric distance, id) among the codes whose lists it probes."""
        columns = np.ascontiguousarray(codes.T)
        r = np.hstack([book[c] for (_, _, book), c in zip(self.books, columns, strict=True)])
        own = (r**2).sum(1) + 2 * (r * self.centres[lists]).sum(1)
        far = self.to_lists(q)
        probed, out = self.probed(far), []
        tables = [-2 * q[:, a:b] @ book.T for a, b, book in self.books]
        for k in range(len(q)):
            at = np.flatnonzero(probed[k][lists])
            d = far[k][lists[at]] + own[at]
            for table, column in zip(tables, columns, strict=True):
                d += table[k][column[at]]
            if len(at) > n:
                few = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
                at, d = at[few], d[few]
            best = np.lexsort((ids[at], d))[:n]
            out.append((d[best], ids[at[best]]))
        return out


def lists_for(size: int) -> int:
    return max(1, min(int(size**0.5), SAMPLE // 32))


def rerank_for(size: int) -> int:
    """Candidates to rank exactly: more in larger tables, where more codes lie as near as the true neighbours'."""
    return max(RERANK, int(5.4 * size ** (1 / 3)))


def sample_size(size: int, width: int) -> int:
    return max(1, min(size, SAMPLE, SAMPLE_BYTES // (8 * width), max(4096, 32 * lists_for(size))))


def train(sample: np.ndarray, size: int, block: int) -> Index:
    scale = float(np.median(np.abs(sample).max(1)))
    sample = np.clip(sample / scale, -BOUND, BOUND)
    lists = max(1, min(lists_for(size), len(sample) // 8))
    centres = kmeans(sample, lists)
    shards = _nearest(centres, kmeans(centres, -(-size // block), 8))
    own = _nearest(sample, centres)
    left = sample - centres[own]
    edges = np.linspace(0, sample.shape[1], min(SUBVECTORS, sample.shape[1]) + 1).astype(int)
    books = [(int(a), int(b), kmeans(left[:, a:b], CODES, 8)) for a, b in zip(edges, edges[1:], strict=False)]
    q = sample[:256]
    dist = (sample**2).sum(1) - 2 * q @ sample.T
    dist[np.arange(len(q)), np.arange(len(q))] = np.inf
    true = own[np.argpartition(dist, min(K, len(sample) - 1), axis=1)[:, :K]]
    index = Index(scale, centres, shards, books, 0)
    rank = np.argsort(np.argsort(index.to_lists(q), axis=1, kind="stable"), axis=1)[np.arange(len(q))[:, None], true]
    index.probes = int(np.quantile(rank, COVER, method="higher")) + 1
    return index


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances; rows whose squares would leave the range of doubles are scaled first."""
    most = np.maximum(np.abs(a).max(1, initial=0), np.abs(b).max(1, initial=0))
    scale = np.where((most > 1e150) | (most < 1e-140), np.maximum(most, np.finfo(float).tiny), 1.0)[:, None]
    with np.errstate(over="ignore"):
        return np.sqrt(((a / scale - b / scale) ** 2).sum(1)) * scale[:, 0]


def within(q: np.ndarray, most: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact distance of the rows of x that lie within `most` of a query.

    Of each query rows are kept, by distance and id, until k + 1 different ids are among them: k, whoever asks.
    """
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    scale = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    centre = (x / scale).mean(0)
    left, right, limit = q / scale - centre, x / scale - centre, most / scale
    own, far = (right**2).sum(1), (left**2).sum(1)
    near = np.flatnonzero(np.sqrt(far) - np.sqrt(own.max()) <= limit * (1 + 1e-9) + 1e-9)  # the ball around the block
    if not len(near):
        return none
    slack = 1e-12 * (far[near][:, None] + own) + 1e-300
    query, row = np.nonzero(far[near][:, None] + own - 2 * left[near] @ right.T <= (limit[near] ** 2 * (1 + 1e-9))[:, None] + slack)
    query, step = near[query], max(1, CHECK_PAIRS // x.shape[1])
    dist = np.concatenate([distances(q[query[a : a + step]], x[row[a : a + step]]) for a in range(0, len(query), step)] or [np.zeros(0)])
    kept = np.flatnonzero(dist <= most[query])
    kept = kept[np.lexsort((ids[row[kept]], dist[kept], query[kept]))]
    query, row, dist = query[kept], row[kept], dist[kept]
    if not len(query):
        return none
    first = np.zeros(len(query), bool)  # the first row of a query's id
    first[np.unique(np.column_stack((query, ids[row])), axis=0, return_index=True)[1]] = True
    seen = np.cumsum(first)
    seen -= (seen - first)[np.searchsorted(query, query)]  # within the query
    few = seen <= k + 1
    return query[few], row[few], dist[few]


def checked(classes: DataFrame, queries: DataFrame, index: Index, width: int, k: int) -> DataFrame:
    """query_id, key, score of the classes (key, rep, v) no further from a query (query_id, v, most) than `most`.

    Every block of classes meets every block of the stated queries; neither holds more than a bounded number of rows.
    """
    size = int(np.clip(CHECK_BYTES // (8 * width), 1, CHECK_ROWS))

    def packed(batches):
        for x in batches:
            if not len(x):
                continue
            v = _vectors(x.v)
            order = np.argsort(_nearest(index.scaled(v), index.centres), kind="stable")
            for a in range(0, len(order), size):
                at = order[a : a + size]
                yield pd.DataFrame({"keys": [x.key.to_numpy()[at]], "reps": [x.rep.to_numpy(np.int64)[at].tobytes()], "rows": [v[at].astype(float).tobytes()]})

    def asking(batches):
        for x in batches:
            for a in range(0, len(x), CHECK_QUERIES):
                own = x.iloc[a : a + CHECK_QUERIES]
                yield pd.DataFrame({"ids": [own.query_id.to_numpy(np.int64).tobytes()], "most": [own.most.to_numpy(float).tobytes()], "asked": [_vectors(own.v).astype(float).tobytes()]})

    def compared(batches):
        for x in batches:
            for keys, reps, rows, ids, most, asked in zip(x["keys"], x.reps, x.rows, x.ids, x.most, x.asked, strict=True):
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows).reshape(-1, width)
                for a in range(0, len(ids), 64):
                    query, row, score = within(np.frombuffer(asked).reshape(-1, width)[a : a + 64], np.frombuffer(most)[a : a + 64], rows, np.frombuffer(reps, np.int64), k)
                    yield pd.DataFrame({"query_id": ids[a + query], "key": np.asarray(keys, object)[row], "score": score})

    held = saved(classes.select("key", "rep", "v").mapInPandas(packed, "keys array<string>, reps binary, rows binary"), "packed")
    asked = saved(queries.select("query_id", "v", "most").coalesce(1 + partitions(queries.sparkSession) // 8).mapInPandas(asking, "ids binary, most binary, asked binary"), "asking")
    held = held.repartition(partitions(queries.sparkSession))  # by work: blocks are small, but each meets all queries
    return held.crossJoin(asked).mapInPandas(compared, "query_id long, key string, score double")


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (size[0].d if size else 0))


def search(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every id divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    # the text of a vector decides equality; -0.0 counts as 0.0
    key = F.md5(F.to_json(F.transform("v", lambda x: x + F.lit(0.0))).cast("binary"))
    rows = saved(rows.withColumn("key", key), "vectors")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    members = saved(rows.select("key", "id").distinct().withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"), "members")
    classes = saved(rows.withColumn("place", place).filter("place = 1").select(F.col("id").alias("rep"), "key", "v"), "classes")
    size = classes.count()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rerank = rerank_for(size)
    width = classes.select(F.size("v")).first()[0]
    sample = classes.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(sample_size(size, width)).select("v").collect()
    block = int(np.clip(size // (4 * partitions(spark)), LEAST_BLOCK, MOST_BLOCK))
    index = train(np.array([r.v for r in sample]), size, block)

    def encoded(batches):
        for x in batches:
            own, codes = index.encode(index.scaled(_vectors(x.v))) if len(x) else ([], [])
            yield pd.DataFrame({"key": x.key, "list": own, "shard": index.shards[own] if len(x) else [], "code": [c.tobytes() for c in codes]})

    # a class is known by a number, its key's hash; where two keys share one, both are ranked
    codes = saved(classes.select("key", "v").mapInPandas(encoded, "key string, list int, shard int, code binary").withColumn("rep", F.xxhash64("key")).drop("key"), "codes")
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", "key").alias("v"))
    queries = saved(queries.withColumnRenamed("id", "query_id"), "queries")

    def probed(batches):
        for x in batches:
            lists = index.probed(index.to_lists(index.scaled(_vectors(x.v)))) if len(x) else []
            shards = [np.unique(index.shards[own]) for own in lists]
            yield pd.DataFrame({"query_id": np.repeat(x.query_id.to_numpy(), [len(s) for s in shards]), "shard": np.concatenate([*shards, np.zeros(0, np.int64)])})

    asked = saved(queries.select("query_id", "v").mapInPandas(probed, "query_id long, shard int"), "asked")
    blocks = codes.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    chunks = asked.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = saved(blocks.join(chunks, "shard"), "dealt")  # a row for each shard
    tasks = dealt.agg(F.sum(F.col("blocks") * F.col("chunks"))).first()[0] or 1
    # by work, not by bytes: codes are small, but each meets many queries
    tasks = max(1, min(int(tasks), 8 * partitions(spark)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["shard", "block", "chunk"]
    left = codes.join(dealt, "shard").withColumn("block", F.pmod("rep", "blocks").cast("int")).withColumn("chunk", each("chunks"))
    right = asked.join(dealt, "shard").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).withColumn("block", each("blocks"))
    right = right.join(queries, "query_id")
    schema = "query_id long, part int, reps array<long>, dists array<double>"

    def scored(key, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame([], columns=["query_id", "part", "reps", "dists"])
        x = x.sort_values(["list", "rep"], kind="stable")
        code = np.frombuffer(b"".join(x.code), np.uint8).reshape(len(x), len(index.books))
        lists, ids, part = x.list.to_numpy(), x.rep.to_numpy(), int(key[0]) * 7919 + int(key[1])
        out = []
        for a in range(0, len(q), 256):
            own = q.iloc[a : a + 256]
            found = index.search(index.scaled(_vectors(own.v)), code, lists, ids, rerank)
            out += [(query, part, reps, dist) for query, (dist, reps) in zip(own.query_id, found, strict=True) if len(reps)]
        return pd.DataFrame(out, columns=["query_id", "part", "reps", "dists"])

    sides = [d.select(*keys, *own).repartition(tasks, *keys).groupBy(*keys) for d, own in ((left, ("rep", "list", "code")), (right, ("query_id", "v")))]
    found = sides[0].cogroup(sides[1]).applyInPandas(scored, schema)

    def merged(key, x: pd.DataFrame) -> pd.DataFrame:
        dist, reps = np.concatenate([*x.dists]), np.concatenate([*x.reps]).astype(np.int64)
        best = np.lexsort((reps, dist))[:rerank]
        return pd.DataFrame([(key[0], int(x.part.iloc[0]), reps[best], dist[best])], columns=["query_id", "part", "reps", "dists"])

    parts = -(-size // block)
    while parts > FAN_IN:  # so that a merging task never holds more than about FAN_IN lists of RERANK
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("query_id", "part").applyInPandas(merged, schema)
    candidates = found.groupBy("query_id").applyInPandas(merged, schema).select("query_id", F.explode("reps").alias("rep"))

    def exact(batches):
        for x in batches:
            yield pd.DataFrame({"query_id": x.query_id, "key": x.key, "score": distances(_vectors(x.a), _vectors(x.b))})

    pairs = candidates.join(classes.select(F.xxhash64("key").alias("rep"), "key", F.col("v").alias("b")), "rep").join(queries.select("query_id", F.col("v").alias("a")), "query_id")
    scores = saved(pairs.select("query_id", "key", "a", "b").mapInPandas(exact, "query_id long, key string, score double"), "scores")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def nearest(scores: DataFrame) -> DataFrame:
        near = scores.join(members, "key").filter("id <> query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    bounds = nearest(scores).filter(F.col("rank") == k).select("query_id", F.col("score").alias("most"))
    bounds = queries.join(bounds, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    ranked = nearest(scores.unionByName(checked(classes, bounds, index, width, k)))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
