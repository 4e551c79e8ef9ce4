"""Lexical and dense search, fusion and diversity (survey C1-C3, D1, D2, E8, E9, F1-F4, H33-H35, K4, K5, K7)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ragframe.functions import fixed
from ragframe.functions.text import bm25_tokens


class Bm25Index:
    """An inverted index in DataFrames: postings (term, id, tf, dl), lengths (id, dl), terms (term, df, idf) and totals.

    keep writes a table and reads it back, for searches; apart says that a text's postings lie in several partitions.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, terms: DataFrame, totals: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, apart: bool = False):
        self.postings, self.lengths, self.terms, self.totals, self.keep, self.apart = postings, lengths, terms, totals, keep, apart


#: Bytes of text that are cut into tokens at once.
COUNTED_BYTES = 1 << 20
#: fixed.BM25_TOKEN for UTF-8: its ASCII characters, and the second bytes of its other ones, which all begin with C3.
_PLAIN, _MARKED = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz0123456789", "áéíóúüñ".encode()[1::2]))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each text in lower case, and all tokens one after the other: those of bm25_tokens."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _PLAIN[data]
    second = np.flatnonzero((data[:-1] == 0xC3) & _MARKED[data[1:]]) + 1
    inside[second] = inside[second - 1] = True
    before, cut = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
    before[1:], cut[offsets] = inside[:-1], True
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    before[:-1], before[-1:] = inside[1:], False
    ends = np.flatnonzero(inside & (~before | cut[1:])) + 1
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return np.diff(np.searchsorted(starts, offsets)), found


def _slices(texts: pa.Array):
    """Places and numbers of texts of COUNTED_BYTES together, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNTED_BYTES, "right")))
        yield a, b - a
        a = b


def _count_terms(schema: pa.Schema):
    """Rows (id, text in lower case) as rows (term, id, tf, dl): a row for each distinct token, and one without term for the text.

    A batch is worked on in slices, so that what a worker holds depends neither on the table nor on the batch. A
    slice's rows ascend by token, the ones without come last: a sort by token finds runs, and equal tokens stand together.
    """

    def run(batches):
        for batch in batches:
            for a, n in _slices(batch.column("text")):
                ids, (sizes, tokens) = batch.column("id").slice(a, n), _tokens(batch.column("text").slice(a, n))
                coded = tokens.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                key, tf = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), sizes), return_counts=True)
                row = np.concatenate((key % n, np.arange(n)))
                term = pa.concat_arrays([coded.dictionary.take(pa.array(order[key // n])), pa.nulls(n, coded.dictionary.type)])
                columns = [term, ids.take(pa.array(row)), pa.array(np.concatenate((tf, np.zeros(n, np.int64)))), pa.array(sizes[row].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def counted_terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """term, id, tf, dl of docs: cut into tokens and counted in the same pass, where the texts lie."""
    rows = docs.select(F.col(key).alias("id"), F.lower(text).alias("text"))
    out = T.StructType([T.StructField("term", T.StringType()), rows.schema["id"], T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    return rows.mapInArrow(_count_terms(to_arrow_schema(out)), out)


def weighted_terms(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """term, df, idf of counts (term, df) and one row of totals (n, ...); an idf below zero becomes a share of the mean."""
    raw = counts.join(F.broadcast(totals), how="cross").select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean), how="cross").select("term", "df", F.when(F.col("raw") < 0, F.lit(fixed.BM25_EPSILON) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))  # one row


def bm25_index(docs: DataFrame, key: str, text: Column, keep: Callable[[DataFrame], DataFrame] | None = None) -> Bm25Index:
    """K4: statistics of a corpus; idf below zero becomes a share of the mean idf over the vocabulary.

    A text's tokens are counted in its own batch, so postings need no shuffle; document frequencies are partial
    aggregates, of which a partition deals one row a term.  keep writes the counted rows and reads them back, so
    that texts are cut into tokens once.
    """
    rows = counted_terms(docs, key, text)
    rows = keep(rows) if keep else rows
    lengths = rows.filter("term is null").select("id", "dl")
    postings = rows.filter("term is not null")
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    size = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Bm25Index(postings, lengths, weighted_terms(counts, size), size, keep)


#: Hits (rows of query, term and text) that one task adds up.
TASK_HITS = 1 << 20

#: Query terms (rows of query and term) that are sent to every executor: some 10 MB; more are joined by shuffling.
MOST_BROADCAST_TERMS = 200_000


def bm25_search(index: Bm25Index, queries: DataFrame, query: str, text: Column, k: int) -> DataFrame:
    """query, id, score, rank of the k best positive scores of each query; ties to the smaller id.

    Only the postings of query terms are joined; repeated query terms count again.  The queries' terms are
    counted first: where they are few, postings meet them where they are and only hits are shuffled.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(bm25_tokens(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(index.terms, "term")
    weighted = index.keep(weighted) if index.keep else weighted
    if asked.limit(MOST_BROADCAST_TERMS + 1).count() <= MOST_BROADCAST_TERMS:
        weighted = F.broadcast(weighted if index.keep else index.terms.join(F.broadcast(asked), "term"))
    hits = index.postings.join(weighted, "term").join(F.broadcast(index.totals), how="cross")  # one row
    k1, b = F.lit(fixed.BM25_K1), F.lit(fixed.BM25_B)
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = hits.select("query", "id", part.alias("part"))
    # where a text's hits lie apart no task adds them up before they are dealt; document frequencies tell how many there are
    if index.apart and (many := weighted.agg(F.sum("df")).first()[0] or 0) > TASK_HITS:
        hits = hits.repartition(-(-many // TASK_HITS), "id")
    scores = hits.groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")
    return ranked(scores, "query", k)


def ranked(scores: DataFrame, query: str, k: int | None = None, id_: str = "id") -> DataFrame:
    """rank (from 1) by score, the best first, ties to the smaller id; the first k where k is given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), id_)))
    return out if k is None else out.filter(F.col("rank") <= k)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows that grow with a table, as one side of a join: both sides are shuffled by its key, and none goes through the driver.

    Spark guesses sizes from packed files, and knows neither how many rows explode makes nor what Python puts into
    a row; by such guesses hundreds of MB were broadcast.
    """
    return rows.hint("merge")


def inner(a: Column, b: Column) -> Column:
    """The inner product, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Rows of a block of queries and of a block of vectors, a pair of which is what a task holds; queries of one product; tasks that share the blocks of one value of by.
QUERY_BLOCK, VECTOR_BLOCK, PRODUCT_ROWS, SHARES = 1024, 4096, 64, 16


def _blocks(rows: DataFrame, by: str | None, size: int, prefix: str) -> DataFrame:
    """Rows (id, v, by) as blocks of at most `size` rows of one value of by: ids and a matrix, as bytes."""

    def run(batches):
        for x in batches:
            for value, part in x.groupby("__by", sort=False, dropna=False):
                for a in range(0, len(part), size):
                    piece = part.iloc[a : a + size]
                    yield pd.DataFrame({"__by": [value], f"{prefix}_ids": [piece.id.to_numpy(np.int64).tobytes()], f"{prefix}_rows": [np.stack(piece.v.to_numpy()).astype(float).tobytes()]})

    rows = rows.select("id", "v", (F.col(by).cast("string") if by else F.lit("")).alias("__by")).filter("id is not null and v is not null and __by is not null")
    return rows.mapInPandas(run, f"__by string, {prefix}_ids binary, {prefix}_rows binary")


def nearest_rows(asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, selves: np.ndarray | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k largest inner products of each query; ids ascend, so ties go to the smaller one.

    With 6 digits products are rounded and ranked. With 9 they are ranked as `best_first` ranks them, and are sums
    in the order of the components, as expressions add them up; products of matrices tell which are to be added.
    """
    scores = asked @ rows.T
    if selves is not None:
        scores[selves[:, None] == ids[None, :]] = -np.inf
    scores = np.round(scores, 6) if digits == 6 else scores
    last = np.partition(scores, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(asked), -np.inf)
    query, row = np.nonzero((scores >= (last if digits == 6 else last - 1e-8 * (1 + np.abs(last)))[:, None]) & np.isfinite(scores))
    found = scores[query, row]
    keys = (row, -found, query)
    if digits != 6:
        found = np.zeros(len(query))
        for x, y in zip(asked.T, rows.T, strict=True):
            found += x[query] * y[row]
        keys = (row, -found, -np.round(found, digits), query)
    order = np.lexsort(keys)
    query = query[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], row[order][kept], found[order][kept]


def best_first(score: str = "score", id_: str = "id") -> list[Column]:
    """The best score first, those that are equal in nine digits by the whole score, equal ones by id."""
    return [F.desc(F.round(score, 9)), F.desc(score), F.col(id_)]


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, exclude_self: bool = False, by: str | None = None, digits: int = 6) -> DataFrame:
    """Query, id, score, rank of the k largest inner products, exactly, for a stated set of queries.

    Both sides are packed into blocks where they lie; every pair of blocks is one matrix product that keeps
    the k best of each query, and the best of all blocks are ranked at the end.  The vectors are scanned once,
    nothing comes to the driver.  With by (a column of both sides), only pairs of equal values count.
    Queries of equal vectors (and by) are asked once.  digits: 6 or 9, see `nearest_rows`.
    """
    of = (F.col(by).cast("string") if by else F.lit("")).alias("__by")
    rows = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), of).filter("id is not null and v is not null and __by is not null")
    one = rows if exclude_self else rows.groupBy("v", "__by").agg(F.min("id").alias("id"))
    asked = _blocks(one, "__by", QUERY_BLOCK, "q")
    held = _blocks(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), *([by] if by else [])), by, VECTOR_BLOCK, "v")

    def scored(batches):
        for batch in batches:
            for value, q_ids, q_rows, v_ids, v_rows in zip(batch["__by"], batch.q_ids, batch.q_rows, batch.v_ids, batch.v_rows, strict=True):
                asked_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
                order = np.argsort(ids, kind="stable")
                ids, held = ids[order], np.frombuffer(v_rows).reshape(len(ids), -1)[order]
                asked = np.frombuffer(q_rows).reshape(len(asked_ids), -1)
                for a in range(0, len(asked), PRODUCT_ROWS):
                    own = asked_ids[a : a + PRODUCT_ROWS]
                    query, row, found = nearest_rows(asked[a : a + PRODUCT_ROWS], held, ids, k, own if exclude_self else None, digits)
                    yield pd.DataFrame({"__by": value, "query": own[query], "id": ids[row], "score": found})

    if by:  # a value's blocks of vectors are shared out, each share meets all of its queries
        share = F.pmod(F.xxhash64("v_ids"), F.lit(SHARES)).cast("int")
        asked = asked.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        pairs = held.withColumn("__share", share).join(shuffled(asked), ["__by", "__share"])
    else:
        pairs = held.crossJoin(asked.drop("__by"))  # a stated query set, in blocks
    found = pairs.select("__by", "q_ids", "q_rows", "v_ids", "v_rows").mapInPandas(scored, "__by string, query long, id long, score double")
    order = [F.desc("score"), F.col("id")] if digits == 6 else best_first()
    best = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    if not exclude_self:
        members = rows.join(shuffled(one.withColumnRenamed("id", "query")), ["v", "__by"]).select("query", "__by", F.col("id").alias("member"))
        found = best(found, "query", "__by").drop("rank").join(shuffled(members), ["query", "__by"]).select(F.col("member").alias("query"), "id", "score")
    return best(found.select("query", "id", "score"), "query")


def rrf(rankings: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """K5: rankings (query, id, rank from 1), several rows for an id: the sum of 1 / (k + rank), ranked anew.

    One aggregate stands for the full outer join of the rankings.
    """
    fused = rankings.groupBy("query", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return ranked(fused, "query")


def mmr_select(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float = fixed.MMR_LAMBDA) -> list[int]:
    """K7: greedy choice of k rows by weight * relevance - (1 - weight) * similarity to what is chosen; ties to the first."""
    n = len(relevance)
    nearest, open_, chosen = np.zeros(n), np.ones(n, bool), []
    for _ in range(min(k, n)):
        value = np.where(open_, np.round(weight * relevance - (1 - weight) * nearest, 9), -np.inf)
        best = int(np.argmax(value))
        chosen.append(best)
        open_[best] = False
        near = vectors @ vectors[best]
        nearest = near if len(chosen) == 1 else np.maximum(nearest, near)
    return chosen


def mmr(candidates: DataFrame, k: int, weight: float = fixed.MMR_LAMBDA) -> DataFrame:
    """Candidates (query, id, score, vector) of a bounded number for each query: query, id, score, rank (from 1).

    With a weight of 1 nearness doesn't count: the best k are a window's, whatever the number of candidates.
    """
    if weight == 1:
        ranks = candidates.select("query", "id", "score", F.row_number().over(Window.partitionBy("query").orderBy(*best_first())).alias("rank"))
        return ranks.filter(F.col("rank") <= k)

    def run(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen = mmr_select(x.score.to_numpy(), np.stack(x.vector.to_numpy()).astype(float), k, weight)
        return pd.DataFrame({"query": key[0], "id": x.id.to_numpy()[chosen], "score": x.score.to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return candidates.select("query", "id", "score", "vector").groupBy("query").applyInPandas(run, "query long, id long, score double, rank int")
