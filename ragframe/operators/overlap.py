"""Set-similarity join of a query side with a large side by the share of a query's tokens (survey C14, D4, F9).

A row that shares at least r of a query's n tokens shares one of any n - r + 1 of them, so only a query's rarest
n - r + 1 tokens are joined, and whole sets are compared afterwards.  Tokens in more than a share of all rows
(`hot`) are never joined: with h of them in a query, a match shares r - h of the others, of which again only
the rarest are joined.  Queries that could match by hot tokens alone (r <= h) meet the rows in blocks, as
products of membership matrices.  All three ways are exact; which one a query takes depends on its tokens.

Where the queries' tokens can be sent to every executor, `overlap_texts` does without joins: texts are cut into tokens
and compared with all queries in one pass where they lie, so that nothing of a text is written or shuffled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ragframe.functions.text import salient_tokens, without_marks

from .search import MOST_BROADCAST_TERMS, _slices

#: Share of the rows above which a token is hot; queries and rows of a block.
HOT, ASKED_BLOCK, HELD_BLOCK = 0.05, 128, 512


def least_shared(n: Column, share: float, least: int) -> Column:
    """How many of n tokens must be shared at least, for a share that is rounded to six places."""
    return F.greatest(F.lit(least), F.ceil(n * F.lit(share - 1e-6))).cast("int")


def prefixes(asked: DataFrame, held: DataFrame, share: float, least: int, hot: float = HOT) -> DataFrame:
    """query_id, tokens, n, r (least shared), tested (the tokens to join, none hot) and alone (hot tokens may do) of each query.

    asked: query_id, tokens; held: tokens.  Both are sets.
    """
    words = asked.select("query_id", F.explode("tokens").alias("x"))
    counts = held.select(F.explode("tokens").alias("x")).join(words.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.count("*").alias("df"))
    rows = held.agg((F.count("*") * F.lit(hot)).alias("most"))
    each = words.join(counts, "x", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "x"))).alias("ranked"))  # a query's own tokens
    known = asked.join(each, "query_id").join(F.broadcast(rows), how="cross")  # one row
    known = known.withColumn("n", F.size("tokens")).withColumn("r", least_shared(F.col("n"), share, least))
    cold = F.filter("ranked", lambda t: t.df <= F.col("most"))
    known = known.withColumn("cold", F.transform(cold, lambda t: t.x)).withColumn("need", F.col("r") - (F.col("n") - F.size("cold")))
    tested = F.when(F.col("need") >= 1, F.slice("cold", F.lit(1), F.greatest(F.lit(0), F.size("cold") - F.col("need") + 1))).otherwise(F.array().cast("array<string>"))
    return known.select("query_id", "tokens", "n", "r", tested.alias("tested"), ((F.col("need") < 1) & (F.col("r") <= F.col("n"))).alias("alone"))


def _blocks(rows: DataFrame, id_: str, size: int, prefix: str) -> DataFrame:
    """Rows (id, tokens, and r of queries) as blocks: lists of ids and sizes, all tokens one after the other."""
    kept = [id_, "tokens", *(["r"] if "r" in rows.columns else [])]
    kind = rows.schema[id_].dataType.simpleString()
    schema = f"{prefix}ids array<{kind}>, {prefix}sizes array<int>, {prefix}tokens array<string>" + (f", {prefix}r array<int>" if "r" in kept else "")
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                lists = [part.column(0), pc.list_value_length(part.column(1)), part.column(1).flatten(), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(f.type) for x, f in zip(lists, out, strict=True)], schema=out)

    return rows.select(*kept).mapInArrow(run, schema)


def shared_counts(a_tokens: pa.Array, a_sizes: np.ndarray, b_tokens: pa.Array, b_sizes: np.ndarray) -> np.ndarray:
    """How many tokens each set of a shares with each of b; tokens that b lacks are left out first."""
    known = b_tokens.dictionary_encode()
    words = max(1, len(known.dictionary))
    sides = []
    for codes, sizes in ((pc.index_in(a_tokens, known.dictionary), a_sizes), (known.indices, b_sizes)):
        codes, row = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        m = np.zeros((len(sizes), words), np.float32)
        m[row[codes >= 0], codes[codes >= 0]] = 1
        sides.append(m)
    return np.rint(sides[0] @ sides[1].T).astype(np.int64)


def _in_blocks(asked: DataFrame, held: DataFrame, schema: str) -> DataFrame:
    """query_id, doc_id, shared of the pairs that share at least r tokens; every block of rows meets every block of the stated queries."""
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    pairs = _blocks(held, "doc_id", HELD_BLOCK, "h_").crossJoin(_blocks(asked, "query_id", ASKED_BLOCK, "a_"))  # a stated query set, in blocks

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                own = {f: batch.column(f)[k].values for f in batch.schema.names}
                sizes = [own[f].to_numpy(zero_copy_only=False) for f in ("h_sizes", "a_sizes")]
                shared = shared_counts(own["h_tokens"], sizes[0], own["a_tokens"], sizes[1])
                row, query = np.nonzero(shared >= own["a_r"].to_numpy(zero_copy_only=False)[None])
                columns = [own["a_ids"].take(pa.array(query)), own["h_ids"].take(pa.array(row)), pa.array(shared[row, query].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return pairs.mapInArrow(run, schema)


def overlap_join(asked: DataFrame, held: DataFrame, share: float, least: int, keep, hot: float = HOT) -> DataFrame:
    """query_id, doc_id, shared, score of every pair that shares `least` tokens and `share` of the query's.

    asked: query_id, tokens; held: doc_id, tokens; sets, both.  keep writes a table and reads it back: the rows
    are read for counts, candidates and comparison.  Ids must be unique; null tokens and empty sets match nothing.
    """
    held, asked = (keep(x.select(i, "tokens")).filter(F.size("tokens") >= least) for x, i in ((held, "doc_id"), (asked, "query_id")))  # written first, so that a filter doesn't cut texts into tokens twice
    known = keep(prefixes(asked, held, share, least, hot))
    tested = known.select("query_id", F.col("r").alias("at_least"), F.explode("tested").alias("x"))
    if tested.limit(MOST_BROADCAST_TERMS + 1).count() <= MOST_BROADCAST_TERMS:
        tested = F.broadcast(tested)
    found = held.select("doc_id", F.size("tokens").alias("size"), F.explode("tokens").alias("x")).join(tested, "x").filter("size >= at_least").select("query_id", "doc_id").distinct()
    found = keep(found).join(known.select("query_id", F.col("tokens").alias("own"), "r"), "query_id").join(held, "doc_id")
    compared = found.withColumn("shared", F.size(F.array_intersect("own", "tokens"))).filter("shared >= r").select("query_id", "doc_id", "shared")
    kinds = [asked.schema["query_id"].dataType.simpleString(), held.schema["doc_id"].dataType.simpleString()]
    dense = _in_blocks(known.filter("alone"), held, f"query_id {kinds[0]}, doc_id {kinds[1]}, shared int")
    scored = compared.unionByName(dense).join(known.select("query_id", "n"), "query_id").withColumn("score", F.round(F.col("shared") / F.col("n"), 6))
    return scored.filter(F.col("score") >= share).select("query_id", "doc_id", "shared", "score")


#: Characters of tokens and of the patterns that `salient_tokens` takes out before it; all others only part tokens.
_TOLD_APART = "abcdefghijklmnopqrstuvwxyz0123456789[]:"
#: Bytes for a character that parts tokens, for the end of a text, for one that becomes several and for one that goes.
_PARTS, _END, _SEVERAL, _GONE = 0x20, 0x0A, 0xFE, 0xFF
#: What stands between texts that are worked on together: no decoded text has it.
_BETWEEN = "\ud800"
_IN_TOKEN = np.isin(np.arange(256), np.frombuffer(_TOLD_APART[:36].encode(), np.uint8))


@functools.cache
def folding() -> tuple[np.ndarray, np.ndarray, dict[str, str]]:
    """Code points that don't only part tokens and the byte that each becomes in lower case without marks; and what those become that become several."""
    codes, kept, several = [ord(_BETWEEN)], [_END], {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        if not (c.isascii() or unicodedata.decomposition(c) or unicodedata.combining(c) or c.lower() != c):
            continue  # stays as it is, or a Hangul syllable
        out = "".join(x if x in _TOLD_APART else " " for x in without_marks(c.lower()))
        if out.strip() or not out:
            codes.append(ord(c))
            kept.append(_GONE if not out else ord(out) if len(out) == 1 else _SEVERAL)
            if len(out) > 1:
                several[c] = out
    return np.array(codes), np.array(kept, np.uint8), several


def fold_table(codes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The byte of every code point."""
    table = np.full(0x110000, _PARTS, np.uint8)
    table[codes] = kept
    return table


def token_runs(texts: pa.Array, table: np.ndarray, several: dict[str, str]) -> tuple[np.ndarray, pa.Array]:
    """The place of its text for each run of letters and digits, and the runs: those of `salient_tokens`, short ones and stop words too, again and again."""
    whole = _BETWEEN.join(t.decode("utf-8", "replace") if t else "" for t in texts.cast(pa.large_binary()).to_pylist())
    folded = lambda s: table[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]
    data = folded(whole)
    if (data == _SEVERAL).any():
        data = folded(re.sub("[" + "".join(several) + "]", lambda m: several[m[0]], whole))
    text = re.sub(rb"\[[0-9]+\]", b" ", data[data != _GONE].tobytes())
    if re.search(rb":[0-9]{2}", text):  # looks for a colon, which is faster
        text = re.sub(rb"([0-9]{1,2}):[0-9]{2}", rb"\1", text)
    data = np.frombuffer(text, np.uint8)
    inside = _IN_TOKEN[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    bounds = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(edges) // 2, [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return np.searchsorted(np.flatnonzero(data == _END), edges[::2]), runs


#: Pairs of a text and a query's token that are counted at once.
COUNTED_PAIRS = 1 << 20


def _scan(asked: pa.Table, schema: pa.Schema):
    """Rows (text as __text, others) as rows (query_id, others, shared, n) of the pairs that share at least r tokens.

    asked: query_id, tokens, n, r.  Texts are worked on in slices and counted against all queries, so that what a worker
    holds depends neither on the table nor on the batch.
    """
    asked = asked.combine_chunks()
    ids, n_asked, least = asked.column("query_id"), asked.column("n"), asked.column("r").to_numpy()
    own = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in asked.column("tokens").chunks] or [pa.array([], pa.large_string())])
    query = np.repeat(np.arange(len(asked)), pc.list_value_length(asked.column("tokens")).to_numpy())
    coded = own.dictionary_encode()
    words, code = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    query, code = query[code >= 0], code[code >= 0]  # a null is equal to nothing
    query, sizes = query[np.argsort(code, kind="stable")], np.bincount(code, minlength=len(words))
    firsts = np.cumsum(sizes) - sizes
    at_once = max(1, COUNTED_PAIRS // max(1, len(own)))
    codes, kept, several = folding()

    def counted(part: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, runs = token_runs(part.column("__text"), table, several)
        found = pc.fill_null(pc.index_in(runs, words), -1).to_numpy(zero_copy_only=False)
        text, word = np.divmod(np.unique((at * len(words) + found)[found >= 0]), max(1, len(words)))
        for a in range(0, len(part), at_once):
            b, k = min(len(part), a + at_once), slice(*np.searchsorted(text, (a, a + at_once)))
            many = sizes[word[k]]
            place = np.repeat(firsts[word[k]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(np.repeat(text[k] - a, many) * len(ids) + query[place], minlength=(b - a) * len(ids)).reshape(b - a, len(ids))
            row, q = np.nonzero(shared >= least)
            rows = pa.array(row + a)
            columns = {"query_id": ids.take(pa.array(q)), "shared": pa.array(shared[row, q]), "n": n_asked.take(pa.array(q))}
            columns |= {f: part.column(f).take(rows) for f in part.schema.names if f != "__text"}
            if len(rows):
                yield pa.RecordBatch.from_pydict({f.name: _plain(columns[f.name]).cast(f.type) for f in schema}, schema=schema)

    def run(batches):
        table = fold_table(codes, kept)
        for batch in batches:
            for a, n in _slices(batch.column("__text")):
                yield from counted(batch.slice(a, n), table)

    return run


def _plain(column) -> pa.Array:
    """A column that may be chunked, as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def overlap_texts(asked: DataFrame, docs: DataFrame, text: str, share: float, least: int, keep) -> DataFrame:
    """query_id, columns of docs but for text, shared, score of every pair that `overlap_join` finds for the salient tokens of text.

    asked: query_id, tokens; docs: doc_id, text, any others.  The queries' tokens are counted first: MOST_BROADCAST_TERMS go to
    every executor, more are joined.
    """
    from pyspark.sql import types as T

    others = [c for c in docs.columns if c != text]
    asked = keep(asked.select("query_id", "tokens"))
    few = asked.filter(F.size("tokens") >= least)
    if (few.agg(F.sum(F.size("tokens"))).first()[0] or 0) > MOST_BROADCAST_TERMS:
        found = overlap_join(asked, docs.select("doc_id", salient_tokens(F.col(text)).alias("tokens")), share, least, keep)
        return found.join(docs.select(*others), "doc_id").select("query_id", *others, "shared", "score")
    few = few.withColumn("n", F.size("tokens")).withColumn("r", F.greatest(F.lit(1), least_shared(F.col("n"), share, least)))
    rows = docs.select(*others, F.col(text).alias("__text"))
    schema = T.StructType([asked.schema["query_id"], *(rows.schema[c] for c in others), T.StructField("shared", T.IntegerType()), T.StructField("n", T.IntegerType())])
    found = rows.mapInArrow(_scan(few.toArrow(), to_arrow_schema(schema)), schema)
    return found.withColumn("score", F.round(F.col("shared") / F.col("n"), 6)).filter(F.col("score") >= share).select("query_id", *others, "shared", "score")
