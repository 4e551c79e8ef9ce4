"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Partitions count terms in radix tries over bytes, one trie for each language, whose leaves carry a counter for
each source.  The tries are laid out flat, as arrays of leaves in the order of a walk, so that numpy and
Arrow build and merge them whole.  Tries of BYTES bytes are written out and begun anew, so a task's memory has a bound.  The leaves are dealt by ranges of (language, term);
each range walks its tries' leaves in order, adds up equal ones, and keeps those in AT_LEAST documents, in
blocks of TERMS terms.  Blocks meet the sources of their language, in packs of PACK: one pass adds up the
differences of every two sources and keeps each source's first TOP terms, ties in the order of UTF-8.

A common term costs one leaf for each trie and source, whatever its count.  Every two sources of a language
make a row of the result by its definition; work on them is done in blocks of PACK x PACK sources.

Defined results.  Null text, language and source count as ''.  Rows that repeat an id are documents of their
own.  Texts without terms, languages without kept terms and sources without any give pairs of value 0.  An
empty table gives an empty result; other columns are ignored.  Counts are exact up to 9 * 10**15 a language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, lower_ascii, partitions, runs, saved, slices, spans, utf8

AT_LEAST, TOP, SMOOTH, SCALE = 30, 50, 5, 1000
#: Bytes of terms that wait to become a trie, bytes of a task's tries, terms and counters of a block, sources of a pack.
WAITING, BYTES = 1 << 23, 1 << 26
TERMS, ENTRIES, PACK = 1024, 1 << 16, 128

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SEGMENT = "lang string, term string, df long, source array<string>, count array<long>"
_BLOCK = "lang string, terms array<string>, totals array<long>, at array<int>, source array<string>, count array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


def _walked(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms in the order of bytes, which is that of UTF-8, and the place there of each given one."""
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Trie:
    """A radix trie over bytes, laid out flat: its leaves as a walk meets them, documents of each leaf, and
    counters of each leaf and source (leaf << 32 | source, in order)."""

    terms: pa.Array
    df: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, coded: pa.DictionaryArray, doc: np.ndarray, source: np.ndarray) -> Trie:
        """Of terms, with the document of each and the source of each document."""
        terms, leaf = _walked(coded)
        n = max(1, len(terms))
        pairs, times = _summed(doc * n + leaf, np.ones(len(leaf), np.int64))
        leaf, doc = pairs % n, pairs // n
        return cls(terms, np.bincount(leaf, minlength=len(terms)), *_summed((leaf << 32) + source[doc], times))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        if len(tries) == 1:
            return tries[0]
        terms, place = _walked(pa.concat_arrays([t.terms for t in tries]).dictionary_encode())
        cuts = np.cumsum([len(t.terms) for t in tries])[:-1]
        keys = [(own[t.keys >> 32] << 32) + (t.keys & 0xFFFFFFFF) for t, own in zip(tries, np.split(place, cuts), strict=True)]
        return cls(terms, np.bincount(place, np.concatenate([t.df for t in tries]), len(terms)).astype(np.int64), *_summed(np.concatenate(keys), np.concatenate([t.counts for t in tries])))

    @property
    def size(self) -> int:
        return len(self.terms) * 16 + self.terms.nbytes + len(self.keys) * 16


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _count():
    """Documents (lang, source, text) to leaves of tries."""
    out = arrow_schema(_SEGMENT)

    def run(batches):
        tries: dict[str, list[Trie]] = {}
        sources: dict[str, int] = {}
        waiting: list[tuple] = []

        def grown():
            """The waiting texts as one more trie for each language."""
            langs = np.concatenate([w[0] for w in waiting])
            source = np.concatenate([w[1] for w in waiting])
            number = np.repeat(np.arange(len(langs)), np.concatenate([w[2] for w in waiting]))
            terms = pa.concat_arrays([w[3] for w in waiting])
            names, of = np.unique(langs, return_inverse=True)
            for k, lang in enumerate(names.tolist()):
                mine = of[number] == k
                if mine.any():
                    tries.setdefault(lang, []).append(Trie.of(terms.filter(pa.array(mine)).dictionary_encode(), number[mine], source))
            waiting.clear()

        def written():
            names = pa.array(list(sources), pa.string())
            for lang in sorted(tries, key=lambda x: x.encode()):
                trie = Trie.merged(tries[lang])
                size = np.bincount(trie.keys >> 32, minlength=len(trie.terms))
                upto = np.concatenate(([0], np.cumsum(size)))
                cuts = [*range(0, len(trie.terms), ENTRIES // 4), len(trie.terms)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    at = slice(upto[a], upto[b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (b - a), pa.string()), trie.terms[a:b].cast(pa.large_string()).cast(pa.string()), pa.array(trie.df[a:b]), _lists(size[a:b], names.take(pa.array(trie.keys[at] & 0xFFFFFFFF))), _lists(size[a:b], pa.array(trie.counts[at]))], schema=out
                    )
            tries.clear()
            sources.clear()

        for batch in batches:
            langs, places, (data, offsets) = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist(), utf8(batch.column(2))
            for a, b in slices(offsets):
                text = lower_ascii(data[offsets[a] : offsets[b]])
                starts, ends, before = runs(_LETTER[text], offsets[a : b + 1] - offsets[a])
                waiting.append((langs[a:b], np.array([sources.setdefault(x, len(sources)) for x in places[a:b]], np.int64), np.diff(before), spans(text, starts, ends)))
            if sum(w[3].nbytes for w in waiting) > WAITING:
                grown()
                if sum(t.size for own in tries.values() for t in own) > BYTES:
                    for own in tries.values():
                        own[:] = [Trie.merged(own)]
                    if sum(own[0].size for own in tries.values()) > BYTES // 2:
                        yield from written()
        if waiting:
            grown()
        yield from written()

    return run


def _merge(at_least: int):
    """Leaves in the order of (lang, term) to blocks of those in at least so many documents."""
    leaf, out = arrow_schema(_SEGMENT), arrow_schema(_BLOCK)

    def added(t: pa.Table) -> pa.Table:
        """Equal neighbours as one leaf."""
        lang, term, df = (t.column(c).combine_chunks() for c in ("lang", "term", "df"))
        if not len(term):
            return t
        other = np.concatenate(([True], pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)))
        first, run = np.flatnonzero(other), np.cumsum(other) - 1
        source, count = t.column("source").combine_chunks(), t.column("count").combine_chunks()
        coded = source.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, counts = _summed(np.repeat(run, source.value_lengths().to_numpy(zero_copy_only=False)) * max(1, len(names)) + codes, count.flatten().to_numpy(zero_copy_only=False))
        size = np.bincount(keys // max(1, len(names)), minlength=len(first))
        at = pa.array(first)
        return pa.Table.from_arrays([lang.take(at), term.take(at), pa.array(np.add.reduceat(df.to_numpy(zero_copy_only=False), first)), _lists(size, names.take(pa.array(keys % max(1, len(names))))), _lists(size, pa.array(counts))], schema=leaf)

    def blocks(t: pa.Table):
        t = t.filter(pc.greater_equal(t.column("df"), at_least))
        if not len(t):
            return
        langs = t.column("lang").to_pylist()
        sizes = pc.list_value_length(t.column("source")).to_numpy()
        a = 0
        for k in range(1, len(langs) + 1):
            if k == len(langs) or langs[k] != langs[a] or k - a == TERMS or sizes[a : k + 1].sum() > ENTRIES:
                own = t.slice(a, k - a).combine_chunks()
                source, count = own.column("source").combine_chunks().flatten(), own.column("count").combine_chunks().flatten()
                at = np.repeat(np.arange(k - a), sizes[a:k])
                totals = np.add.reduceat(count.to_numpy(zero_copy_only=False), np.cumsum(sizes[a:k]) - sizes[a:k])
                one = lambda x: _lists(np.array([len(x)]), x)
                yield pa.RecordBatch.from_arrays([pa.array([langs[a]], pa.string()), one(own.column("term").combine_chunks()), one(pa.array(totals)), one(pa.array(at, pa.int32())), one(source), one(count)], schema=out)
                a = k

    def run(batches):
        rest = leaf.empty_table()
        for batch in batches:
            t = added(pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(leaf)]).combine_chunks())
            if len(t):  # the last leaf may go on in the next batch; the kept ones wait for a block's worth
                rest = t.slice(len(t) - 1)
                yield from blocks(t.slice(0, len(t) - 1))
        yield from blocks(rest)

    return run


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10**9 (count + SMOOTH) / (total + SMOOTH terms)), by long division so that nothing overflows."""
    whole, left, by = 0, count + SMOOTH, total + SMOOTH * terms
    for _ in range(3):
        digit, left = np.divmod(left * SCALE, by)
        whole = whole * SCALE + digit
    return whole + 1


def _compare(top: int):
    """Rows of a block and two packs of sources to differences of sources, and to candidates of the first pack's sources."""
    out = arrow_schema(_FOUND)

    def emitted(rows: list[tuple]):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def counts(row: dict, names: list[str]) -> np.ndarray:
        place = {s: i for i, s in enumerate(names)}
        coded = row["source"].dictionary_encode()
        column = np.array([place.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        m, here = np.zeros((len(row["terms"]), len(names)), np.int64), column >= 0
        m[row["at"].to_numpy(zero_copy_only=False)[here], column[here]] = row["count"].to_numpy(zero_copy_only=False)[here]
        return m

    def run(batches):
        far: dict[tuple, list] = {}
        best: dict[tuple, list] = {}

        def pairs():
            for (lang, same), (a, b, m) in ((k[:2], v) for k, v in far.items()):
                rows = [(lang, x, "pair", y, int(m[i, j])) for i, x in enumerate(a) for j, y in enumerate(b) if not (same and i == j)]
                yield from emitted(rows + ([] if same else [(lang, y, p, x, v) for _, x, p, y, v in rows]))
            far.clear()

        def firsts():
            for (lang, source), rows in best.items():
                yield from emitted([(lang, source, "term", t.decode(), -v) for v, t in rows])
            best.clear()

        for batch in batches:
            for k in range(len(batch)):
                row = {f: batch.column(f)[k].values if pa.types.is_list(batch.schema.field(f).type) else batch.column(f)[k].as_py() for f in batch.schema.names}
                a, b, lang, same = row["a_source"].to_pylist(), row["b_source"].to_pylist(), row["lang"], row["i"] == row["j"]
                _, _, sums = far.setdefault((lang, same, row["i"], row["j"]), [a, b, np.zeros((len(a), len(b)), np.int64)])
                if row["terms"] is None:
                    continue
                p = counts(row, a)
                own = share(p, row["a_n"].to_numpy(zero_copy_only=False), row["v"])
                other = own if same else share(counts(row, b), row["b_n"].to_numpy(zero_copy_only=False), row["v"])
                for i in range(len(a)):
                    sums[i] += np.abs(other - own[:, i : i + 1]).sum(0)
                if same:
                    terms = [t.encode() for t in row["terms"].to_pylist()]
                    over = np.where(p > 0, own - share(row["totals"].to_numpy(zero_copy_only=False), row["n_lang"], row["v"])[:, None], 0)
                    for i, s in enumerate(a):
                        held = best.setdefault((lang, s), [])
                        at = np.flatnonzero(over[:, i] > (-held[-1][0] - 1 if len(held) == top else 0))
                        best[lang, s] = sorted(held + [(-int(over[t, i]), terms[t]) for t in at])[:top]
                if len(far) > 256:
                    yield from pairs()
                if len(best) > 8192:
                    yield from firsts()
        yield from pairs()
        yield from firsts()

    return run


def report(docs: DataFrame, at_least: int = AT_LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, as said above."""
    spark, text = docs.sparkSession, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    leaves = saved(rows.mapInArrow(_count(), _SEGMENT), "trie-leaves")
    ranges = leaves.repartitionByRange(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    blocks = saved(ranges.mapInArrow(_merge(at_least), _BLOCK), "term-blocks")

    per_lang = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_lang"))
    own = blocks.select("lang", F.explode(F.arrays_zip("source", "count")).alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.count").alias("n"))
    known = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    packs = known.withColumn("i", (place / PACK).cast("int")).groupBy("lang", "v", "n_lang", "i").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))
    packs = saved(packs.select("lang", "v", "n_lang", "i", F.col("s.source").alias("a_source"), F.col("s.n").alias("a_n")), "sources")  # at most PACK a row
    other = packs.select("lang", F.col("i").alias("j"), F.col("a_source").alias("b_source"), F.col("a_n").alias("b_n"))
    met = packs.join(other, "lang").filter("i <= j").join(blocks, "lang", "left")
    found = met.mapInArrow(_compare(top), _FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return found.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
