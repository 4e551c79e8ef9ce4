"""Language identification with bit-sliced Bloom filters of character trigrams.

One array of words holds a Bloom filter for each language, a bit of the word for a language: the AND of
the words that a trigram's hashes point at is the set of all languages that contain it.  More than 64
languages have an array of words for each 64.  Filters are as long as the largest language's set needs, in
words of a power of two.  For each text the bits are counted by language, the counts are corrected for each filter's false-positive rate, and
the largest corrected count decides.

The filters are learnt from a bounded sample: about PER_LANGUAGE documents of each language, those whose
ids hash below a rate.  A trigram belongs to a language if its share there is at least RELATIVE of its
largest share in any language.  Every language of the learning fold has a filter.

Defined results.  A null text, and one without letters, is "und" with score 0.  Equal counts go to the
language that comes first by name.  The score is the winner's part of all corrected counts.  A null lang
is not learnt from; with nothing to learn from every text is "und".  Every row gives one row, repeated
ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, crc_mod, mix, saved, slices, utf8

PER_LANGUAGE = 3000
WORD_BITS = 64
LEAST_COUNT, RELATIVE = 5, 0.5
#: Hashes of a trigram, the fewest slots of a filter, and slots for each trigram of the largest language.
HASHES, SLOTS, SLOTS_EACH = 3, 1 << 18, 6
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: 0 for anything but a letter, else the lower-case letter's code point."""
    if "fold" not in _tables:
        fold = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                fold[i] = ord(low) if len(low) == 1 else i
        _tables["fold"] = fold
    return _tables["fold"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the trigrams around each letter, the text each is of, and the letters of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = _letters()[np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), size + 1)[: len(codes)]
    padded = np.concatenate(([0], codes, [0])).astype(np.uint64)
    at = np.flatnonzero(codes)
    grams = (padded[at] << np.uint64(42)) | (padded[at + 1] << np.uint64(21)) | padded[at + 2]
    row = row[at]
    return grams, row, np.bincount(row, minlength=len(texts))


def _slots(grams: np.ndarray, size: int):
    h = mix(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


class Filters:
    """The filters of all languages; `languages` by bit."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= bits), np.uint64)
        self.size = max(SLOTS, 1 << int(SLOTS_EACH * max((len(x) for x in grams), default=1)).bit_length())
        self.words = np.zeros((max(1, -(-len(languages) // WORD_BITS)), self.size), kind)
        for bit, own in enumerate(grams):
            for slot in _slots(own, self.size):
                self.words[bit // WORD_BITS, slot] |= kind(1 << bit % WORD_BITS)
        self.false = np.array([float(((self.words[b // WORD_BITS] >> kind(b % WORD_BITS)) & kind(1)).mean()) ** HASHES for b in range(len(languages))])

    def sets(self, grams: np.ndarray, part: int = 0) -> np.ndarray:
        """For each trigram the bitmask of the languages that (seem to) contain it, of those with the bits of a part."""
        out = None
        for slot in _slots(grams, self.size):
            out = self.words[part, slot] if out is None else out & self.words[part, slot]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts by text and language, and the letters of each text."""
        grams, row, letters = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for part in range(len(self.words) if len(grams) else 0):
            found = self.sets(grams, part)
            for b in range(part * WORD_BITS, min(len(self.languages), (part + 1) * WORD_BITS)):
                hits = np.bincount(row[(found >> found.dtype.type(b % WORD_BITS)) & found.dtype.type(1) != 0], minlength=len(texts))
                out[:, b] = np.maximum(0, (hits - letters * self.false[b]) / max(1e-9, 1 - self.false[b]))
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, letters = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = counts.argmax(1), counts.sum(1)
        # a text whose trigrams no filter knows still gets a learned language, with score 0
        score = np.where(letters > 0, counts.max(1) / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], score


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from doc_id, text and lang of the documents outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Filters([], [])
    languages = sorted(n)
    bits = {x: bit for bit, x in enumerate(languages)}
    rates = F.map_from_entries(F.from_json(F.lit(json.dumps([{"k": x, "v": min(1.0, per_language / n[x])} for x in languages if n[x] > per_language])), "array<struct<k:string,v:double>>"))
    rate = F.coalesce(F.element_at(rates, F.col("lang")), F.lit(1.0))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20) < rate)

    out = arrow_schema("bit int, gram long, n long")

    def run(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array([bits[x] for x in batch.column("lang").to_pylist()], np.int64)
            _, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                grams, row, _ = trigrams(texts[a:b])
                for bit in np.unique(langs[a:b]):
                    codes, counts = np.unique(grams[langs[a:b][row] == bit], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), bit, np.int32)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], schema=out)

    # shares and the largest of them are taken by Spark: only the trigrams that a filter will hold reach the driver
    counted = saved(sample.select("text", "lang").mapInArrow(run, "bit int, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n")).filter(f"n >= {LEAST_COUNT}"), "grams")
    totals = F.broadcast(counted.groupBy("bit").agg(F.sum("n").alias("total")))  # a row for each language
    shares = counted.join(totals, "bit").select("bit", "gram", (F.col("n") / F.col("total")).alias("share"))
    least = F.max("share").over(Window.partitionBy("gram")) * RELATIVE
    own = shares.withColumn("least", least).filter("share >= least").groupBy("bit").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()
    held = {r.bit: np.array(r.grams, np.int64).astype(np.uint64) for r in own}
    return Filters(languages, [held.get(b, np.zeros(0, np.uint64)) for b in range(len(languages))])


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = filters or learn(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    out = arrow_schema(schema)
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                names, score = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], schema=out)

    return rows.mapInArrow(run, schema)
