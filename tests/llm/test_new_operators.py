"""Source divergence, whitening and toxicity against brute force, SQL and held-out accuracy, with the edge cases each must bear."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragframe.llm import divergence, near_dedup, toxicity, warc, whitening
from ragframe.llm.common import table
from ragframe.llm.queries import ORACLE, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, item string, value string"


def docs_of(spark, rows):
    """(text, lang, source) as documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, *r, 0, "x", "y", "z") for i, r in enumerate(rows)], DOCS).repartition(3)


# --- source divergence ---------------------------------------------------------------------------------


def brute_divergence(rows, at_least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, count, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in rows}
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= at_least]
        own = {s: count[lang, s] for x, s in groups if x == lang}
        p = lambda c, n, k=kept: 1 + 10**9 * (c + 5) // (n + 5 * len(k))
        ps = {s: {t: p(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in own.items()}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: p(total[t], sum(total.values())) for t in kept}
        for s in own:
            pairs = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if own[s][t] and ps[s][t] > q[t])[:top]
            out |= {(lang, s, part, x, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(found)}
    return out


def random_texts(rng, n):
    words = ["der", "Die", "das", "a", "aa", "aaa", "ab", "ÉTÉ", "été", "漢字", "漢", "ß", "x1y", "b-c", " ", "é", "🙂", "Zz"]
    at = lambda xs: xs[int(rng.integers(len(xs)))]
    return [(" ".join(at(words) for _ in range(int(rng.integers(0, 12)))), at(["en", "de", "en", None, ""]), at(["s1", "s2", "s3", "é", None, "s1"])) for _ in range(n)]


def test_divergence_against_brute_force(spark, monkeypatch):
    rows = random_texts(np.random.default_rng(3), 300) + [(None, "fr", "only"), ("", "xx", "a"), ("12 34", "xx", "b"), ("long " * 50_000 + "y" * 200_000, "en", "s1")] * 2
    want = brute_divergence(rows, 5, 4)
    got = divergence.report(docs_of(spark, rows), at_least=5, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(divergence, "PACK", 2)  # sources of a language in several packs
    assert {tuple(r) for r in divergence.report(docs_of(spark, rows), at_least=5, top=4).collect()} == want


def test_tries_of_a_task_are_written_in_parts(spark, monkeypatch):
    """Small bounds make each task write and merge many tries, and blocks hold few terms."""
    rows = random_texts(np.random.default_rng(4), 400)
    pieces = pa.RecordBatch.from_pylist([{"lang": x or "", "source": s or "", "text": t} for t, x, s in rows], pa.schema([(c, pa.string()) for c in ("lang", "source", "text")]))
    for name, value in (("WAITING", 64), ("BYTES", 2048), ("TERMS", 3), ("ENTRIES", 8)):
        monkeypatch.setattr(divergence, name, value)
    leaves = [r for b in divergence._count()(iter([pieces.slice(a, 7) for a in range(0, len(pieces), 7)])) for r in b.to_pylist()]
    assert len(leaves) > len({(r["lang"], r["term"]) for r in leaves})  # a term came in several tries
    leaves.sort(key=lambda r: (r["lang"].encode(), r["term"].encode()))
    schema = divergence.arrow_schema(divergence._SEGMENT)
    blocks = list(divergence._merge(5)(pa.RecordBatch.from_pylist(leaves[a : a + 5], schema) for a in range(0, len(leaves), 5)))
    got = {(b["lang"], t): n for x in blocks for b in x.to_pylist() for t, n in zip(b["terms"], b["totals"], strict=True)}
    df, count = defaultdict(Counter), Counter()
    for t, x, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        df[x or ""].update(set(terms))
        count.update((x or "", w) for w in terms)
    assert got == {k: n for k, n in count.items() if df[k[0]][k[1]] >= 5}


def test_divergence_against_sql_and_empty(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    want = c.sql(ORACLE["op11_source_divergence"])
    got = QUERIES["op11_source_divergence"](spark, LARGER)
    assert got.columns == want.columns
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())
    assert divergence.report(docs_of(spark, [("a", "en", "s")]).limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles():
    count, total = np.array([0, 7, 10**12 + 3, 8 * 10**15]), 8 * 10**15 + 7
    assert divergence.share(count, total, 12_345).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * 12_345) for c in count.tolist()]


# --- whitening ----------------------------------------------------------------------------------------


def brute_whitening(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    a = np.array(x, float) - np.array([s / n for s in sums])
    values, components = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)[:8]
    return n, [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x], a @ components[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def vectors_of(spark, vectors, of="float"):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{of}>, component int, whitened double").repartition(5)


def test_whitening_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(300, 12)) * np.arange(1, 13) + 3).astype(np.float32).tolist()
    good += good[:20] + [[0.0] * 12]
    bad = [None, [], [1.0] * 11, [None] + [1.0] * 11, [float("nan")] * 12, [1.0] * 11 + [float("inf")]]
    monkeypatch.setattr(whitening, "ROWS", 7)
    rows = whitening.whiten(vectors_of(spark, good + bad)).orderBy("vec_id", "component").collect()
    n, deviations, white, explained = brute_whitening(good)
    assert [(r.vec_id, r.component) for r in rows] == [(i, k) for i in range(n) for k in range(1, 9)]
    assert {r.n for r in rows} == {n} and [r.deviation for r in rows[::8]] == deviations
    got = np.array([r.whitened for r in rows]).reshape(n, 8)
    assert np.allclose(np.abs(got), np.abs(white), atol=1e-8) and np.allclose(np.abs((got * white).mean(0)), 1)
    assert np.allclose([r.explained for r in rows[:8]], explained, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_constant_few_large_and_no_vectors(spark):
    flat = whitening.whiten(vectors_of(spark, [[1.0, 2.0, 3.0]] * 4)).collect()
    assert len(flat) == 12 and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in flat} == {(None, 0, 0.0, 0.0)}
    line = whitening.whiten(vectors_of(spark, [[float(i), 2.0 * i] for i in range(10)])).collect()
    assert len(line) == 20 and sum(r.whitened is not None for r in line) == 10
    large = whitening.whiten(vectors_of(spark, [[3e38, -3e38], [-3e38, 3e38], [1e9, 1e9], [2e9, 5e9]], "double")).collect()
    assert len(large) == 8 and all(r.deviation is None for r in large)
    some = whitening.whiten(vectors_of(spark, [[1e9, 1e9], [2e9, 5e9], [2e9, 0.0]], "double")).collect()
    x = np.array([[int(1024 * c) + 100_000 for c in v] for v in ([10**9, 10**9], [2 * 10**9, 5 * 10**9], [2 * 10**9, 0])], object)
    exact = ((3 * x - x.sum(0)) ** 2).sum(1)
    assert {r.vec_id: r.deviation for r in some} == {i: (int(v) if v < 2**63 else None) for i, v in enumerate(exact)}
    assert whitening.whiten(vectors_of(spark, [[1.0]]).limit(0)).count() == whitening.whiten(vectors_of(spark, [None, []])).count() == 0


def test_chan_merging_in_any_grouping():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (100, 5))
    whole, parts = whitening.Moments.of(x), [whitening.Moments.of(p) for p in np.split(x, [1, 1, 50, 99])]
    left = parts[0]
    for p in parts[1:]:
        left = left.merge(p)
    right = parts[0].merge(parts[1].merge(parts[2])).merge(parts[3].merge(parts[4]))
    for m in (left, right):
        assert m.n == 100 and m.sums == whole.sums == x.sum(0).tolist()
        assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scatter, whole.scatter, rtol=1e-10)


def test_whitening_query(spark):
    assert QUERIES["op12_whitening"](spark, SF).count() == 8 * table(spark, SF, "embeddings").count()


# --- toxicity -----------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    labels = table(spark, LARGER, "labels").select("doc_id", "toxic")
    rows = QUERIES["op13_toxicity"](spark, LARGER).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    caught, spared = np.mean([r.predicted for r in toxic]), np.mean([1 - r.predicted for r in clean])
    print(f"caught {caught:.3f} of {len(toxic)}, left alone {spared:.3f} of {len(clean)}")
    assert caught >= 0.75 and spared >= 0.98


def test_toxicity_of_unseen_endings_and_disguises(spark):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abdeilmnorstu"), int(rng.integers(2, 9)))) for _ in range(400)]
    text = lambda more=(): " ".join([*rng.choice(plain, 40), *(["you"] if rng.random() < 0.5 else []), *more])
    hits = lambda: ["grolkz" + "".join(rng.choice(list("aeiou"), 3)), str(rng.choice(["vexnik", "Vexnik!"])), str(rng.choice(["grolkz", "vexnik"]))]
    bad = lambda: hits()[int(rng.integers(0, 2)) : int(rng.integers(2, 4))]
    texts = [text(bad() if i % 5 == 0 else ()) for i in range(600)]
    tests = [text(["grolkzyyy"]), text(["VEXNIK"]), text(["v3xn1k"]), text(["gr0lkz", "you"]), text(), text(["you"]), text(["rolkz", "nikvex"])]
    extra = docs_of(spark, [(t, "en", "s") for t in texts + tests + [None, "", "a" * 100_000, "🙂 " * 1000, text(bad()) * 500]])
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(600)] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r for r in toxicity.score(extra, labels).collect()}
    assert len(rows) == len(texts) + len(tests) + 5
    assert [rows[600 + i].predicted for i in range(len(tests))] == [1, 1, 1, 1, 0, 0, 0]
    assert [rows[607 + i].predicted for i in range(5)] == [0, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [i for i in range(600) if rows[i].held_out]
    assert np.mean([rows[i].predicted == (i % 5 == 0) for i in held]) > 0.99


def test_toxicity_without_labels_and_rows(spark):
    docs = docs_of(spark, [("a b", "en", "s"), (None, None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, none).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(i, 0) for i in range(2)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, one).collect()] == [0.0] * 2
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    seen = lambda x: sorted((r.doc_id, r.score) for r in toxicity.score(docs, x).collect())
    assert seen(labels) == seen(other)


def test_isotonic_calibration_and_trees():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    ends, shares = toxicity.isotonic(raw, y)
    assert (np.diff(ends) >= 0).all() and (np.diff(shares) >= 0).all()
    best = min(((np.interp(raw, ends, shares) - y) ** 2).mean(), 1)
    assert best <= ((1 / (1 + np.exp(-2 * raw)) - y) ** 2).mean() + 1e-9  # no monotone curve fits better
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((toxicity.grow(x, y).raw(x) > 0) == (y > 0)).mean() > 0.97
    assert toxicity.grow(x, np.zeros(2000)).raw(x).max() < -5 and len(toxicity.grow(x[:0], y[:0]).raw(x)) == 2000


@pytest.mark.parametrize("text,want", [("ÉTÉ Straße ÀB", "été straße àb"), ("×A", "×a")])
def test_lower_case_of_bytes(text, want):
    assert toxicity.lowered(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == want


# --- repairs of earlier operators -----------------------------------------------------------------------


def test_words_built_to_collide_stay_apart(spark):
    """Thue-Morse words: a polynomial modulo 2**64 has the same value for such a word and its complement, whatever its base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = near_dedup.report(docs_of(spark, [(word, "en", "s"), (other, "en", "s"), (f"{word} x y z", "en", "s"), (f"{other} x y z", "en", "s"), (word, "en", "s")]), k=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_page_ids_of_any_type(spark):
    pages = spark.createDataFrame([("p1", "u", "x"), ("p 2", "u", "x"), ("", "v", "y")], "page_id string, url string, html string")
    rows = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert len(rows) == 3 and {r[0] for r in rows} == {"p1", "p 2", None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_leave_the_session_as_it_was(spark, name):
    state = lambda: {k: v for k, v in spark.conf.getAll.items() if k != "spark.sql.execution.arrow.maxBytesPerBatch"}  # noqa: E731  bounded by every query
    before = state()
    QUERIES[name](spark, SF).count()
    assert state() == before
