"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import ann, divergence, exact_dedup, html_text, langid, near_dedup, packing, quality, secrets, sentencepieces, toxicity, warc, whitening
from .common import small_batches
from .common import table as read_table


def table(spark, sf_dir, name):
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark, sf_dir):
    return near_dedup.report(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark, sf_dir):
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_secrets": op1_secrets, "op2_exact_dedup": op2_exact_dedup, "op3_warc": op3_warc, "op4_ann": op4_ann, "op5_language_id": op5_language_id, "op6_sentencepiece": op6_sentencepiece, "op7_packing": op7_packing, "op8_html_text": op8_html_text, "op9_quality": op9_quality, "op10_near_dedup": op10_near_dedup,
           "op11_source_divergence": op11_source_divergence, "op12_whitening": op12_whitening, "op13_toxicity": op13_toxicity}

_OP2 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""

_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g >> {}) & 31 AS BIGINT) + 1, 1)"
_OP3 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string([{" || ".join(_LETTER.format(s) for s in (15, 10, 5, 0))} FOR g IN [CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT) FOR i IN range(8)]], '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (payload_digest)
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
b AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.reach)
SELECT n.doc_id, n.n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

_SHARE = "1 + CAST(1000000000 AS HUGEINT) * ({} + 5) // ({} + 5 * v)"
_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT i, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS total FROM e GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(kept.t) AS v, coalesce(sum(total), 0) AS n_lang FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
c AS (SELECT lang, source, t, count(*) AS c FROM e JOIN kept USING (lang, t) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, g.source, t, coalesce(c, 0) AS c, CAST({_SHARE.format("coalesce(c, 0)", "n")} AS BIGINT) AS p, CAST({_SHARE.format("total", "n_lang")} AS BIGINT) AS q
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, t)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', t, p - q FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""

ORACLE = {"op11_source_divergence": _OP11, "op10_near_dedup": _OP10, "op2_exact_dedup": _OP2, "op3_warc": _OP3}
