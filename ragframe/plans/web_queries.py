"""Queries of web sources: titles, links, headings, URLs, crawling, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.sources import frontier, store, timetable, web

from .registry import query, table


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS heading FROM pages")
def html_title(spark, sf_dir):
    """A8's title and A11-like heading."""
    return _pages(spark, sf_dir).select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1>(.*?)</h1>", 1), "<[^>]*>", "")).alias("heading"))


_URL = r"CASE WHEN ends_with(lower(u), '.pdf') THEN u ELSE regexp_replace(u, '/+$', '') END"
_NORM = "CASE WHEN starts_with({0}, 'http://') AND contains({0}, 'ugr.es') THEN 'https://' || substr({0}, 8) ELSE {0} END"


@query(f"SELECT page_id, {_URL} AS url FROM (SELECT page_id, {_NORM.format('m')} AS u FROM (SELECT page_id, replace(url, '//ti', '//ugr.es/ti') || '/' AS m FROM pages))")
def url_normalise(spark, sf_dir):
    """A6, on urls moved below the institution's domain."""
    moved = F.concat(F.replace("url", F.lit("//ti"), F.lit("//ugr.es/ti")), F.lit("/"))
    return _pages(spark, sf_dir).select("page_id", web.normalised_url(moved).alias("url"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN ends_with(lower(url), '.txt') THEN 'txt' ELSE 'html' END AS kind FROM pages")
def url_host(spark, sf_dir):
    """H39, A3."""
    url = F.col("url")
    return _pages(spark, sf_dir).select("page_id", web.host(url).alias("host"), web.path(url).alias("path"), web.source_type(F.lit(None).cast("string"), url).alias("kind"))


@query(r"""
SELECT page_id, (regexp_matches(h, '(^|\.)example\.(com|net)$') AND (ext = '' OR ext = '.html') AND NOT regexp_matches(url, '(?i)utm_source')) AS passes, regexp_matches(url, '(?i)/(en|fr)/') AND NOT regexp_matches(url, '(?i)page=2') AS in_category
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '[^/](\.[^./]+)$', 1) AS ext FROM pages)
""")
def url_filters(spark, sf_dir):
    """B1-B4."""
    url = F.col("url")
    ok = web.passes(url, ["example.com", "example.net"], [".html"], ["utm_source"], web.year_patterns("25-26"))
    return _pages(spark, sf_dir).select("page_id", ok.alias("passes"), web.in_category(url, ["/(en|fr)/"], ["page=2"]).alias("in_category"))


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS h FROM pages)
SELECT DISTINCT url, CASE WHEN ends_with(lower(x), '.pdf') THEN x ELSE regexp_replace(x, '/+$', '') END AS link FROM (SELECT url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || h AS x FROM l WHERE starts_with(h, '/'))
""")
def html_links(spark, sf_dir):
    """A5; all of the pages' links are paths."""
    return web.links(_pages(spark, sf_dir)).filter(F.col("link").rlike("^https?://"))


@query(r"""
WITH p AS (SELECT page_id, 'https://s.es/' || page_id AS url FROM pages),
e AS (SELECT DISTINCT 'https://s.es/' || page_id AS url, 'https://s.es/' || (page_id * k + 1) % (SELECT count(*) FROM pages) AS link FROM pages, (VALUES (2), (3)) v(k)),
l0 AS (SELECT DISTINCT url, 0 AS depth FROM p WHERE url = 'https://s.es/0'),
l1 AS (SELECT DISTINCT e.link AS url, 1 AS depth FROM l0 JOIN e USING (url) WHERE e.link NOT IN (SELECT url FROM l0) AND NOT ends_with(e.link, '5')),
s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT DISTINCT e.link AS url, 2 AS depth FROM l1 JOIN e USING (url) WHERE e.link NOT IN (SELECT url FROM s1) AND NOT ends_with(e.link, '5')),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
l3 AS (SELECT DISTINCT e.link AS url, 3 AS depth FROM l2 JOIN e USING (url) WHERE e.link NOT IN (SELECT url FROM s2) AND NOT ends_with(e.link, '5'))
SELECT url, CAST(depth AS INTEGER) AS depth FROM s2 UNION ALL SELECT url, CAST(depth AS INTEGER) AS depth FROM l3
""")
def crawl_bfs(spark, sf_dir):
    """Three levels from one seed over a link graph of the pages."""
    pages = _pages(spark, sf_dir)
    n = pages.count()
    name = lambda c: F.concat(F.lit("https://s.es/"), c.cast("string"))
    edges = pages.select(name(F.col("page_id")).alias("url"), F.explode(F.array(*[name((F.col("page_id") * k + 1) % n) for k in (2, 3)])).alias("link")).distinct()
    keep = lambda d: store.materialised(d, "crawl")
    return web.crawl(spark.createDataFrame([("https://s.es/0",)], "url string"), edges, lambda u: ~F.endswith(u, F.lit("5")), 3, keep)


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(nav)\b.*?</nav>|<footer\b.*?</footer>|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'),
  '(?i)</?(p|h[1-6]|br|div|li|tr|article)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '[ \t]*\n\s*', chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM pages
""")
def html_text_regex(spark, sf_dir):
    """A8 with expressions only."""
    return _pages(spark, sf_dir).select("page_id", web.plain_text(F.col("html")).alias("text"))


def _level(k):
    """SQL of a crawl's level: reached, owned by the first category with room, cut to what is left of its quota."""
    return f"""
r{k} AS (SELECT DISTINCT e.link AS url, f.category FROM l{k - 1} f JOIN e USING (url) WHERE NOT ends_with(e.link, '5') AND NOT (f.category = 'b' AND ends_with(e.link, '7')) AND e.link NOT IN (SELECT url FROM s{k - 1})),
q{k} AS (SELECT q.category, priority, quota - (SELECT count(*) FROM s{k - 1} s WHERE s.category = q.category) AS room FROM q),
o{k} AS (SELECT url, min(priority) AS priority FROM r{k} JOIN q{k} USING (category) WHERE room > 0 GROUP BY url),
l{k} AS (SELECT url, category, priority, {k} AS depth FROM (SELECT o.*, q.category, q.room, row_number() OVER (PARTITION BY q.category ORDER BY url) AS place FROM o{k} o JOIN q{k} q USING (priority)) WHERE place <= room),
s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""


@query(f"""
WITH n AS (SELECT count(*) AS n FROM pages),
e AS (SELECT DISTINCT 'https://h' || (page_id % 3) || '.es/' || page_id AS url, 'https://h' || (((page_id * k + 1) % n) % 3) || '.es/' || ((page_id * k + 1) % n) AS link FROM pages, n, (SELECT unnest([2, 3, 7]) AS k)),
q AS (SELECT * FROM (VALUES ('a', 2, 25), ('b', 1, 9)) x(category, priority, quota)),
l0 AS (SELECT * FROM (VALUES ('https://h2.es/2', 'a', 2, 0), ('https://h1.es/1', 'b', 1, 0)) x(url, category, priority, depth)), s0 AS (SELECT * FROM l0),
{",".join(_level(k) for k in range(1, 5))}
SELECT url, category, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY depth, split_part(url, '/', 3) ORDER BY url) - 1 AS INTEGER) AS slot FROM s4
""")
def crawl_quotas(spark, sf_dir):
    """Two categories with quotas over a link graph of all pages, stopped after level 1 and gone on with."""
    pages = _pages(spark, sf_dir)
    n = pages.count()
    name = lambda c: F.concat(F.lit("https://h"), (c % 3).cast("string"), F.lit(".es/"), c.cast("string"))
    edges = pages.select(name(F.col("page_id")).alias("url"), F.explode(F.array(*[name((F.col("page_id") * k + 1) % n) for k in (2, 3, 7)])).alias("link")).distinct()
    seeds = spark.createDataFrame([("https://h2.es/2", "a"), ("https://h1.es/1", "b"), ("https://h1.es/1", "a")], "url string, category string")
    quotas = spark.createDataFrame([("a", 2, 25), ("b", 1, 9)], "category string, priority int, quota long")
    keep = lambda category, url: ~F.endswith(url, F.lit("5")) & ~((category == "b") & F.endswith(url, F.lit("7")))
    path = store.scratch(spark, "frontier")
    for depth in (1, 4):
        rows = frontier.crawl(seeds, quotas, edges, keep, path, depth)
    return rows.select("url", "category", "depth", "slot")


def html_parsed(spark, sf_dir):
    """A8, A12 by the parser."""
    return web.parsed(_pages(spark, sf_dir))


query(None)(html_parsed)


@query(r"SELECT page_id, coalesce(list_filter([trim(x) FOR x IN string_split(html, chr(10))], lambda x: x <> '')[1], '') AS first_line FROM pages")
def text_title(spark, sf_dir):
    """A11."""
    return _pages(spark, sf_dir).select("page_id", F.coalesce(web.text_title(F.col("html")), F.lit("")).alias("first_line"))


@query("WITH r AS (SELECT * FROM (VALUES ('tionsh.example.net', '/fr/'), ('blog.tionble.example.com', '')) v(host, prefix)) SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.prefix <> '' AND r.host = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.prefix))")
def robots_allowed(spark, sf_dir):
    """A2."""
    rules = spark.createDataFrame([("tionsh.example.net", "/fr/"), ("blog.tionble.example.com", "")], "host string, prefix string")
    return web.allowed_by_robots(_pages(spark, sf_dir).select("page_id", "url"), rules).select("page_id")


def _grid_words(docs):
    """A timetable for every document: its words stand on a page by rule of the id, with a legend of its source."""
    d, words = F.col("doc_id"), []

    def put(x, y, token, where=None):
        word = F.struct(F.lit(x).cast("double").alias("x"), F.lit(float(y)).alias("y"), (token if not isinstance(token, str) else F.lit(token)).alias("token"))
        words.append(word if where is None else F.when(where, word))

    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    put(40, 10, said((1 + d % 4).cast("string"), "º"))
    put(40, 30, F.when(d % 2 == 0, "1er").otherwise("2º"))
    for x, y, token in (
        (60, 10.5, "Grado"), (90, 12, "en"), (100, 9.5, "Ingeniería"), (140, 10, "Informática"), (55, 30, "cuatrimestre"), (120, 50, "LUNES"), (200, 50, "Martes"), (280, 51, "Miércoles"), (360, 50, "jueves"), (440, 50, "Viernes"),
        (500, 71, " "), (40, 70, "8:30-9:30"), (40, 95, "9:30-10:30"), (40, 120, "10:30-11:30"),
    ):
        put(x, y, token)
    for i in range(5):
        for k in range(3):
            cell, y = (d + i + k) % 3 == 0, 70 + 25 * k
            short = said(F.chr(65 + d % 26), chr(65 + 5 * i) + chr(65 + k))
            put(120 + 80 * i + d % 7 - 3, y + 1.5 * (i % 2), short, cell)
            put(125 + 80 * i + d % 7, y, "(A1)", cell & ((d + i) % 2 == 0))
            put(122 + 80 * i, y + 12, said(f"{1 + i}.", (1 + d % 9).cast("string")), cell & (d % 5 != 0))
            if i == 2:
                put(150 + 80 * i, y, "ZZ", cell & (d % 4 == 0))
            if k == 0:
                for x, token in ((40, said(short, ".")), (60, "Materia"), (90, said(F.col("source"), "."))):
                    put(x, 160 + 10 * i, token, cell & ((d + i) % 2 == 0))
    return docs.select("doc_id", F.lit(1).alias("page"), F.inline(F.filter(F.array(*words), lambda w: w.isNotNull())))


_CELLS = "SELECT doc_id AS d, source, i, k, chr(CAST(65 + doc_id % 26 AS INTEGER)) || chr(CAST(65 + 5 * i AS INTEGER)) || chr(CAST(65 + k AS INTEGER)) AS s FROM (SELECT doc_id, source, unnest(range(0, 5)) AS i FROM documents) CROSS JOIN (SELECT unnest(range(0, 3)) AS k) WHERE (doc_id + i + k) % 3 = 0"
_GRID_SQL = f"""
WITH c AS ({_CELLS}),
m AS (SELECT *, CASE WHEN k = 0 AND (d + i) % 2 = 0 THEN 'Materia ' || source || ' (' || s || ')' ELSE s END AS name, (1 + d % 4) || 'º Grado en Ingeniería Informática, ' || CASE WHEN d % 2 = 0 THEN '1er' ELSE '2º' END || ' cuatrimestre' AS place FROM c),
r AS (SELECT d, 0 AS part, k, i, place || ' — ' || ['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes'][i + 1] || ' ' || (8 + k) || ':30-' || (9 + k) || ':30: ' || name || CASE WHEN (d + i) % 2 = 0 THEN ' (A1)' ELSE '' END
        || CASE WHEN d % 4 = 0 AND i = 2 THEN '; ZZ' ELSE '' END || CASE WHEN d % 5 <> 0 THEN ', aula ' || (1 + i) || '.' || (1 + d % 9) ELSE '' END || '.' AS record FROM m),
t AS (SELECT d, place, name FROM m UNION SELECT d, place, 'ZZ' FROM m WHERE d % 4 = 0 AND i = 2),
a AS (SELECT * FROM r UNION ALL SELECT d, 1, 0, 0, 'Asignaturas de ' || place || ': ' || string_agg(name, '; ' ORDER BY name) || '.' FROM t GROUP BY d, place)
SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY part, k, i) - 1 AS INTEGER) AS position, record FROM a
"""


@query(_GRID_SQL)
def schedule_grid(spark, sf_dir):
    """A grid for every document, read back from its words' places."""
    words = _grid_words(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return timetable.parse(words, keep=lambda rows: store.materialised(rows, "grid"))


@query("SELECT n_nationkey, CASE WHEN abs(120 - n_nationkey * 17) <= abs(200 - n_nationkey * 17) AND abs(120 - n_nationkey * 17) <= abs(280 - n_nationkey * 17) THEN 'Lunes' WHEN abs(200 - n_nationkey * 17) <= abs(280 - n_nationkey * 17) THEN 'Martes' ELSE 'Miércoles' END AS day FROM nation")
def nearest_column(spark, sf_dir):
    """C17."""
    return table(spark, sf_dir, "nation").select("n_nationkey", timetable.nearest(F.col("n_nationkey") * 17.0, {"Lunes": 120, "Martes": 200, "Miércoles": 280}).alias("day"))


@query("SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE s.s_nationkey = n.n_regionkey AND s.s_acctbal BETWEEN n.n_nationkey * 100 AND n.n_nationkey * 100 + 400)")
def outside_rectangles(spark, sf_dir):
    """Points in no rectangle, on the relational tables."""
    s = F.col("s_acctbal")
    blocks = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page"), s.alias("x0"), s.alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    n = F.col("n_nationkey") * 100.0
    rects = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), n.alias("x0"), (n + 400).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    return timetable.outside_tables(blocks, rects).select("s_suppkey")
