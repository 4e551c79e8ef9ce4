"""Web sources: URL filters, links, a category-directed crawl over a link table, HTML parsing (survey A1-A12, B1-B5)."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ragframe.functions import fixed
from ragframe.functions.text import java, stripped


def source_type(content_type: Column, url: Column) -> Column:
    """A3: pdf, txt or html, by MIME type and extension."""
    kind, url = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.contains(kind, F.lit("pdf")) | F.endswith(url, F.lit(".pdf")), "pdf").when(F.contains(kind, F.lit("text/plain")) | F.endswith(url, F.lit(".txt")), "txt").otherwise("html")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The decoded path; an undecodable one stays as it is."""
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def normalised_url(url: Column, domain: str = "ugr.es") -> Column:
    """Https for the institution's domain; no slash at the end, but for PDF files."""
    url = F.when(F.startswith(url, F.lit("http://")) & F.contains(url, F.lit(domain)), F.concat(F.lit("https://"), url.substr(F.lit(8), F.length(url)))).otherwise(url)
    return F.when(F.endswith(F.lower(url), F.lit(".pdf")), url).otherwise(F.regexp_replace(url, "/+$", ""))


def allowed_extension(url: Column, extensions: list[str]) -> Column:
    """B1: an allowed extension, or none."""
    found = F.regexp_extract(F.lower(path(url)), r"[^/](\.[^./]+)$", 1)
    return (found == "") | found.isin([e.lower() for e in extensions])


def year_patterns(current: str, first: int = 15) -> list[str]:
    """Patterns of urls of earlier academic years, from "YY-YY"; none for anything else."""
    if not re.fullmatch(r"\d+-\d+", current):
        return []
    now = int(current.split("-")[0])
    past = [(y, y + 1) for y in range(first, now)]
    if not past:
        return []
    spelled = lambda form: "|".join(form.format(a, b) for a, b in past)
    years, short = "|".join(str(2000 + y) for y in range(first, now + 1)), "|".join(f"{y:02d}" for y in range(first, now + 1))
    return [
        rf"(?:\(|[^0-9])(?:{spelled('{:02d}-{:02d}')})(?:\)|[^0-9]|$)",
        rf"(?:{spelled('20{:02d}[-_]{:02d}')})",
        rf"(?:{spelled('20{:02d}[-_]20{:02d}')})",
        rf"(?:{spelled('20{:02d}[.]{:02d}')})",
        rf"(?:{'|'.join(fixed.MONTHS)})\s?(?:{years})(?!\d)",
        rf"(?:{'|'.join(fixed.MONTHS_SHORT)})(?:{years}|{short})(?!\d)",
    ]


def _any(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | column.rlike(java(p)), patterns, F.lit(False))


def passes(url: Column, domains: list[str], extensions: list[str], excluded: list[str] = (), years: list[str] = ()) -> Column:
    """B2: the global filters; years: patterns on the decoded url, for temporal documents."""
    own = reduce(lambda a, d: a | (host(url) == d) | F.endswith(host(url), F.lit(f".{d}")), domains, F.lit(False))
    plain = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return own & allowed_extension(url, extensions) & ~_any(url, list(excluded)) & ~_any(plain, list(years))


def in_category(url: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """A pattern of the category hits the decoded url, and none of its exclusions does."""
    plain = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return _any(plain, list(include)) & ~_any(plain, list(exclude))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """A2: urls (url) without those under a disallowed prefix of their host; rules: (host, prefix). No rules: allowed."""
    rows = urls.withColumn("host", host(F.col("url"))).withColumn("__path", path(F.col("url")))
    denied = rows.join(rules.filter(F.length("prefix") > 0), "host").filter(F.startswith("__path", F.col("prefix"))).select("url").distinct()
    return rows.drop("host", "__path").join(denied, "url", "left_anti")


def _joined(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    def one(found, url):
        out = []
        for h in found if found is not None else ():
            h = html.unescape(h).strip()
            if h and not h.lower().startswith(("mailto:", "tel:", "javascript:")):
                try:
                    out.append(urldefrag(urljoin(url or "", h))[0])
                except ValueError:  # a malformed address in a page
                    continue
        return list(dict.fromkeys(out))

    return pd.Series([one(f, b) for f, b in zip(hrefs, base, strict=True)], dtype=object)


_joined.__annotations__ = {"hrefs": pd.Series, "base": pd.Series, "return": pd.Series}


def links(pages: DataFrame) -> DataFrame:
    """A5: (url, link) of the pages' anchors, absolute, without fragments, normalised, distinct."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    joined = F.pandas_udf(_joined, ArrayType(StringType()))(hrefs, F.col("url"))
    return pages.select("url", F.explode(joined).alias("link")).select("url", normalised_url(F.col("link")).alias("link")).distinct()


def crawl(seeds: DataFrame, link_table: DataFrame, keep: Callable[[Column], Column], depth: int, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: d.checkpoint(), max_pages: int | None = None) -> DataFrame:
    """A4: (url, depth) reached from seeds (url) over links (url, link) that `keep` accepts; seeds bypass it.

    A level is a join with the link table and an anti-join with what was seen; lineage is cut each level.
    """
    seen = frontier = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        found = frontier.join(link_table, "url").select(F.col("link").alias("url")).distinct().filter(keep(F.col("url")))
        frontier = checkpoint(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


class _Page(HTMLParser):
    """Text of the main container, headings marked, tables in Markdown, noise left out."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.in_title, self.noise, self.heading, self.tables = None, False, [], None, 0
        self.parts: dict[str, list[str]] = {"all": []}
        self.open: list[str] = []
        self.rows: list[list[list[list[str]]]] = []

    def _put(self, text: str) -> None:
        self.parts["all"].append(text)
        for name in ("main", "article", "body"):
            if name in self.open:
                self.parts.setdefault(name, []).append(text)

    def handle_starttag(self, tag, attrs):
        if tag in fixed.NOISE_TAGS:
            self.noise.append(tag)
        if self.noise or tag in self.VOID:
            return
        if tag == "title":
            self.in_title = True
        elif tag in ("main", "article", "body"):
            self.open.append(tag)
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.rows[-1][-1].append([])
        elif re.fullmatch("h[1-6]", tag) and not self.rows:
            self.heading = (tag[1], [])

    def handle_endtag(self, tag):
        if tag in self.noise:
            del self.noise[len(self.noise) - 1 - self.noise[::-1].index(tag) :]
            return
        if self.noise:
            return
        if tag == "title":
            self.in_title = False
        elif tag in self.open:
            self.open.remove(tag)
        elif tag == "table" and self.rows:
            md = markdown([[" ".join("".join(c).split()) for c in r] for r in self.rows.pop()])
            if md:
                self.tables += 1
                self._put(f"\n\n{md}\n\n")
        elif self.heading and tag == f"h{self.heading[0]}":
            level, words = self.heading
            self.heading = None
            text = " ".join(x.strip() for x in words if x.strip())
            self._put(f"\n§H{level}§ {text}\n" if text else "\n")

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.noise:
            return
        elif self.rows:
            if self.rows[-1] and self.rows[-1][-1]:
                self.rows[-1][-1][-1].append(data)
        elif self.heading:
            self.heading[1].append(data)
        else:
            self._put(data)


def markdown(rows: list[list[str]]) -> str:
    rows = [r for r in rows if any(c for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def parse_html(page: str) -> tuple[str | None, str, int]:
    """title, text and number of tables."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    parts = next((parser.parts[c] for c in ("main", "article", "body", "all") if parser.parts.get(c)), [])
    out: list[str] = []
    for line in "\n".join(parts).split("\n"):
        line = line.rstrip()
        if not (line.strip() and out and line.strip() == out[-1].strip()):
            out.append(line)
    return (parser.title.strip() if parser.title else None), "\n".join(out), parser.tables


def parsed(pages: DataFrame) -> DataFrame:
    """Url, source_type, title, text, n_tables of pages (url, html)."""

    def run(batches):
        for x in batches:
            found = [parse_html(h) for h in x.html]
            yield pd.DataFrame({"url": x.url, "source_type": "html", "title": [f[0] for f in found], "text": [f[1] for f in found], "n_tables": [f[2] for f in found]})

    return pages.select("url", "html").mapInPandas(run, "url string, source_type string, title string, text string, n_tables int")


def plain_text(page: Column) -> Column:
    """A8 with built-in functions only: the article's paragraphs and headings without tags, one a line."""
    body = F.regexp_replace(page, r"(?is)<(nav|footer|header|aside|script|style|noscript|form|button|svg)\b.*?</\1>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)<head\b.*?</head>", " "), r"(?i)</?(p|h[1-6]|br|div|li|tr|article)\b[^>]*>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", ""), r"[ \t]*\n\s*", "\n")
    return stripped(body)


def text_title(text: Column) -> Column:
    """The first line that isn't blank."""
    return F.get(F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda x: F.length(x) > 0), F.lit(0))
