"""Fetching, parsing by kind and ingesting single pages (survey A1, A7, A10, A12, A20, A33).

The network and PDF libraries are callables that the caller passes in: a client takes (url, timeout) and
returns (status, content type, content); a parser takes (url, content) and returns (title, text).
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions import fixed
from ragframe.functions.text import cleaned
from ragframe.operators import corpus

from . import web

Client = Callable[[str, float], tuple[int, str, bytes]]
Parser = Callable[[str, bytes], tuple[str | None, str]]
RAW = "url string, status string, http_status int, content_type string, source_type string, content binary, attempts int"


def fetch(urls: DataFrame, client: Client, retries: int = 3, timeout: float = 30.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """A1: url, status (ok or failed), http_status, content_type, source_type, content, attempts of every url.

    A failing request is tried again after 1, 2, 4, ... seconds; what fails every time is a row with status
    failed, not an error of the job.  urls are fetched where they lie: repartition them by host for politeness.
    """

    def one(url: str) -> tuple:
        for attempt in range(1, retries + 1):
            try:
                code, kind, content = client(url, timeout)
                if code < 400:
                    return url, "ok", code, kind, content, attempt
            except Exception:  # noqa: BLE001  what a foreign client raises can't be known
                code = None
            if attempt < retries:
                wait(2.0 ** (attempt - 1))
        return url, "failed", code, None, None, retries

    def run(batches):
        for x in batches:
            yield pd.DataFrame([one(u) for u in x.url], columns=["url", "status", "http_status", "content_type", "content", "attempts"]).astype({"http_status": "Int32", "attempts": "int32"})

    raw = urls.select("url").mapInPandas(run, "url string, status string, http_status int, content_type string, content binary, attempts int")
    kind = F.when(F.col("status") == "ok", web.source_type(F.coalesce("content_type", F.lit("")), F.col("url")))
    return raw.select("url", "status", "http_status", "content_type", kind.alias("source_type"), "content", "attempts")


def _html(url: str, content: bytes) -> tuple[str | None, str]:
    title, text, _ = web.parse_html(content.decode("utf-8", "replace"))
    return title, text


def _plain(url: str, content: bytes) -> tuple[str | None, str]:
    text = content.decode("utf-8", "replace")
    return next((line.strip() for line in text.split("\n") if line.strip()), None), text


#: Parsers by source type; a PDF parser is added where there is a library for it.
PARSERS: dict[str, Parser] = {"html": _html, "txt": _plain}


def parse(raw: DataFrame, parsers: dict[str, Parser] | None = None, schedule: Parser | None = None) -> DataFrame:
    """Url, source_type, title, text, error of fetched pages (url, source_type, content).

    A url that says "horario" goes to `schedule` first, and to its type's parser where that finds nothing.
    A type without a parser and a parser that fails give a row with the reason and an empty text.
    """
    known = {**PARSERS, **(parsers or {})}

    def one(url: str, kind: str | None, content: bytes | None) -> tuple:
        if content is None or kind not in known:
            return None, "", "nothing fetched" if content is None else f"no parser for {kind}"
        try:
            title, text = schedule(url, bytes(content)) if schedule and "horario" in url.lower() else (None, "")
            if not text:
                title, text = known[kind](url, bytes(content))
            return title, text, None
        except Exception as e:  # noqa: BLE001  what a foreign parser raises can't be known
            return None, "", type(e).__name__

    def run(batches):
        for x in batches:
            found = [one(u or "", k, c) for u, k, c in zip(x.url, x.source_type, x.content, strict=True)]
            yield pd.DataFrame({"url": x.url, "source_type": x.source_type, "title": [f[0] for f in found], "text": [f[1] for f in found], "error": [f[2] for f in found]})

    return raw.select("url", "source_type", "content").mapInPandas(run, "url string, source_type string, title string, text string, error string")


def ingest(urls: DataFrame, client: Client, category: str = "general", parsers: dict[str, Parser] | None = None, least: int = fixed.CLEAN_MIN_CHARS, **options) -> DataFrame:
    """Url, title, category, source_type, text of the urls: fetched, parsed, cleaned, and of `least` characters or more."""
    docs = cleaned(parse(fetch(urls, client, **options).filter("status = 'ok'"), parsers))
    own = corpus.title(F.lit(None).cast("string"), F.col("title"), F.col("url"))
    return docs.filter(F.length("text") >= least).select("url", own.alias("title"), F.lit(category).alias("category"), "source_type", "text")
