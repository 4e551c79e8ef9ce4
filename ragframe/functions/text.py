"""Text functions as columns: built-in expressions only, but for Unicode normal forms (survey H1-H19)."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

def java(pattern: str, flags: str = "iu") -> str:
    """A pattern written for Python's re in Java's syntax: classes are Unicode's, case as the flags say."""
    return f"(?U{flags})" + pattern.replace("[^\\S\\n]", "[\\s&&[^\\n]]")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """H1: canonical composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Characters that NFC neither changes nor joins with what stands before or after: Latin letters, most punctuation, currencies.
COMPOSED = ((0x00, 0x2FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))


def normalised(text: Column) -> Column:
    """NFC; texts of COMPOSED characters only don't leave the JVM. Python evaluates all rows of a batch, so it gets null for them."""
    composed = text.rlike("^[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in COMPOSED) + "]*$")
    return F.when(composed, text).otherwise(nfc(F.when(~composed, text)))


def collapse_spaces(text: Column) -> Column:
    """H2: one space for horizontal white space, at most one blank line, no outer white space."""
    text = F.regexp_replace(text, java("[^\\S\\n]+", ""), " ")
    return stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))


#: The characters of Unicode's property White_Space.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end; trimming takes linear time where an expression tries every inner run."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def without_marks(text: str) -> str:
    """H3 in Python: compatibility decomposition without combining characters."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else without_marks(t))


@functools.cache
def _stripping() -> tuple[str, str, str]:
    """Characters that stripping changes: those that become one character and what they become, with the marks that
    go at the end of the former; and a pattern of those that become several."""
    changed = {c: out for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x110000))) if (out := without_marks(c)) != c}
    single, gone = [c for c in changed if len(changed[c]) == 1], [c for c in changed if not changed[c]]
    runs: list[list[int]] = []
    for c in (ord(c) for c in changed if len(changed[c]) > 1):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(single + gone), "".join(changed[c] for c in single), r"(?=[^\x00-\x7F])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def strip_accents(text: Column) -> Column:
    """H3; only texts with characters that become several leave the JVM."""
    marked, plain, several = _stripping()
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).when(text.rlike(several), nfkd(F.when(text.rlike(several), text))).otherwise(F.translate(text, marked, plain))


def bm25_tokens(text: Column) -> Column:
    """H4: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.BM25_TOKEN), F.lit(0))


def salient_tokens(text: Column) -> Column:
    """H5: distinct tokens without marks, citation markers, minutes of times and stop words."""
    plain = strip_accents(F.lower(text))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[\d+\]", " "), r"(\d{1,2}):\d{2}", "$1")
    # of three characters at least, or digits only; the difference of arrays keeps distinct tokens, in order
    tokens = F.regexp_extract_all(plain, F.lit("[a-z0-9]{3,}|(?<![a-z0-9])[0-9]{1,2}(?![a-z0-9])"), F.lit(0))
    return F.array_except(tokens, F.array(*map(F.lit, fixed.STOPWORDS)))


def sentences(text: Column) -> Column:
    """H6: cut after . ! ? and white space; no blank ones."""
    return F.filter(F.split(stripped(text), r"(?U)(?<=[.!?])\s+"), lambda s: F.length(stripped(s)) > 0)


def token_length(text: Column) -> Column:
    """H7: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / fixed.CHARS_PER_TOKEN).cast("int"))


def markdown_lists(text: Column) -> Column:
    """H8: inline bullets become list items, empty ones go."""
    out = F.regexp_replace(text, r"[ \t]*[*+•]\s+", "\n- ")
    out = F.regexp_replace(out, r"([.:)])\s+-\s+(?=[0-9A-Za-zÁÉÍÓÚÑáéíóú])", "$1\n- ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*[-*+•][ \t]*$\n?", "")
    return stripped(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def matches(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns is found; null counts as no match."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text.rlike(java(p)), F.lit(False))
    return out


def is_abstention(text: Column) -> Column:
    """The answer begins by saying that there is no information."""
    return matches(text, fixed.ABSTENTION_START)


def is_no_info(text: Column) -> Column:
    return matches(text, fixed.NO_INFO)


def is_decline(text: Column) -> Column:
    return matches(text, fixed.DECLINE)


def is_meta(text: Column) -> Column:
    return matches(text, fixed.META)


def sanitise_history(text: Column) -> Column:
    """An assistant's answer without sources, markers and closing phrases."""
    out = F.regexp_replace(F.split_part(text, F.lit("\n---"), F.lit(1)), r"\[\d+\]", "")
    for closing in fixed.CLOSINGS:
        out = F.replace(out, F.lit(closing), F.lit(""))
    return stripped(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+([.,;:])", "$1"), "[ \t]{2,}", " "))


def markers(text: Column) -> Column:
    """The distinct citation markers, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))))


def without_markers(text: Column, invalid: Column) -> Column:
    """Without the invalid markers and the malformed ones."""
    out = F.aggregate(invalid, text, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m.cast("string"), F.lit("]")), F.lit("")))
    out = F.regexp_replace(out, r"\[(?!\d+\])\d[\d.,\-\s]*\]", "")
    return stripped(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+([.,;:])", "$1"), "  +", " "))


def sources_block(sources: Column) -> Column:
    """Sources: array<struct<marker, title, url>> (marker: null or a number)."""
    line = lambda s: F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("["), s.marker.cast("string"), F.lit("] ")), F.lit("")), s.title, F.lit(" — ["), s.url, F.lit("]("), s.url, F.lit(")"))
    return F.when(F.size(sources) > 0, F.concat(F.lit("\n---\n**Fuentes:**\n"), F.array_join(F.transform(sources, line), "\n"))).otherwise(F.lit(""))


def sanitise_context(text: Column) -> Column:
    """One line without wrapping quotes."""
    return F.regexp_replace(stripped(F.regexp_replace(text, r"(?U)\s+", " ")), "^[\"'«»]+|[\"'«»]+$", "")


def with_context(context: Column, text: Column) -> Column:
    """A context sentence before a chunk's text."""
    return F.when(F.length(context) > 0, F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def preview(text: Column, n: int) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, n)


def chunk_id(url: Column, position: Column) -> Column:
    """16 hex digits of the SHA-256 of url and position."""
    return F.substring(F.sha2(F.concat(url, F.lit(":::"), position.cast("string")).cast("binary"), 256), 1, 16)


def content_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def query_id() -> Column:
    """Twelve hex digits of a random identifier."""
    return F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    """H42: "NN%", half to even, "-" without a whole."""
    return F.when(whole == 0, F.lit("-")).otherwise(F.concat(F.bround(F.lit(100.0) * part / whole, 0).cast("int").cast("string"), F.lit("%")))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def keyed_lines(text: Column, f) -> Column:
    """f of struct<lines, keys>: the lines of a text, and without white space at their ends."""
    return let(F.split(text, "\n", -1), lambda lines: let(F.struct(lines.alias("lines"), F.transform(lines, stripped).alias("keys")), f))


def repeats_before(x: Column, i: Column) -> Column:
    """Whether line i of `keyed_lines` is that before it again; blank lines never are."""
    return (i > 0) & (F.get(x.keys, i) == F.get(x.keys, i - 1)) & (F.length(F.get(x.keys, i)) > 0)


def collapse_repeats(text: Column, keep_tables: bool = True) -> Column:
    """Consecutive equal lines, but for white space at their ends, become one; blank lines stay.

    keep_tables: lines that begin with "|" stay too and nothing is trimmed (the cleaner's version);
    otherwise lines lose trailing white space (the parser's).
    """
    if keep_tables:
        return keyed_lines(text, lambda x: F.array_join(F.filter(x.lines, lambda line, i: ~(repeats_before(x, i) & ~F.startswith(F.get(x.keys, i), F.lit("|")))), "\n"))
    return keyed_lines(text, lambda x: F.array_join(F.transform(F.filter(x.lines, lambda line, i: ~repeats_before(x, i)), lambda line: F.rtrim(line, F.lit(WHITE_SPACE))), "\n"))


def without_boilerplate(text: Column) -> Column:
    """Without the lines that hold a boilerplate phrase."""
    bad = lambda line: matches(line, *fixed.BOILERPLATE) | line.rlike(java(fixed.BOILERPLATE_AT_START, ""))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~bad(line)), "\n")


def cleaned(docs: DataFrame, column: str = "text") -> DataFrame:
    """K1: docs with the column through the whole cleaning chain; the normal form is a projection of its own."""
    docs = docs.withColumn(column, normalised(F.col(column)))
    return docs.withColumn(column, collapse_spaces(collapse_repeats(without_boilerplate(F.col(column)))))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: blank rows go, short ones are padded, the first is the head."""
    rows = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))), lambda r: F.exists(r, lambda c: F.length(c) > 0))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise(F.lit(""))


def _trimmed(text: str) -> str:
    if re.match(fixed.ABSTENTION_START, text, re.I):
        return fixed.ABSTENTION
    lines = text.split("\n")

    def dull(line: str, patterns: tuple) -> bool:
        line = line.strip()
        return not line or any(re.match(p, line, re.I) for p in patterns)

    while lines and dull(lines[0], fixed.PREAMBLE):
        lines.pop(0)
    while lines and dull(lines[-1], fixed.TRAILING):
        lines.pop()
    if not (body := "\n".join(lines).strip()):
        return text.strip()
    for pattern in (fixed.LEADING_HEDGE, fixed.LEADING_META):
        rest = re.sub(pattern, "", body, count=1, flags=re.I)
        if rest and rest != body:
            address = pattern == fixed.LEADING_META and (not rest[0].isalpha() or "://" in rest.split(maxsplit=1)[0])
            body = rest if address else rest[0].upper() + rest[1:]
    return body


@F.pandas_udf(StringType())
def clean_answer(text: pd.Series) -> pd.Series:
    """H9: an answer without reasoning before it and phrases after it; abstentions become the fixed phrase.

    Each step works on the last one's result, which as nested expressions would be computed over and over.
    """
    return text.map(lambda t: None if t is None else _trimmed(t))
