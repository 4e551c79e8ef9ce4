"""Corpus operators: filters, reject reasons, deduplication, curation, summaries (survey 2.B, 2.C, 2.D).

The corpus is a DataFrame with url, title, category, source_type, text and char_count; where a table has
other names, the operators take the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import fixed
from ragframe.functions.text import content_hash, java, keyed_lines, matches, repeats_before, stripped


def is_form(text: Column) -> Column:
    """Two or more marks of a form in the first 500 characters."""
    return F.size(F.regexp_extract_all(F.substring(text, 1, 500), F.lit(java(fixed.FORM_INDICATORS, "ium")), F.lit(0))) >= 2


def is_index_page(text: Column, source_type: Column) -> Column:
    """An HTML page that is short, or rather short with mostly short lines."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda x: F.length(x) > 0)
    brief = F.size(F.filter(lines, lambda x: F.length(x) < 60))
    menu = (F.size(lines) == 0) | ((F.size(lines) > 3) & (brief / F.greatest(F.size(lines), F.lit(1)) > 0.7))
    return (source_type == "html") & ((F.length(text) < 600) | ((F.length(text) < 1500) & menu))


def reject_reason(text: Column, source_type: Column, min_clean: int = fixed.CLEAN_MIN_CHARS, min_chars: int = fixed.CORPUS_MIN_CHARS) -> Column:
    """Why a document isn't kept, the first reason that holds; null for one that is."""
    return F.when(text.isNull() | (F.length(text) < min_clean), "empty").when(F.length(text) < min_chars, "short").when(is_form(text), "form").when(is_index_page(text, source_type), "index")


def keep_first(docs: DataFrame, order: str, text: str = "text", keep: str = "first", url: str = "url") -> DataFrame:
    """C11: one document of each content hash: the first by `order`, or the one of the shortest url.

    The hash's smallest order is a partial aggregate and the join back splits hot hashes; documents of a
    crowded hash are never gathered in one task.
    """
    hashed = docs.withColumn("content_hash", content_hash(F.col(text)))
    rank = F.struct(order) if keep == "first" else F.struct(F.length(url).alias("n"), F.col(order))
    first = hashed.groupBy("content_hash").agg(F.min(rank).alias("__first"))
    return hashed.join(first, "content_hash").filter(rank == F.col("__first")).drop("__first")


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """The content hashes of several documents, with their number."""
    return docs.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.count("*").alias("n")).filter("n > 1")


def refine_category(url: Column, title: Column, category: Column) -> Column:
    """The category that url and title tell, in this order, else the given one."""
    url, title = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    has = lambda c, x: F.contains(c, F.lit(x))
    return (
        F.when(has(url, "horario") | has(title, "horario"), "horarios")
        .when(has(url, "plan-estudios") | has(title, "plan de estudios"), "plan_estudios")
        .when(has(url, "/secretaria") & has(url, "etsiit"), "tramites")
        .when(F.endswith(url, F.lit("/presentacion")) | F.endswith(url, F.lit("/presentacion/")) | has(title, "presentación del grado"), "presentacion_grado")
        .otherwise(category)
    )


def contains_query(query: str, *columns: Column) -> Column:
    """Whether any column contains the query, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(query))), F.lit(False))
    return out


def removal(url: Column, text: Column, *, urls=(), max_chars: int | None = None, query: str | None = None) -> Column:
    """What a removal asks for: an equal url, a text of at most max_chars, or a search that hits."""
    out = url.isin(*urls) if urls else F.lit(False)
    if max_chars is not None:
        out = out | (F.length(text) <= max_chars)
    return out | contains_query(query, url, text) if query else out


def remove(docs: DataFrame, doomed: Column, dry_run: bool = False) -> DataFrame:
    """The corpus without the doomed rows; a dry run returns those instead. A null condition dooms nothing."""
    gone = F.coalesce(doomed, F.lit(False))
    return docs.filter(gone if dry_run else ~gone)


def upsert(docs: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """New rows replace those of the same key, and are added where there is none."""
    return docs.join(new.select(key).distinct(), key, "left_anti").select(*docs.columns).unionByName(new.select(*docs.columns))


def append_absent(docs: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """New rows whose key isn't there yet are added."""
    return docs.unionByName(new.join(docs.select(key).distinct(), key, "left_anti").select(*docs.columns))


def old_exam(url: Column) -> Column:
    """A calendar or room list of an earlier year, by its decoded url."""
    plain = F.try_url_decode(url)
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(plain, n))
    return has(fixed.OLD_EXAM_NAMES) & ~has(fixed.CURRENT_YEAR_NAMES)


def is_noise(title: Column, url: Column, text: Column) -> Column:
    """A keyword of legal notices in title, url or the first 300 characters."""
    keys = F.array(*map(F.lit, fixed.NOISE_KEYWORDS))
    hit = lambda c: F.coalesce(F.exists(keys, lambda k: F.contains(F.lower(c), k)), F.lit(False))
    return hit(title) | hit(url) | hit(F.substring(text, 1, 300))


def inferred_title(url: Column) -> Column:
    """The decoded file name without extension, underscores as spaces."""
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1), r"\+", "%2B")), F.lit(""))
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return stripped(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def title(label: Column, parsed: Column, url: Column) -> Column:
    """The configured label, else a parsed title of more than one character, else one from the url."""
    return F.coalesce(label, F.when(F.length(stripped(parsed)) > 1, parsed), inferred_title(url))


def summary(docs: DataFrame, group: str, chars: Column) -> DataFrame:
    """D5 and D6 in one pass: documents, characters and their integer mean by group, and in all (group null)."""
    mean = F.floor(F.sum("__n") / F.greatest(F.count("*"), F.lit(1)))
    return docs.withColumn("__n", chars).rollup(group).agg(F.count("*").alias("docs"), F.sum("__n").alias("chars"), mean.cast("long").alias("mean_chars"), F.grouping(group).cast("int").alias("is_total"))


def missing_categories(docs: DataFrame, expected=fixed.EXPECTED_CATEGORIES, category: str = "category") -> DataFrame:
    """The expected categories that no document has."""
    wanted = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("category"))
    return wanted.join(docs.select(F.col(category).alias("category")).distinct(), "category", "left_anti")


def missing_urls(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (fragment, label) with the number of distinct urls that hold the fragment, as it is spelled there."""
    urls = docs.select("url").filter(F.col("url").isNotNull()).distinct()
    hits = urls.join(F.broadcast(expected), F.contains(urls.url, expected.fragment)).groupBy("fragment").agg(F.count("*").alias("n"))  # a list made by hand
    return expected.join(hits, "fragment", "left").select("fragment", "label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def without_index_pages(docs: DataFrame, ending: str = "/horarios") -> DataFrame:
    """Without the HTML pages whose url ends so: they only list links."""
    return docs.filter(~((F.col("source_type") == "html") & F.endswith(F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), "/+$", ""), F.lit(ending))))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Docs (url, title, ...) whose title is the label configured for their url (url, label), where there is one."""
    own = labels.filter("label is not null").groupBy("url").agg(F.min("label").alias("__label"))
    return docs.join(own, "url", "left").withColumn("title", title(F.col("__label"), F.col("title"), F.col("url"))).select(*docs.columns)


def extra_documents(docs: DataFrame, extra: DataFrame, excluded: Column) -> DataFrame:
    """Docs with the extra ones (with category and label as configured) that the global exclusions leave; no other filter applies."""
    return docs.unionByName(extra.filter(~F.coalesce(excluded, F.lit(False))).select(*docs.columns))


def extremes(docs: DataFrame, size: Column, order: str, n: int = 5, longest: bool = True) -> DataFrame:
    """F8: the n longest or shortest documents, ties to the smaller id."""
    key = F.col("__size").desc() if longest else F.col("__size").asc()
    return docs.withColumn("__size", size).orderBy(key, F.col(order)).limit(n).withColumnRenamed("__size", "size")


def line_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines, consecutive repeats and their share, over all documents."""
    repeats = keyed_lines(F.col(text), lambda x: F.size(F.filter(F.transform(x.lines, lambda line, i: repeats_before(x, i)), lambda again: again)))
    sums = docs.select(F.size(F.split(text, "\n", -1)).alias("n"), repeats.alias("r")).agg(F.sum("n").alias("lines"), F.sum("r").alias("repeats"))
    return sums.withColumn("share", F.col("repeats") / F.greatest(F.col("lines"), F.lit(1)))


def top_by_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def quality_flags(title_: Column, text: Column) -> Column:
    """struct<tiny, untitled, suspicious>."""
    return F.struct((F.length(text) < 100).alias("tiny"), (F.length(F.coalesce(stripped(title_), F.lit(""))) == 0).alias("untitled"), matches(title_, "blanco").alias("suspicious"))
