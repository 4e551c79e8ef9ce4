"""Query understanding by rules (survey H18, H19, H24, H25, H28-H31)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .records import found
from .text import java, matches, strip_accents, stripped

_FOLD = str.maketrans("áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")
_NAMES = {name.lower().translate(_FOLD): sigla for sigla, name in fixed.SUBJECTS.items()}
_ANY_NAME = r"\b(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\b"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def subjects(text: Column) -> Column:
    """The subjects named: by their upper-case short form first, then by full name; each once."""
    known = F.array(*map(F.lit, fixed.SUBJECTS))
    short = F.filter(F.regexp_extract_all(text, F.lit(java(fixed.SIGLA, "")), F.lit(1)), lambda t: F.array_contains(known, t))
    full = F.transform(F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(java(_ANY_NAME, "")), F.lit(1)), lambda n: F.element_at(_map(_NAMES), n))
    return F.array_distinct(F.concat(short, full))


def expanded(query: Column) -> Column:
    """Each known short form gets its name, each full name its short form at the end."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: F.length(w) > 0)
    bare = lambda w: F.regexp_replace(w, r"[?.,;:!]+$", "")
    names = _map(fixed.SUBJECTS)
    known = lambda w: (F.length(bare(w)) >= 2) & F.map_contains_key(names, bare(w))
    full = F.array_join(F.transform(words, lambda w: F.when(known(w), F.concat(bare(w), F.lit(" ("), F.element_at(names, bare(w)), F.lit(")"), w.substr(F.length(bare(w)) + 1, F.length(w)))).otherwise(w)), " ")
    present = F.array_distinct(F.transform(F.filter(words, known), bare))
    return F.concat(full, F.array_join(F.transform(F.array_except(subjects(full), present), lambda s: F.concat(F.lit(" ("), s, F.lit(")"))), ""))


def routes(query: Column) -> Column:
    """struct<categories map<string,double>, rules array<string>>; a category's boost is the largest of its rules."""
    fired = {name: F.coalesce(query.rlike(java(pattern)), F.lit(False)) for name, pattern, _ in fixed.ROUTES}
    rules = F.filter(F.array(*[F.when(fired[name], F.lit(name)) for name, *_ in fixed.ROUTES]), lambda x: x.isNotNull())
    categories = list(dict.fromkeys(c for *_, boosts in fixed.ROUTES for c in boosts))
    best = [F.array_max(F.array(*[F.when(fired[name], F.lit(float(boosts[c]))) for name, _, boosts in fixed.ROUTES if c in boosts])) for c in categories]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), b.alias("value")) for c, b in zip(categories, best, strict=True)]), lambda e: e.value.isNotNull())
    return F.struct(F.map_from_entries(entries).alias("categories"), rules.alias("rules"))


def is_listing(query: Column) -> Column:
    return matches(query, *fixed.LISTING)


def wanted_type(query: Column) -> Column:
    """H30: "horario" or "calendario" where the query asks for just one of them."""
    timetable, exam = matches(query, fixed.TIMETABLE_INTENT), matches(query, fixed.EXAM_INTENT)
    return F.when(timetable & ~exam, F.lit("horario")).when(exam & ~timetable, F.lit("calendario"))


def course(query: Column) -> Column:
    """The year of study: by word first, then by digit."""
    word = F.lower(found(query, fixed.COURSE_WORD))
    return F.coalesce(F.when(word == "primer", 1).when(word == "segund", 2).when(word == "tercer", 3).when(word == "cuart", 4), found(query, fixed.COURSE_DIGIT).cast("int"))


def entities(text: Column) -> Column:
    """struct<subject, tipo, grupo, subgrupo>, null where absent."""
    group = F.coalesce(found(text, fixed.GROUP), found(text, fixed.GROUP_BARE, 1, ""))
    group = F.coalesce(F.concat(F.lit("grupo "), F.replace(group, F.lit(" "), F.lit(""))), F.concat(F.lit("grupo "), F.upper(found(text, fixed.GROUP_LETTER))))
    return F.struct(
        F.get(subjects(text), F.lit(0)).alias("subject"), F.when(matches(text, fixed.PRACTICE), F.lit("prácticas")).when(matches(text, fixed.THEORY), F.lit("teoría")).alias("tipo"),
        group.alias("grupo"), F.concat(F.lit("subgrupo "), F.upper(F.replace(found(text, fixed.SUBGROUP), F.lit(" "), F.lit("")))).alias("subgrupo"),
    )


def is_followup(query: Column, found_: Column) -> Column:
    """Begins like one, or is short and names a group or type without a subject; found_: its entities."""
    short = F.size(F.filter(F.split(stripped(query), r"(?U)\s+"), lambda w: F.length(w) > 0)) <= 6
    return matches(query, fixed.ANAPHORIC) | (short & found_.subject.isNull() & (found_.grupo.isNotNull() | found_.subgrupo.isNotNull() | found_.tipo.isNotNull()))
