"""Metadata without columns of its own, as VARIANT: written, read and filtered by path (survey B27)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = "map<string,variant>"


def spread(metadata: Column, base: Iterable[str]) -> Column:
    """A JSON object's fields as VARIANT, without those that base columns already hold.

    What is null, no object or no valid JSON (a key that stands twice isn't either) becomes an object without fields.
    """
    own = [F.lit(name) for name in base]
    fields = F.when(F.try_parse_json(metadata).isNotNull(), F.from_json(metadata, _FIELDS))
    fields = F.coalesce(fields, F.from_json(F.lit("{}"), _FIELDS))
    return F.to_variant_object(F.map_filter(fields, lambda k, _: ~F.array_contains(F.array(*own), k)) if own else fields)


def with_extras(rows: DataFrame, metadata: str, extras: str = "extras") -> DataFrame:
    """rows with the JSON column `metadata` replaced by the VARIANT `extras`, which overrides no other column."""
    return rows.withColumn(extras, spread(F.col(metadata), [c for c in rows.columns if c != metadata])).drop(*{metadata} - {extras})


def field(extras: Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b[0]; null where there is none or it isn't of that type."""
    return F.try_variant_get(extras, path, kind)
