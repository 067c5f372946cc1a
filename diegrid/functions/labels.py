"""String normalisation: class labels and image source names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from diegrid.constants import EXPORT_SUFFIX, LABEL_ALIASES


def canonical_label(name: Column, strict: bool = False) -> Column:
    """Canonical class, or NULL for an unknown label; `strict` makes unknown labels an error."""
    key = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))
    table = F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])
    found = F.try_element_at(table, key)
    if strict:
        return F.when(name.isNull() | found.isNotNull(), found).otherwise(
            F.raise_error(F.concat(F.lit("unknown wafer class label: "), name)))
    return found


def nested_label(a: Column) -> Column:
    """First element of a nested label array, NULL when there is none."""
    return F.get(F.flatten(a), F.lit(0))


def source_id(file_name: Column) -> Column:
    """Name of the source image: the export suffix removed, else the extension removed."""
    stem = F.regexp_replace(file_name, EXPORT_SUFFIX, "")
    return F.when(stem != file_name, stem).otherwise(F.regexp_replace(file_name, r"^(.+)\.[^.]*$", "$1"))
