"""Null-honest reading: blank is absent, nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_honest(c: Column, kind: str = "string") -> Column:
    """Blank text, non-finite numbers, empty arrays and empty maps become NULL."""
    if kind == "string":
        return F.nullif(F.trim(F.regexp_replace(c.cast("string"), "^\\s+|\\s+$", "")), F.lit(""))
    if kind == "double":
        number = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if kind == "array":
        kept = F.filter(F.transform(c, lambda x: null_honest(x)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if kind == "map":
        kept = F.map_filter(F.transform_values(c, lambda k, v: null_honest(v)), lambda k, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    raise ValueError(f"unknown kind {kind!r}")


def flatten_map(c: Column, levels: int = 2) -> Column:
    """A map whose values may be JSON objects, flattened to dotted keys; blanks dropped, empty is NULL."""
    nested_type = T.MapType(T.StringType(), T.StringType())

    def open_nested(entry: Column) -> Column:
        inner = F.map_entries(F.from_json(entry["value"], nested_type))
        opened = F.transform(
            inner,
            lambda n: F.struct(F.concat(entry["key"], F.lit("."), n["key"]).alias("key"), n["value"].alias("value")),
        )
        whole = F.array(F.struct(entry["key"].alias("key"), entry["value"].alias("value")))
        is_object = F.coalesce(F.trim(entry["value"]).startswith("{"), F.lit(False))
        return F.when(is_object & opened.isNotNull(), opened).otherwise(whole)

    entries = F.map_entries(c)
    for _ in range(levels):
        entries = F.flatten(F.transform(entries, open_nested))
    return null_honest(F.map_from_entries(entries), "map")


def rename_fields(df: DataFrame, names: dict[str, str], map_cols: tuple[str, ...] = (),
                  array_cols: tuple[str, ...] = ()) -> DataFrame:
    """Rename columns, and the same names inside map keys and array entries; unknown names pass through."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    swap = lambda name: F.coalesce(F.try_element_at(table, name), name)
    changes = {c: F.transform_keys(F.col(c), lambda k, v: swap(k)) for c in map_cols}
    changes.update({c: F.transform(F.col(c), swap) for c in array_cols})
    return df.withColumns(changes).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
