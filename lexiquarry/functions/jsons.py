"""JSON as columns: canonical texts and hashes, and the length of a value as it is sent."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        parts = [_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        # An array of entries is ordered by key; values take no part, as keys differ.
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def _plain_hex(text: Column) -> Column:
    """Escapes of control characters with small letters; nearly no text has one."""
    changed = text
    for code in ("0B", "0E", "0F", *(f"1{x}" for x in "ABCDEF")):
        changed = F.regexp_replace(changed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), changed).otherwise(text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON of a struct, array or map with sorted keys, no blanks, nulls kept and letters of all scripts as they are."""
    return _plain_hex(F.to_json(_sorted(value, kind), {"ignoreNullFields": "false"}))


def canonical_text(text: Column) -> Column:
    """A JSON text in the same form, whatever its fields; null where it is not JSON. Fractions are written as numbers, so 2.50 is 2.5."""
    return _plain_hex(F.to_json(F.try_parse_json(text)))


def canonical_hash(value: Column, kind: T.DataType) -> Column:
    own = canonical_text(value) if isinstance(kind, T.StringType) else canonical(value, kind)
    return F.sha2(own, 256)


def length(value: Column, kind: T.DataType) -> Column:
    """Characters of a value as JSON with ``", "`` and ``": "``, letters of all scripts as they are; null counts as ``null``.

    A closed form of lengths; only texts are written as JSON, one by one, as their characters may be escaped.
    """
    size: Column
    if isinstance(kind, T.StringType):
        size = F.when(value.isNotNull(), F.length(F.to_json(F.struct(value.alias("a")))) - len('{"a":}'))
    elif isinstance(kind, T.BooleanType):
        size = F.when(value, 4).when(~value, 5)
    elif isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + length(x, kind.elementType))
        size = each + 2 + 2 * F.greatest(F.size(value) - 1, F.lit(0))
    elif isinstance(kind, T.MapType):
        pair = lambda e: length(e["key"].cast("string"), T.StringType()) + 2 + length(e["value"], kind.valueType)
        each = F.aggregate(F.map_entries(value), F.lit(0).cast("long"), lambda n, e: n + pair(e))
        size = each + 2 + 2 * F.greatest(F.size(value) - 1, F.lit(0))
    elif isinstance(kind, T.StructType):
        fixed = 2 + sum(len(json.dumps(f.name, ensure_ascii=False)) + 2 for f in kind.fields) + 2 * max(len(kind.fields) - 1, 0)
        each = sum((length(value[f.name], f.dataType) for f in kind.fields), F.lit(fixed))
        size = F.when(value.isNotNull(), each)
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        size = F.length(value.cast("string")) + 2
    else:
        size = F.length(value.cast("string"))
    return F.coalesce(size.cast("long"), F.lit(4).cast("long"))
