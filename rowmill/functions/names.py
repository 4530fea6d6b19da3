"""Field names: snake_case on whole schemas, schema hash and data category."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


def snake_key(name: str) -> str:
    """``userName`` -> ``user_name``: a run of capitals starts a word, other signs become one underscore."""
    marked = re.sub(r"[A-Z]+", lambda m: "_" + m.group(), name).lower()
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", marked)).strip("_")


def snake_field(name: str) -> str:
    """``userID`` -> ``user_id``, ``HTTPServer`` -> ``http_server``."""
    word_start = r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])"
    return re.sub(word_start, "_", name).lower()


def _renamed(c: Column, kind: T.DataType, rename) -> Column:
    if isinstance(kind, T.StructType):
        merged: dict[str, Column] = {}
        for f in kind.fields:  # of names that collide the last wins
            merged[rename(f.name)] = _renamed(c.getField(f.name), f.dataType, rename)
        packed = F.struct(*[value.alias(name) for name, value in merged.items()])
        return F.when(c.isNotNull(), packed)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _renamed(x, kind.elementType, rename))
    return c


def normalize_names(df: DataFrame, rename=snake_key) -> DataFrame:
    """Rename every field, nested ones too; of fields that get the same name the last wins."""
    merged: dict[str, Column] = {}
    for f in df.schema.fields:
        merged[rename(f.name)] = _renamed(F.col(f"`{f.name}`"), f.dataType, rename)
    return df.select(*[value.alias(name) for name, value in merged.items()])


def schema_hash(columns: list[str]) -> str:
    """First 12 characters of the md5 of the sorted, comma-joined names; '' when there are none."""
    return hashlib.md5(",".join(sorted(columns)).encode()).hexdigest()[:12] if columns else ""


def data_category(schema: T.StructType) -> str:
    """``complex`` if a field is a record or a list of records, else ``flatten``."""
    for f in schema.fields:
        kind = f.dataType
        if isinstance(kind, (T.StructType, T.MapType)):
            return "complex"
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
            return "complex"
    return "flatten"
