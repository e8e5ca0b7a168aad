"""Canonical JSON and content keys: object keys in order, no blanks, so equal values have equal texts and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_key_order(c: Column, t: T.DataType) -> Column:
    """The same value with the fields of all its structs in alphabetical order."""
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[in_key_order(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: in_key_order(x, t.elementType))
    return c


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """JSON of a struct column, or of several columns as one object. Nulls are written; numbers as Spark writes them."""
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.StructType):
        whole = in_key_order(F.col(columns[0]), df.schema[columns[0]].dataType)
    else:
        whole = F.struct(*[in_key_order(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)])
    return F.to_json(whole, {"ignoreNullFields": "false"})


def content_key(df: DataFrame, *columns: str) -> Column:
    """sha256 of the canonical JSON."""
    return F.sha2(canonical_json(df, *columns), 256)


def short(digest: Column, n: int = 12) -> Column:
    return F.substring(digest, 1, n)


def case_id_for(df: DataFrame, dataset: str, *columns: str) -> Column:
    """An id that follows from what determines a case (seed, window, parameters), before it is cut."""
    return F.concat(F.lit(f"{dataset}-"), short(content_key(df, *columns), 16))


def leaf_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, populated: every leaf of a struct column by its dotted path."""

    def leaves(t: T.DataType, path: str) -> list[str]:
        if not isinstance(t, T.StructType):
            return [path]
        return [x for f in t.fields for x in leaves(f.dataType, f"{path}.{f.name}")]

    paths = leaves(df.schema[column].dataType, column)
    rows = F.array(*[F.struct(F.lit(p.removeprefix(f"{column}.")).alias("path"), F.col(p).isNotNull().alias("populated")) for p in paths])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.path", "x.populated")


def greater(a: Column, b: Column) -> Column:
    """Whether both tagged facts are there and the first is the larger; never null."""
    return F.coalesce(a["available"] & b["available"] & (a["value"] > b["value"]), F.lit(False))


def equals(a: Column, value) -> Column:
    """Whether a tagged fact is there and has the value; never null."""
    return F.coalesce(a["available"] & (a["value"] == F.lit(value)), F.lit(False))
