"""Types of array cells: promotion as numpy does it, and the Spark types that hold them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128")

SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
}


def promoted(dtypes: Iterable[str]) -> str:
    """The common type. Promotion depends on the order, so the distinct names are taken sorted."""
    names = sorted(set(dtypes))
    if len(names) == 1:
        return names[0]
    out = np.dtype(names[0])
    for name in names[1:]:
        out = np.promote_types(out, name)
    return out.name


def promote(dtypes: Column) -> Column:
    """:func:`promoted` of an array column, by a table of the numeric types' pairs."""
    pairs = [F.lit(x) for a in NUMERIC for b in NUMERIC for x in (f"{a}|{b}", np.promote_types(a, b).name)]
    names = F.array_sort(F.array_distinct(dtypes))
    table = F.create_map(*pairs)
    return F.aggregate(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), names[0], lambda a, b: table[F.concat_ws("|", a, b)])


def spark_type(dtype: str) -> str:
    """The Spark type that holds a numpy type's cells without loss."""
    name = np.dtype(dtype).name
    if name.startswith("str") or name.startswith("bytes") or name == "object":
        return "string"
    if name.startswith(("datetime64", "timedelta64")):
        return "bigint"  # encoded numbers; units and calendar stay attributes
    if name.startswith("complex"):
        return "struct<re:double,im:double>"
    return SPARK_TYPES[name]
