"""Tables whose columns came one after the other: batches of different schemas read as one.

A table is declared as its columns with types and defaults, in the order in which they were
added. A batch that was written before a column was gets the column's default, one that was
written with a narrower type is widened, one with a type that cannot be widened is an error
before anything is read. Batches are grouped by their schemas, so a plan grows with the
number of schemas and not with that of batches.

Defined results: a null that was written stays null; columns that are not declared are left
out; names are compared without case; a column without a default is null in older batches;
the order of batches does not matter; no batches are an empty table.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a type may be widened to, without loss.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "bigint": (), "float": ("double",), "date": ("timestamp",), "timestamp_ntz": ("timestamp",), "boolean": (),
}


@dataclass(frozen=True)
class Added:
    """A column with its type as SQL names it, the default for older batches, and the version of the rules that added it."""

    name: str
    kind: str
    default: object = None
    version: int = 1


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type is one of the new."""
    if old == new:
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if isinstance(new, T.DecimalType) and old.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return new.precision - new.scale >= {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}[old.simpleString()]
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return widens(old.elementType, new.elementType)
    return new.simpleString() in WIDER.get(old.simpleString(), ())


def evolved(batch: DataFrame, columns: list[Added], version: str = "schema_version") -> DataFrame:
    """A batch in the declared schema, with the version of the rules that its own columns meet: that of the last one it has."""
    own = {f.name.lower(): f for f in batch.schema.fields}
    picked, wrong = [], []
    for c in columns:
        kind = T.DataType.fromDDL(c.kind)
        if (field := own.get(c.name.lower())) is None:
            value = F.lit(c.default)
        elif widens(field.dataType, kind):
            value = F.col(f"`{field.name}`")
        else:
            wrong.append(f"{c.name}: {field.dataType.simpleString()} does not widen to {kind.simpleString()}")
            continue
        picked.append(value.cast(kind).alias(c.name))
    if wrong:
        raise TypeError("; ".join(wrong))
    met = max((c.version for c in columns if c.name.lower() in own), default=0)
    return batch.select(*picked, F.lit(met).alias(version))


def read_evolving(spark: SparkSession, paths: list[str], columns: list[Added], version: str = "schema_version") -> DataFrame:
    """The Parquet batches at ``paths`` as one table of the declared columns; only their footers are read before the plan is made."""
    groups: dict[str, list[str]] = defaultdict(list)
    for path in paths:
        groups[spark.read.parquet(path).schema.json()].append(path)
    parts = [evolved(spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*own), columns, version) for schema, own in sorted(groups.items())]
    if not parts:
        return evolved(spark.createDataFrame([], T.StructType()), columns, version)
    return reduce(DataFrame.unionByName, parts)
