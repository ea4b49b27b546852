"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A table of at most so many counted bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Of a hashed row besides its values.
ROW_BYTES = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes_of(name: str, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(f"`{name}`"), F.lit(0)).cast("long") + 8
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.octet_length(F.to_json(F.struct(f"`{name}`"))).cast("long") + 8
    return F.lit(8).cast("long")


def broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`keys` with a broadcast hint if its rows take at most `limit` bytes, else unchanged (a shuffled join).

    The bytes are counted, so `keys` should be settled or cheap.
    """
    row = sum((_bytes_of(f.name, f.dataType) for f in keys.schema), F.lit(ROW_BYTES).cast("long"))
    return F.broadcast(keys) if (keys.agg(F.sum(row)).first()[0] or 0) <= limit else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    A column used inside a lambda is otherwise computed again for every element.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """A 128-bit key of (id, text), never null; only rows equal in both share it."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.xxhash64(F.lit(11), text, doc_id).alias("_k2")]


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """`docs` as one struct column `_row`, which no other name can clash with, and the given columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def tie_order(docs: DataFrame, *left_out: str) -> Column:
    """Text of all columns of `_row` but the given ones, to choose among rows that are else alike."""
    return F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"_row.`{c}`") for c in docs.columns if c not in left_out]))
