"""What the operators share: marks that tell rows apart, dropping rows by mark, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.session import counts, width

#: What may be broadcast; beyond either bound a shuffled join does the same.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

#: Columns of a row's mark: its id (that of a null id is NO_ID) and a hash of all its columns.
MARK = ["_mark_id", "_mark_row"]
NO_ID = -(2**63)


def fits(df: DataFrame, most: int = BROADCAST_ROWS, of: DataFrame | None = None) -> bool:
    """Whether `df` has at most `most` rows and BROADCAST_BYTES.

    `of`: a written table that has as many rows and as much in them, or more, whose counts then tell; else those of `df`
    if it is a written table; else they are counted now.
    """
    known = counts(of if of is not None else df)
    if known is not None:
        return known.rows <= most and known.bytes <= BROADCAST_BYTES
    rows, size = df.limit(most + 1).select(width(df).alias("_size")).agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return rows <= most and size <= BROADCAST_BYTES


def small(df: DataFrame, most: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """`df`, marked for broadcast only if it `fits`, else for a merge join, whose hot keys Spark splits."""
    return F.broadcast(df) if fits(df, most, of) else df.hint("merge")


def empty(df: DataFrame) -> bool:
    known = counts(df)
    return df.isEmpty() if known is None else known.rows == 0


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mark(docs: DataFrame, key: str = "doc_id") -> list[Column]:
    """The columns MARK. Rows with equal marks are equal in all columns (maps aside), so any one may stand for them."""
    every = [F.col(quoted(f.name)) for f in docs.schema.fields if _hashable(f.dataType)]
    return [F.coalesce(F.col(quoted(key)).cast("long"), F.lit(NO_ID)).alias(MARK[0]), F.xxhash64(*every).alias(MARK[1])]


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", twins: DataFrame | None = None) -> DataFrame:
    """`docs` without the rows marked in `dropped` (a written table), and with one row only of each mark in `twins`.

    Rows go one by one, whatever others share their id.
    """
    left = docs.select("*", *mark(docs, key)).join(small(dropped.select(*MARK), of=dropped), MARK, "left_anti")
    if twins is not None and not empty(twins):
        some = small(twins.select(*MARK), of=twins)
        left = left.join(some, MARK, "left_anti").unionByName(left.join(some, MARK, "left_semi").dropDuplicates(MARK))
    return left.drop(*MARK)
