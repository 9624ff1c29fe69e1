"""Messages delivered more than once: keep exactly one copy of each identifier."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _packed(first: str, tie: str) -> Column:
    """The struct (first, tie) as one fixed-width decimal of the same order, null `first` last.

    A struct is no fixed-width aggregation buffer and would make Spark sort before aggregating; a
    decimal lets min_by run as a hash aggregation, on the map side too. |first| <= 2**63 and
    0 <= tie < 2**63 fit into 38 digits; null counts as 2**63, which no long is.
    """
    two63 = F.lit(Decimal(2**63)).cast("decimal(19,0)")
    head = (F.coalesce(F.col(first).cast("decimal(19,0)"), two63) * two63).cast("decimal(38,0)")
    whole = (head + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(F.col(tie) >= 0, whole).otherwise(F.raise_error(F.lit("packed order needs ids of 0 or more: pass packed=False")).cast("decimal(38,0)"))


def _known(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose identifier is whole; plain null checks reach the Parquet scan, dropna() would not."""
    for c in key:
        df = df.where(F.col(c).isNotNull())
    return df


def kept_copies(df: DataFrame, key: list[str], first: str, tie: str, packed: bool = True) -> DataFrame:
    """One row per identifier: its columns and `kept`, the `tie` value of the copy to keep.

    Rows with a null in any identifier column identify nothing and are left out. A null `first`
    comes after all others. `tie` is unique and not null; `packed` raises unless it is >= 0, with
    packed=False any value is allowed and the aggregation sorts instead of hashing.
    """
    known = _known(df, key)
    order = _packed(first, tie) if packed else F.struct(F.col(first).isNull(), F.col(first), F.col(tie))
    return known.groupBy(*key).agg(F.min_by(tie, order).alias("kept"))


def surplus_copies(df: DataFrame, key: list[str], first: str, tie: str, packed: bool = True) -> DataFrame:
    """`tie` of each row which is a surplus copy.

    The kept ids are anti-joined by the unique `tie`, so no identifier, however hot, meets in one
    task: what its copies cost is the map-side partial aggregation.
    """
    known = _known(df, key)
    kept = kept_copies(df, key, first, tie, packed).select(F.col("kept").alias(tie))
    return known.select(tie).join(kept, tie, "left_anti")


def deduplicate(df: DataFrame, key: list[str], first: str, tie: str, packed: bool = True) -> DataFrame:
    """df without its surplus copies. Rows whose identifier holds a null are all kept.

    Extra columns, whatever their names, pass through; an empty table gives an empty one.
    """
    return df.join(surplus_copies(df, key, first, tie, packed), tie, "left_anti").select(*df.columns)
