"""Which partition a keyed record belongs to, by hashes that do not change between systems or runs.

Spark's own hash partitioning is not compatible with these; the mapping is a column, after which
one may repartition by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of 32-bit FNV-1a.
OFFSET, PRIME = 2166136261, 16777619


def fnv1a_python(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h


def fnv1a(key: Column | str) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes, or of a binary, as a long."""
    k = F.col(key) if isinstance(key, str) else key
    one_byte = F.decode(k.cast("binary"), "ISO-8859-1")  # one character a byte
    chars = F.when(F.length(one_byte) == 0, F.array().cast("array<string>")).otherwise(F.split(one_byte, ""))
    return F.aggregate(chars, F.lit(OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def _some(partitions: Sequence[str]) -> list[str]:
    if not partitions:
        raise ValueError("no partitions to map to")
    return list(partitions)


def modulo(key: Column | str, partitions: Sequence[str]) -> Column:
    """Partition at FNV-1a(key) mod n, in the listed order."""
    names = _some(partitions)
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(fnv1a(key), F.lit(len(names))) + 1).cast("int"))


def rendezvous(key: Column | str, partitions: Sequence[str]) -> Column:
    """Partition with the highest FNV-1a(key) xor FNV-1a(name); the first of equal ones. Stable as partitions are added."""
    names = _some(partitions)
    listed = F.array(*[F.struct(F.lit(fnv1a_python(n.encode())).cast("long").alias("h"), F.lit(-i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    # The key's hash is bound to a lambda's variable, so that it is computed once and not per partition.
    best = F.transform(F.array(fnv1a(key)), lambda h: F.array_max(F.transform(listed, lambda p: F.struct(h.bitwiseXOR(p["h"]).alias("score"), p["at"].alias("at"), p["name"].alias("name")))))
    return F.element_at(best, 1)["name"]


def random(partitions: Sequence[str], seed: int | None = None) -> Column:
    names = _some(partitions)
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(F.rand(seed) * len(names)) + 1).cast("int"))


def constant(partition: str) -> Column:
    return F.lit(partition)


def direct(df: DataFrame, column: str, partitions: DataFrame) -> DataFrame:
    """Rows whose `column` is exactly a listed journal (partitions: name); others are an error elsewhere, here they are left out."""
    return df.join(partitions.select(F.col("name").alias(column)).distinct(), column, "left_semi")


def by_key(df: DataFrame, key: str, partitions: Sequence[str], how: str = "modulo", into: str = "journal") -> DataFrame:
    fn = {"modulo": modulo, "rendezvous": rendezvous}[how]
    return df.withColumn(into, fn(key, partitions))
