"""Unsigned variable-length integers, seven bits a byte with the lowest first, as Column expressions.

Ten bytes at most, so that all are written out: no lambda, and whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = 10


def encode(value: Column | str) -> Column:
    """The bytes of a long; a negative one counts as its unsigned value, of ten bytes."""
    v = F.col(value) if isinstance(value, str) else value
    rest = [F.shiftrightunsigned(v, 7 * i) for i in range(_MOST)]
    more = [r != 0 for r in rest[1:]] + [F.lit(False)]
    byte = lambda i: F.lpad(F.hex(rest[i].bitwiseAND(F.lit(127)) + F.when(more[i], 128).otherwise(0)), 2, "0")
    return F.unhex(F.concat(byte(0), *[F.when(more[i - 1], byte(i)).otherwise("") for i in range(1, _MOST)]))


def decode(data: Column | str) -> Column:
    """The long at the beginning of a binary; null if it is cut off."""
    d = F.col(data) if isinstance(data, str) else data
    chars = F.decode(d, "ISO-8859-1")  # one character a byte
    byte = [F.ascii(F.substring(chars, i + 1, 1)).cast("long") for i in range(_MOST)]
    goes_on = [(F.length(chars) > i) & (byte[i] >= 128) for i in range(_MOST)]
    value, reached, ended = F.lit(0).cast("long"), F.lit(True), F.lit(False)
    for i in range(_MOST):
        value = value + F.when(reached, F.shiftleft(byte[i].bitwiseAND(F.lit(127)), 7 * i)).otherwise(F.lit(0).cast("long"))
        ended = ended | (reached & (F.length(chars) > i) & (byte[i] < 128))
        reached = reached & goes_on[i]
    return F.when(ended, value)
