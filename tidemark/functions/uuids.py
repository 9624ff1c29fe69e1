"""Message UUIDs: a producer (6 bytes), a clock (60-bit time and 4-bit sequence) and flags (10 bits) in an RFC 4122 v1 UUID.

Layout: time_low(4) time_mid(2) version|time_hi(2) variant|sequence(2) node(6). The clock is
(100 ns ticks since 1582-10-15) << 4 | counter; the counter and the flags share the 14 bits of the
clock sequence. All functions are Columns over the textual form.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTSIDE, CONTINUE, ACK = 0, 1, 2
#: Ticks of 100 ns between 1582-10-15 and 1970-01-01; the step of a clock tick (1 us).
EPOCH_TICKS, TICK = 122192928000000000, 160
MAX_FLAGS = 0x3FF


def _hex(uuid: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(uuid, start, n), 16, 10).cast("long")


def producer(uuid: Column | str) -> Column:
    """12 hex digits."""
    return F.lower(F.substring(F.col(uuid) if isinstance(uuid, str) else uuid, 25, 12))


def clock(uuid: Column | str) -> Column:
    u = F.col(uuid) if isinstance(uuid, str) else uuid
    ticks = F.shiftleft(_hex(u, 16, 3), 48) + F.shiftleft(_hex(u, 10, 4), 32) + _hex(u, 1, 8)
    return F.shiftleft(ticks, 4) + F.shiftright(_hex(u, 20, 4), 10).bitwiseAND(F.lit(15))


def flags(uuid: Column | str) -> Column:
    u = F.col(uuid) if isinstance(uuid, str) else uuid
    return _hex(u, 20, 4).bitwiseAND(F.lit(MAX_FLAGS)).cast("int")


def build(producer: Column, clock: Column, flags: Column) -> Column:
    """Textual UUID. Flags above 10 bits raise."""
    safe = F.when(flags.between(0, MAX_FLAGS), flags.cast("long")).otherwise(F.raise_error(F.lit("flags need at most 10 bits")).cast("long"))
    ticks = F.shiftright(clock, 4)
    # The variant's upper bit is fixed: the sequence word keeps the counter (4 bits) above the flags (10 bits).
    word = F.lit(0x8000) + F.shiftleft(clock.bitwiseAND(F.lit(15)), 10) + safe
    part = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat_ws(
        "-",
        part(ticks.bitwiseAND(F.lit(0xFFFFFFFF)), 8),
        part(F.shiftright(ticks, 32).bitwiseAND(F.lit(0xFFFF)), 4),
        F.concat(F.lit("1"), part(F.shiftright(ticks, 48).bitwiseAND(F.lit(0xFFF)), 3)),
        part(word, 4),
        producer,
    )


def clock_of(micros: Column) -> Column:
    """Clock of a time in microseconds since 1970."""
    return F.shiftleft(micros * 10 + F.lit(EPOCH_TICKS), 4)


def as_micros(clock: Column) -> Column:
    """Microseconds since 1970; the last 100 ns digit is cut, in integer arithmetic."""
    ticks = F.shiftright(clock, 4) - F.lit(EPOCH_TICKS)
    return F.call_function("div", ticks - F.pmod(ticks, F.lit(10)), F.lit(10))


def as_time(clock: Column) -> Column:
    return F.timestamp_micros(as_micros(clock))


def tick(clock: Column) -> Column:
    return clock + F.lit(TICK)


def update(clock: Column, micros: Column) -> Column:
    """The clock after seeing a time: it never decreases."""
    return F.greatest(clock, clock_of(micros))


def flag_name(flags: Column) -> Column:
    return F.when(flags == OUTSIDE, "OUTSIDE_TXN").when(flags == CONTINUE, "CONTINUE_TXN").when(flags == ACK, "ACK_TXN").otherwise("UNKNOWN")


def new_producer() -> str:
    """A random producer id, multicast bit set; one for each run that publishes."""
    raw = bytearray(secrets.token_bytes(6))
    raw[0] |= 1
    return raw.hex()
