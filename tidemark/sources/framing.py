"""Framings: byte streams of records -> records with exact offsets, and back.

A decoder takes the bytes of a stream from `base` on and yields Frame(begin, end, payload, problem).
`problem` is None for a record; bytes that are none come out as a frame with the reason, so that
nothing is lost silently. Decoders never hold more than the buffer they were given.
"""

from __future__ import annotations

import csv
import io
import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Fixed value: the word that begins a length-prefixed frame.
MAGIC = bytes((0x66, 0x33, 0x93, 0x36))
_UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


class Frame(NamedTuple):
    begin: int
    end: int
    payload: bytes
    problem: str | None = None


class FramingError(ValueError):
    pass


def ndjson(data: bytes, base: int = 0) -> Iterator[Frame]:
    """One JSON document a line. A last line without its newline is incomplete."""
    at = 0
    while at < len(data):
        nl = data.find(b"\n", at)
        if nl < 0:
            yield Frame(base + at, base + len(data), data[at:], "unexpected end")
            return
        yield Frame(base + at, base + nl + 1, data[at:nl])
        at = nl + 1


def csv_records(data: bytes, base: int = 0) -> Iterator[Frame]:
    """RFC 4180 records without a header; the first field is a UUID, and all have as many fields as the first."""
    at, width = 0, None
    while at < len(data):
        end, quoted = at, False
        while end < len(data):
            c = data[end]
            if c == 0x22:
                quoted = not quoted
            elif c == 0x0A and not quoted:
                break
            end += 1
        if end == len(data):
            yield Frame(base + at, base + end, data[at:], "unexpected end")
            return
        line = data[at:end].rstrip(b"\r")
        fields = next(csv.reader(io.StringIO(line.decode("utf-8", "replace"), newline="")), [])
        width = width or len(fields)
        problem = "wrong number of fields" if len(fields) != width else None if _UUID.fullmatch(line.split(b",", 1)[0].strip(b'"')) else "first field is no UUID"
        yield Frame(base + at, base + end + 1, line, problem)
        at = end + 1


def _fixed_at(data: bytes, at: int, base: int) -> Frame | None:
    if data[at : at + 4] != MAGIC:
        if data[at:] == b"\n":
            return None
        to = data.find(MAGIC, at + 1)
        to = len(data) if to < 0 else to
        return Frame(base + at, base + to, data[at:to], "desync")
    n = struct.unpack_from("<I", data, at + 4)[0] if at + 8 <= len(data) else len(data)
    if at + 8 + n > len(data):
        return Frame(base + at, base + len(data), data[at:], "unexpected end")
    return Frame(base + at, base + at + 8 + n, data[at + 8 : at + 8 + n])


def fixed(data: bytes, base: int = 0) -> Iterator[Frame]:
    """Magic word, little-endian length, payload. Junk is skipped up to the next magic word; a lone last newline is a clean end."""
    at = 0
    while at < len(data) and (frame := _fixed_at(data, at, base)):
        yield frame
        at = frame.end - base


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def protobuf_fields(data: bytes) -> dict[int, int | bytes]:
    """Last value of each field of a protobuf message by number: ints for varint and fixed ones, else bytes."""
    out: dict[int, int | bytes] = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            out[tag >> 3], at = _varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            out[tag >> 3] = int.from_bytes(data[at : at + n], "little")
            at += n
        elif kind == 2:
            n, at = _varint(data, at)
            out[tag >> 3] = data[at : at + n]
            at += n
        else:
            raise FramingError(f"wire type {kind}")
    return out


def recorded_op(payload: bytes) -> dict:
    """A recovery-log operation as a dict shaped like a row of recorded_ops."""
    f = protobuf_fields(payload)
    text = lambda m, i: m.get(i, b"").decode("utf-8", "replace")
    sub = lambda i: protobuf_fields(f[i]) if i in f else None
    create, link, unlink, write, prop = (sub(i) for i in (4, 5, 6, 7, 8))
    return {
        "seq_no": f.get(1, 0), "checksum": f.get(2, 0), "author": f.get(3, 0), "first_offset": f.get(9, 0), "last_offset": f.get(10, 0), "log": text(f, 11),
        "op_create": None if create is None else {"path": text(create, 1)},
        "op_link": None if link is None else {"fnode": link.get(1, 0), "path": text(link, 2)},
        "op_unlink": None if unlink is None else {"fnode": unlink.get(1, 0), "path": text(unlink, 2)},
        "op_write": None if write is None else {"fnode": write.get(1, 0), "write_offset": write.get(2, 0), "write_length": write.get(3, 0)},
        "op_property": None if prop is None else {"path": text(prop, 1), "content": text(prop, 2)},
    }


def _put_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _message(fields: list[tuple[int, int | bytes | str | None]]) -> bytes:
    """A protobuf message of varints and byte strings; what is null, 0 or empty is left out."""
    out = b""
    for number, value in fields:
        if isinstance(value, str):
            value = value.encode()
        if isinstance(value, bytes):
            out += _put_varint(number << 3 | 2) + _put_varint(len(value)) + value
        elif value:
            out += _put_varint(number << 3) + _put_varint(value)
    return out


def encode_op(op: dict, data: bytes = b"") -> bytes:
    """The frame of a recovery-log operation (a dict like those of recorded_op()), with the bytes that a write is followed by."""
    if op.get("op_write") and len(data) != (op["op_write"]["write_length"] or 0):
        raise FramingError(f"a write of {op['op_write']['write_length']} bytes is followed by {len(data)}")
    part = lambda name, *keys: None if op.get(name) is None else _message([(i + 1, op[name][k]) for i, k in enumerate(keys)])
    word = lambda number, value: _put_varint(number << 3 | 5) + struct.pack("<I", value) if value else b""
    body = _message([(1, op.get("seq_no"))]) + word(2, op.get("checksum")) + word(3, op.get("author"))
    parts = [(4, part("op_create", "path")), (5, part("op_link", "fnode", "path")), (6, part("op_unlink", "fnode", "path")), (7, part("op_write", "fnode", "write_offset", "write_length")), (8, part("op_property", "path", "content"))]
    return encode_fixed(body + _message([*parts, (9, op.get("first_offset")), (10, op.get("last_offset")), (11, op.get("log") or None)])) + data


def recovery_log(data: bytes, base: int = 0) -> Iterator[Frame]:
    """Fixed frames of operations; a write is followed by as many raw bytes as it says, which belong to its frame."""
    at = 0
    while at < len(data) and (frame := _fixed_at(data, at, base)):
        extra = 0
        if frame.problem is None:
            write = protobuf_fields(frame.payload).get(7)
            extra = protobuf_fields(write).get(3, 0) if write is not None else 0
            if frame.end - base + extra > len(data):
                yield Frame(frame.begin, base + len(data), frame.payload, "unexpected end")
                return
        yield frame._replace(end=frame.end + extra)
        at = frame.end + extra - base


Decoder = Callable[[bytes, int], Iterator[Frame]]
_REGISTRY: dict[str, Decoder] = {}


def register(content_type: str, decoder: Decoder) -> None:
    if content_type in _REGISTRY:
        raise FramingError(f"{content_type} is registered already")
    _REGISTRY[content_type] = decoder


def by_content_type(content_type: str) -> Decoder:
    try:
        return _REGISTRY[content_type.partition(";")[0].strip().lower()]
    except KeyError:
        raise FramingError(f"no framing for {content_type!r}") from None


for _type, _decoder in (("application/x-ndjson", ndjson), ("text/csv", csv_records), ("application/x-protobuf-fixed", fixed), ("recovery-log", recovery_log)):
    register(_type, _decoder)


def encode_line(payload: bytes) -> bytes:
    return payload + b"\n"


def encode_fixed(payload: bytes) -> bytes:
    return MAGIC + struct.pack("<I", len(payload)) + payload


ENCODERS = {"application/x-ndjson": encode_line, "text/csv": encode_line, "application/x-protobuf-fixed": encode_fixed, "recovery-log": bytes, "none": bytes}
