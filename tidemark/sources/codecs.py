"""Compression codecs of fragment files."""

from __future__ import annotations

import gzip
import struct

import pyarrow as pa

from tidemark.functions.checksums import crc32c_update

#: Fixed values of the framed Snappy format: the stream's first chunk, and the largest block.
_SNAPPY_HEAD, _SNAPPY_BLOCK = b"\xff\x06\x00\x00sNaPpY", 65536


def _masked_crc(data: bytes) -> int:
    c = crc32c_update(0, data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _snappy_length(data: bytes) -> int:
    n = shift = 0
    for b in data:
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n
        shift += 7
    raise ValueError("bad snappy block")


def _unsnappy(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("snappy stream is cut off")
        at += 4 + size
        if kind in (0, 1):
            block = body[4:] if kind else pa.decompress(body[4:], _snappy_length(body[4:]), codec="snappy", asbytes=True)
            if struct.unpack("<I", body[:4])[0] != _masked_crc(block):
                raise ValueError("snappy checksum")
            out.append(block)
        elif kind < 0x80 and kind != 0xFF:
            raise ValueError(f"snappy chunk {kind}")
    return b"".join(out)


def _snappy(data: bytes) -> bytes:
    out = [_SNAPPY_HEAD]
    for at in range(0, len(data), _SNAPPY_BLOCK):
        block = data[at : at + _SNAPPY_BLOCK]
        body = struct.pack("<I", _masked_crc(block)) + pa.compress(block, codec="snappy", asbytes=True)
        out.append(b"\x00" + len(body).to_bytes(3, "little") + body)
    return b"".join(out)


def _unzstd(data: bytes) -> bytes:
    import io

    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()


def decompress(codec: str, data: bytes) -> bytes:
    """Content of a file. A gzip file may have several members, a zstd file several frames."""
    if codec == "NONE":
        return data
    if codec in ("GZIP", "GZIP_OFFLOAD_DECOMPRESSION"):
        return gzip.decompress(data)
    if codec == "ZSTANDARD":
        return _unzstd(data)
    if codec == "SNAPPY":
        return _unsnappy(data)
    raise ValueError(f"unknown codec {codec!r}")


def compress(codec: str, data: bytes) -> bytes:
    if codec == "NONE":
        return data
    if codec in ("GZIP", "GZIP_OFFLOAD_DECOMPRESSION"):
        return gzip.compress(data, mtime=0)
    if codec == "ZSTANDARD":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec == "SNAPPY":
        return _snappy(data)
    raise ValueError(f"unknown codec {codec!r}")
