"""Names of journals and of fragment files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name extensions of the codecs.
EXTENSIONS = {".raw": "NONE", ".gz": "GZIP", ".gzip": "GZIP", ".zst": "ZSTANDARD", ".zstandard": "ZSTANDARD", ".sz": "SNAPPY", ".snappy": "SNAPPY", "": "GZIP_OFFLOAD_DECOMPRESSION", ".gzod": "GZIP_OFFLOAD_DECOMPRESSION"}
EXTENSION_OF = {"NONE": ".raw", "GZIP": ".gz", "ZSTANDARD": ".zst", "SNAPPY": ".sz", "GZIP_OFFLOAD_DECOMPRESSION": ""}
_NAME = r"^(?:(.*)/)?([0-9a-fA-F]{1,16})-([0-9a-fA-F]{1,16})-([0-9a-fA-F]{40})(\.[^./]*)?$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def content_name(begin: Column, end: Column, sum_: Column, codec: Column) -> Column:
    """{begin:016x}-{end:016x}-{sha1 hex}{extension}"""
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    digest = F.lower(F.hex(sum_))
    return F.concat(part(begin), F.lit("-"), part(end), F.lit("-"), digest, _lookup(EXTENSION_OF, codec))


def content_path(journal: Column, postfix: Column, name: Column) -> Column:
    return F.concat_ws("/", journal, F.when(F.coalesce(postfix, F.lit("")) != "", postfix), name)


def parse_content_path(path: Column) -> Column:
    """struct(path_postfix, begin, end, sum, codec) of a path below its journal, or null if it is none."""
    part = lambda i: F.regexp_extract(path, _NAME, i)
    number = lambda i: F.conv(part(i), 16, 10).cast("decimal(20,0)")
    begin, end = number(2), number(3)
    codec = _lookup(EXTENSIONS, F.lower(part(5)))
    ok = path.rlike(_NAME) & (begin <= end) & (end <= F.lit(2**63 - 1).cast("decimal(20,0)")) & codec.isNotNull()
    return F.when(ok, F.struct(part(1).alias("path_postfix"), begin.cast("long").alias("begin_offset"), end.cast("long").alias("end_offset"), F.unhex(part(4)).alias("frag_sum"), codec.alias("codec")))


def strip_meta(journal: Column) -> Column:
    """The name before the first ';'."""
    return F.substring_index(journal, ";", 1)


def meta(journal: Column) -> Column:
    """What begins with the first ';', or ''."""
    return F.substring(journal, F.length(strip_meta(journal)) + 1, F.length(journal))


def is_token(text: Column, least: int, most: int, extra: str = "") -> Column:
    return text.rlike(rf"^[\p{{L}}\p{{N}}\-_+/.{extra}]{{{least},{most}}}$")


def is_journal(name: Column) -> Column:
    """A clean relative path of 4 to 512 allowed characters."""
    clean = ~name.rlike(r"(^|/)\.{1,2}(/|$)|//|^/|/$")
    return is_token(name, 4, 512, "=%") & clean


def rewrite_path(path: Column, find: str, replace: str) -> Column:
    """Literal replacement of the first occurrence."""
    at = F.instr(path, find)
    if not find:
        return path
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(replace), F.substring(path, at + len(find), F.length(path)))).otherwise(path)


def date_postfix(first_append: Column) -> Column:
    """utc_date=YYYY-MM-DD/utc_hour=HH"""
    return F.concat(F.lit("utc_date="), F.date_format(first_append, "yyyy-MM-dd"), F.lit("/utc_hour="), F.date_format(first_append, "HH"))
