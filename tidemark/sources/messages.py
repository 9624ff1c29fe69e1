"""From journals to rows: read-uncommitted envelopes, and read-committed messages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import uuids
from tidemark.functions.labels import LABELS, matches
from tidemark.operators.sequencer import committed
from tidemark.session import Versions
from tidemark.sources import journal as source

#: Schemas by message type, given by the application; nothing is inferred.
_SCHEMAS: dict[str, T.StructType] = {}


def register_type(message_type: str, schema: T.StructType) -> None:
    _SCHEMAS[message_type] = schema


def schema_of(message_type: str) -> T.StructType:
    if message_type not in _SCHEMAS:
        raise KeyError(f"no schema is registered for {message_type!r}")
    return _SCHEMAS[message_type]


def read_uncommitted(spark: SparkSession, path: str, schema: T.StructType | str, journals: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Envelopes of JSON messages: journal, begin_offset, end_offset, and the fields of `schema`. Unknown fields are ignored."""
    source.register(spark)
    kind = schema_of(schema) if isinstance(schema, str) and schema in _SCHEMAS else schema
    raw = spark.read.format("journal").options(path=path, **options)
    if journals is not None:
        raw = raw.option("journals", ",".join(journals))
    text = raw.load().select("journal", "begin_offset", "end_offset", F.from_json(F.col("payload").cast("string"), kind, {"mode": "FAILFAST"}).alias("m"))
    return text.select("journal", "begin_offset", "end_offset", "m.*")


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str, uuid: str = "uuid", journals: Sequence[str] | None = None, drop_acks: bool = False, min_offsets: dict[str, int] | None = None, **options: str) -> DataFrame:
    """Committed messages, each once, with commit_begin. Those before a journal's entry in min_offsets are not read."""
    env = read_uncommitted(spark, path, schema, journals, **options)
    if min_offsets:
        floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in min_offsets.items() for x in kv]), F.col("journal"))
        env = env.where(F.col("begin_offset") >= F.coalesce(floor, F.lit(0)))
    parts = env.select("journal", "begin_offset", uuids.producer(uuid).alias("producer"), uuids.clock(uuid).alias("clock"), uuids.flags(uuid).alias("flags"))
    done = committed(parts, drop_acks).select("journal", "begin_offset", "commit_begin", "producer", "clock", "flags")
    return env.join(done, ["journal", "begin_offset"])


def select_journals(specs: DataFrame, selector: str) -> list[str]:
    """Names of readable journals (name, labels, and suspend and flags if given) that match: a catalog is small, and its names plan the read."""
    from tidemark.operators.catalog import list_journals, may_read

    rows = list_journals(specs, selector)
    if "suspend" in specs.columns:
        rows = rows.where("coalesce(suspend, 'NONE') <> 'FULL'")
    if "flags" in specs.columns:
        rows = rows.where(may_read(F.col("flags")))
    return [r.name for r in rows.select("name").collect()]


class Registers:
    """Labels of a journal by which writers fence each other off, replaced by compare-and-swap."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._versions = spark, Versions(spark, path)

    def read(self) -> dict[str, str]:
        return json.loads(self._versions.read()[1] or "{}")

    def append(self, check: str = "", subtract: Sequence[str] = (), union: dict[str, str] | None = None) -> bool:
        """Update if the registers match `check` (empty ones match anything): subtract names, then add, new values winning.

        If another writer changes them between check and update, both are done anew.
        """
        while True:
            seen, text = self._versions.read()
            have = json.loads(text or "{}")
            if have and check:
                row = self.spark.createDataFrame([(sorted(have.items()),)], f"labels {LABELS}")
                if not row.select(matches("labels", check)).first()[0]:
                    return False
            kept = {k: v for k, v in have.items() if k not in subtract} | (union or {})
            if self._versions.replace(seen, json.dumps(kept, sort_keys=True)):
                return True
