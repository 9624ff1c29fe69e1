"""Journals of fragment files as a Spark data source.

Files are {store}/{journal}/{postfix}/{begin:016x}-{end:016x}-{sha1}{extension}. Reading:

* the listing becomes a manifest, pruned by journal or selector, modification time and offsets;
* the cover set gives each byte to one file, so partitions are independent of each other and no
  record is read twice;
* each file is fetched, decompressed, checked for its exact length and framed, and its records leave
  as Arrow batches; small files share a task.

Appending is all or nothing, for all journals of a write together: tasks spool, the commit claims the
offsets at which each journal ends, names all files it is about to add in one intent, moves them, and
removes the intent. Files named in an intent are hidden from readers until then; those of a writer
that died stay hidden, and recover() deletes them. Of two writers that meet at one offset at most one goes on.

Register with ``register(spark)``, then ``spark.read.format("journal")``, ``readStream`` and
``df.write.format("journal")``. Options: path (store roots, comma-separated), journal (exact name),
journals (names, comma-separated) or prefix, contentType, beginOffset, endOffset, beginModTime, endModTime, holePolicy (skip, stop or
fail), onProblem (fail or keep), partitionBytes; for writing also codec, postfix, expectOffset (or -1) and maxFileBytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.functions.names import EXTENSION_OF, EXTENSIONS
from tidemark.sources import codecs, framing

SCHEMA = "journal string, begin_offset bigint, end_offset bigint, payload binary, problem string"
_NAME = re.compile(r"([0-9a-f]{16})-([0-9a-f]{16})-([0-9a-f]{40})(\.[^./]*)?$", re.I)


class JournalError(Exception):
    pass


class WrongAppendOffset(JournalError):
    pass


class OffsetNotYetAvailable(JournalError):
    pass


@dataclass(frozen=True)
class Fragment(InputPartition):
    journal: str
    begin: int
    end: int
    sum: str
    codec: str
    mod_time: int
    path: str
    read_from: int = 0
    read_to: int = 0
    store: str = ""


def filesystem(root: str):
    """The file system of a store (file, s3, gs, hdfs, ...; a path without a scheme is local) and the path on it."""
    from pyarrow import fs

    if re.match(r"\w+:", root):
        return fs.FileSystem.from_uri(root.rstrip("/"))
    return fs.LocalFileSystem(), root.rstrip("/")


def _files(store, folder: str) -> list:
    from pyarrow import fs

    return [i for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)) if i.type == fs.FileType.File]


def _intents(store, base: str) -> dict[str, list[str]]:
    """The files, below base, that unfinished appends are about to add, by the path of the intent."""
    out = {}
    for info in _files(store, f"{base}/.intents"):
        with contextlib.suppress(FileNotFoundError), store.open_input_file(info.path) as f:
            out[info.path] = json.loads(f.read() or b"[]")
    return out


def list_fragments(roots: list[str], journal: str | None = None, prefix: str = "", journals: set[str] | None = None) -> list[Fragment]:
    """Manifest of all stores; names that are none are passed over. A journal is what lies above the postfix (parts with '=').

    Only the folders of the wanted journals, or that of the prefix, are listed, many at a time.
    """
    from concurrent.futures import ThreadPoolExecutor

    names = {journal} if journal else journals
    if journal and journals is not None:
        names = {journal} & journals
    out = []
    for root in roots:
        store, base = filesystem(root)
        above = prefix.rpartition("/")[0]
        folders = sorted(f"{base}/{n}" for n in names) if names is not None else [f"{base}/{above}" if above else base]
        with ThreadPoolExecutor(16) as pool:
            listed = list(pool.map(lambda f: _files(store, f), folders))  # noqa: B023 - used up within the turn
        # Read after the listing: what is no intent any more was whole when it was listed, or is listed the next time.
        hidden = {f"{base}/{f}" for files in _intents(store, base).values() for f in files}
        for info in (i for files in listed for i in files):
            m = _NAME.fullmatch(info.base_name)
            codec = EXTENSIONS.get((m[4] or "").lower()) if m else None
            name = "/".join(p for p in info.path[len(base) :].strip("/").split("/")[:-1] if "=" not in p)
            if not codec or int(m[1], 16) > int(m[2], 16) or (names is not None and name not in names) or not name.startswith(prefix) or info.path in hidden:
                continue
            out.append(Fragment(name, int(m[1], 16), int(m[2], 16), m[3].lower(), codec, int((info.mtime_ns or 0) // 1_000_000_000), info.path, store=root))
    return out


def recover(root: str, older_than: float = 3600) -> int:
    """Undo appends begun more than `older_than` seconds ago and not finished; returns how many. Their files were never readable."""
    store, base = filesystem(root)
    n = 0
    for info in _files(store, f"{base}/.intents"):
        if (info.mtime_ns or 0) / 1e9 > time.time() - older_than:
            continue
        with store.open_input_file(info.path) as f:
            names = json.loads(f.read() or b"[]")
        for name in names:
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(f"{base}/{name}")
        store.delete_file(info.path)
        n += 1
    for info in _files(store, f"{base}/.claims"):
        if (info.mtime_ns or 0) / 1e9 <= time.time() - older_than:
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(info.path)
    return n


def plan(fragments: list[Fragment], begin: int = 0, end: int = 0, begin_mod_time: int = 0, end_mod_time: int = 0, holes: str = "skip") -> list[Fragment]:
    """The files to read and which bytes of each: every byte of [begin, end) once, from the file that reaches furthest."""
    out: list[Fragment] = []
    by: dict[str, list[Fragment]] = {}
    for f in fragments:
        if f.end > f.begin and f.mod_time >= begin_mod_time and (not end_mod_time or f.mod_time <= end_mod_time):
            by.setdefault(f.journal, []).append(f)
    for _, fs in sorted(by.items()):
        at = max((f.end for f in fs), default=0) if begin == -1 else begin
        started = False
        for f in sorted(fs, key=lambda f: (f.begin, -f.end)):
            if f.end <= at or (end and f.begin >= end):
                continue
            if f.begin > at and started and holes != "skip":
                if holes == "fail":
                    raise OffsetNotYetAvailable(f"{f.journal}: nothing holds [{at}, {f.begin})")
                break
            lo = max(at, f.begin)
            hi = min(f.end, end) if end else f.end
            out.append(replace(f, read_from=lo, read_to=hi))
            at, started = hi, True
    return out


def read_fragment(f: Fragment, content_type: str, fail: bool) -> Iterator:
    """Arrow batches of some megabytes of the schema's columns."""
    import pyarrow as pa

    with filesystem(f.store)[0].open_input_file(f.path) as file:
        data = codecs.decompress(f.codec, file.read())
    if len(data) != f.end - f.begin:
        raise JournalError(f"{f.path} holds {len(data)} bytes instead of {f.end - f.begin}")
    part = data[f.read_from - f.begin : f.read_to - f.begin]
    schema = pa.schema([("journal", pa.string()), ("begin_offset", pa.int64()), ("end_offset", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
    frames: list[framing.Frame] = []
    size = 0

    def batch():
        begin, end, payload, problem = zip(*frames, strict=True)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(f.journal), len(frames)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(payload, pa.binary()), pa.array(problem, pa.string())], schema=schema)

    for frame in framing.by_content_type(content_type)(part, f.read_from):
        if frame.problem and fail:
            raise framing.FramingError(f"{f.journal} at {frame.begin}: {frame.problem}")
        frames.append(frame)
        size += len(frame.payload)
        if len(frames) >= 20_000 or size > 8 << 20:
            yield batch()
            frames, size = [], 0
    if frames:
        yield batch()


@dataclass(frozen=True)
class Share(InputPartition):
    """The fragments that one task reads."""

    fragments: tuple[Fragment, ...]


def share_out(fragments: list[Fragment], size: int) -> list[InputPartition]:
    """Neighbouring fragments together until a task has `size` bytes to read; at least one task."""
    out: list[list[Fragment]] = []
    have = size
    for f in fragments:
        n = f.read_to - f.read_from
        if have + n > size:
            out.append([])
            have = 0
        out[-1].append(f)
        have += n
    return [Share(tuple(x)) for x in out] or [Share(())]


class _Options:
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        if not o.get("path"):
            raise JournalError("option path is missing")
        self.roots = [r for r in o["path"].split(",") if r]
        self.journal, self.prefix = o.get("journal"), o.get("prefix", "")
        self.journals = set(o["journals"].split(",")) if "journals" in o else None
        self.content_type = o.get("contenttype", "application/x-ndjson")
        self.begin, self.end = int(o.get("beginoffset", 0)), int(o.get("endoffset", 0))
        self.begin_mod, self.end_mod = int(o.get("beginmodtime", 0)), int(o.get("endmodtime", 0))
        self.holes, self.fail = o.get("holepolicy", "skip"), o.get("onproblem", "fail") == "fail"
        self.codec, self.postfix = o.get("codec", "NONE"), o.get("postfix", "")
        self.expect, self.max_bytes = int(o.get("expectoffset", -1)), int(o.get("maxfilebytes", 256 << 20))
        self.share = int(o.get("partitionbytes", 32 << 20))
        framing.by_content_type(self.content_type)
        if self.codec not in EXTENSION_OF:
            raise JournalError(f"unknown codec {self.codec!r}")

    def listing(self) -> list[Fragment]:
        return list_fragments(self.roots, self.journal, self.prefix, self.journals)


class JournalReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options

    def pushFilters(self, filters):
        """An equality on journal and bounds on begin_offset prune files; all are applied again afterwards."""
        for f in filters:
            kind, name = type(f).__name__, f.attribute[0] if getattr(f, "attribute", None) else ""
            if kind == "EqualTo" and name == "journal":
                self.o.journals = {f.value} if self.o.journals is None else self.o.journals & {f.value}
            elif kind in ("GreaterThanOrEqual", "GreaterThan") and name == "begin_offset" and self.o.begin >= 0:
                self.floor = max(getattr(self, "floor", 0), f.value)
            elif kind in ("LessThan", "LessThanOrEqual") and name == "begin_offset":
                top = f.value + (kind == "LessThanOrEqual")
                self.top = min(getattr(self, "top", top), top)
            yield f

    def partitions(self):
        found = plan(self.o.listing(), self.o.begin, self.o.end, self.o.begin_mod, self.o.end_mod, self.o.holes)
        floor, top = getattr(self, "floor", 0), getattr(self, "top", None)
        return share_out([f for f in found if f.read_to > floor and (top is None or f.read_from < top)], self.o.share)

    def read(self, partition):
        for f in partition.fragments:
            yield from read_fragment(f, self.o.content_type, self.o.fail)


class JournalStreamReader(DataSourceStreamReader):
    """Offsets are a map from journal to the end of what is contiguous there; the listing is made anew each time."""

    def __init__(self, options: _Options):
        self.o = options

    def initialOffset(self):
        return {}

    def latestOffset(self):
        heads: dict[str, int] = {}
        for f in plan(self.o.listing(), 0, 0, self.o.begin_mod, 0, self.o.holes):
            heads[f.journal] = max(heads.get(f.journal, 0), f.read_to)
        return heads

    def partitions(self, start, end):
        files: dict[str, list[Fragment]] = {}
        for f in self.o.listing():
            files.setdefault(f.journal, []).append(f)
        out = []
        for journal, to in sorted(end.items()):
            at = max(start.get(journal, 0), self.o.begin)
            if at < to:
                out += plan(files.get(journal, []), at, to, self.o.begin_mod, 0, self.o.holes)
        return share_out(out, self.o.share)

    def read(self, partition):
        for f in partition.fragments:
            yield from read_fragment(f, self.o.content_type, self.o.fail)

    def commit(self, end):
        pass


def _put(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


@dataclass
class Spooled(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]  # journal, temporary path, bytes, sha1


class JournalWriter(DataSourceWriter):
    """Rows (journal, payload) -> fragments. Tasks spool; the commit gives offsets and publishes all at once, an abort leaves nothing.

    A task holds maxFileBytes at most, of all journals together; beyond that the longest spool is written out.
    """

    def __init__(self, options: _Options, schema: StructType):
        self.o, self.names = options, schema.fieldNames()
        self.run = uuid.uuid4().hex
        if not {"journal", "payload"} <= set(self.names):
            raise JournalError("rows need journal and payload")

    def _roll(self, journal: str, parts: list[bytes]) -> tuple[str, str, int, str]:
        data = b"".join(parts)
        store, base = filesystem(self.o.roots[0])
        spool = f"{base}/.spool-{self.run}"
        store.create_dir(spool, recursive=True)
        path = f"{spool}/{uuid.uuid4().hex}"
        with store.open_output_stream(path) as f:
            f.write(codecs.compress(self.o.codec, data))
        return journal, path, len(data), hashlib.sha1(data).hexdigest()

    def write(self, iterator):
        encode = framing.ENCODERS[self.o.content_type]
        open_: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        held = 0
        done = []
        for row in iterator:
            j = row.journal
            frame = encode(bytes(row.payload))
            open_.setdefault(j, []).append(frame)
            size[j] = size.get(j, 0) + len(frame)
            held += len(frame)
            if held >= self.o.max_bytes:
                longest = max(size, key=size.get)
                held -= size.pop(longest)
                done.append(self._roll(longest, open_.pop(longest)))
        done += [self._roll(j, parts) for j, parts in sorted(open_.items())]
        return Spooled(done)

    def commit(self, messages):
        store, base = filesystem(self.o.roots[0])
        spooled = [x for m in messages if m for x in m.files if x[2]]
        names = {x[0] for x in spooled}
        claims: list[str] = []
        try:
            heads = self._claim(store, base, names, claims)
            moves = []
            for j, path, n, digest in spooled:
                begin = heads[j]
                heads[j] = begin + n
                folder = f"{j}/{self.o.postfix}" if self.o.postfix else j
                moves.append((path, folder, f"{folder}/{begin:016x}-{begin + n:016x}-{digest}{EXTENSION_OF[self.o.codec]}"))
            if moves:
                intent = f"{base}/.intents/{self.run}.json"
                _put(store, f"{base}/.spool-{self.run}/intent", json.dumps([to for _, _, to in moves]).encode())
                store.create_dir(f"{base}/.intents", recursive=True)
                store.move(f"{base}/.spool-{self.run}/intent", intent)
                for folder in sorted({folder for _, folder, _ in moves}):
                    store.create_dir(f"{base}/{folder}", recursive=True)
                for path, _, to in moves:
                    store.move(path, f"{base}/{to}")
                store.delete_file(intent)  # from here on all of them are readable
        finally:
            for c in claims:
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(c)
            self.abort(messages)

    def _claim(self, store, base: str, names: set[str], claims: list[str]) -> dict[str, int]:
        """The ends of the journals, at each of which this writer alone may append.

        A writer goes on only if, after writing its own claim, it sees no other one to the same place and the
        end has not moved meanwhile. A claim is removed after the files are readable, so that of two
        writers the later one sees either the claim or the files.
        """
        heads = self._heads(names)
        for j in sorted(names):
            if self.o.expect >= 0 and heads[j] != self.o.expect:
                raise WrongAppendOffset(f"{j} ends at {heads[j]}, not {self.o.expect}")
            folder = f"{base}/.claims/{j.replace('/', '%')}"
            mine = f"{folder}/{heads[j]:016x}.{self.run}"
            store.create_dir(folder, recursive=True)
            claims.append(mine)
            _put(store, mine, b"")
            if [i for i in _files(store, folder) if i.base_name.startswith(f"{heads[j]:016x}.") and not i.base_name.endswith(self.run)]:
                raise WrongAppendOffset(f"another writer appends to {j} at {heads[j]}")
        now = self._heads(names)
        if moved := sorted(j for j in names if now[j] != heads[j]):
            raise WrongAppendOffset(f"{moved[0]} ends at {now[moved[0]]}, not {heads[moved[0]]} any more")
        return heads

    def _heads(self, names: set[str]) -> dict[str, int]:
        out = dict.fromkeys(names, 0)
        for f in list_fragments(self.o.roots, journals=names):
            out[f.journal] = max(out[f.journal], f.end)
        return out

    def abort(self, messages):
        store, base = filesystem(self.o.roots[0])
        with contextlib.suppress(FileNotFoundError, OSError):
            store.delete_dir(f"{base}/.spool-{self.run}")


class JournalSource(DataSource):
    @classmethod
    def name(cls):
        return "journal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return JournalReader(_Options(self.options))

    def streamReader(self, schema):
        return JournalStreamReader(_Options(self.options))

    def writer(self, schema, overwrite):
        return JournalWriter(_Options(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JournalSource)


def manifest(spark: SparkSession, roots: list[str]):
    """The listing as a DataFrame: Spark lists the files in parallel and reads no content."""
    from pyspark.sql import functions as F

    from tidemark.functions.names import parse_content_path

    out = None
    for root in roots:
        mark = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*-*-*").load(root).select("path", "modificationTime", "length")
        rel = F.substring_index("path", mark, -1)
        folders = F.split(rel, "/")
        journal = F.array_join(F.filter(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda p: ~p.contains("=")), "/")
        parsed = files.withColumn("_rel", rel).withColumn("journal", journal).withColumn("_p", parse_content_path(F.substring(F.col("_rel"), F.length("journal") + 2, F.length("_rel"))))
        store, base = filesystem(root)
        hidden = [f for names in _intents(store, base).values() for f in names]
        if hidden:
            parsed = parsed.where(~F.col("_rel").isin(hidden))
        one = parsed.where("_p is not null").select("journal", "_p.begin_offset", "_p.end_offset", "_p.frag_sum", "_p.codec", F.lit(root).alias("store"), F.unix_timestamp("modificationTime").alias("mod_time"), "_p.path_postfix", "path", "length")
        out = one if out is None else out.unionByName(one)
    return out


def write_head(roots: list[str], journal: str) -> int:
    return max((f.end for f in list_fragments(roots, journal)), default=0)


def status(offset: int, roots: list[str], journal: str) -> str:
    """What a read at `offset` would meet: OK, OFFSET_NOT_YET_AVAILABLE, OFFSET_JUMP or JOURNAL_NOT_FOUND."""
    files = [f for f in list_fragments(roots, journal) if f.end > f.begin]
    if not files:
        return "JOURNAL_NOT_FOUND"
    if any(f.begin <= offset < f.end for f in files):
        return "OK"
    later = [f for f in files if f.begin > offset]
    first = min(f.begin for f in files)
    old = later and min(later, key=lambda f: f.begin).mod_time < time.time() - 6 * 3600
    return "OFFSET_JUMP" if later and (offset <= first or old) else "OFFSET_NOT_YET_AVAILABLE"


def to_json(offsets: dict[str, int]) -> str:
    return json.dumps(offsets, sort_keys=True)
