"""python -m tidemark journals list|read|append|fragments|prune ... and attach-uuids: the operators from a shell."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from tidemark.functions import mapping, uuids
from tidemark.operators import fragments
from tidemark.session import local_session
from tidemark.sources import framing, journal


def _args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "read", "fragments", "prune", "append"):
        c = sub.add_parser(name)
        c.add_argument("path", help="roots of the fragment stores, comma-separated")
        c.add_argument("--prefix", default="")
        if name == "read":
            c.add_argument("--content-type", default="application/x-ndjson")
            c.add_argument("--begin", type=int, default=0)
            c.add_argument("--end", type=int, default=0)
            c.add_argument("--from", dest="since", type=int, default=0, help="lower bound on modification time")
        if name == "prune":
            c.add_argument("--retention", type=int, required=True, help="seconds")
        if name == "append":
            c.add_argument("--journals", required=True, help="names, comma-separated")
            c.add_argument("--framing", default="application/x-ndjson", choices=sorted(framing.ENCODERS))
            c.add_argument("--mapping", default="modulo", choices=("modulo", "rendezvous", "random"))
            c.add_argument("--base64", action="store_true", help="keys are base64")
            c.add_argument("--codec", default="NONE")
    a = sub.add_parser("attach-uuids")
    a.add_argument("--skip-header", action="store_true")
    a.add_argument("--template", default="{uuid},{line}")
    return p.parse_args(argv)


def attach(lines, template: str, skip_header: bool):
    """Each line with a UUID of its own, all of one producer, clocks ascending; committed at once."""
    producer, clock = uuids.new_producer(), (int(time.time() * 1e7) + uuids.EPOCH_TICKS) << 4
    for i, line in enumerate(lines):
        if i or not skip_header:
            clock += uuids.TICK
            t = clock >> 4
            text = f"{t & 0xFFFFFFFF:08x}-{t >> 32 & 0xFFFF:04x}-1{t >> 48 & 0xFFF:03x}-{0x8000 + ((clock & 15) << 10):04x}-{producer}"
            yield template.format(uuid=text, line=line.rstrip("\n"))


def main(argv: list[str]) -> int:
    a = _args(argv)
    if a.command == "attach-uuids":
        for line in attach(sys.stdin, a.template, a.skip_header):
            print(line)
        return 0
    spark = local_session()
    journal.register(spark)
    roots = a.path.split(",")
    if a.command == "append":
        names = a.journals.split(",")
        rows = [line.rstrip("\n").partition("\t") for line in sys.stdin]  # key, tab, record
        df = spark.createDataFrame([(k, v) for k, _, v in rows], "key string, record string")
        key = F.unbase64("key") if a.base64 else F.col("key")
        to = mapping.random(names) if a.mapping == "random" else {"modulo": mapping.modulo, "rendezvous": mapping.rendezvous}[a.mapping](key, names)
        df.select(to.alias("journal"), F.col("record").cast("binary").alias("payload")).write.format("journal").option("path", roots[0]).option("contentType", a.framing).option("codec", a.codec).mode("append").save()
        return 0
    if a.command == "read":
        df = spark.read.format("journal").option("path", a.path).option("prefix", a.prefix).option("contentType", a.content_type).option("beginOffset", a.begin).option("endOffset", a.end).option("beginModTime", a.since).load()
        for r in df.toLocalIterator():
            sys.stdout.buffer.write(bytes(r.payload) + b"\n")
        return 0
    m = journal.manifest(spark, roots).where(F.col("journal").startswith(a.prefix))
    if a.command == "list":
        out = fragments.extent(m).orderBy("journal")
    elif a.command == "fragments":
        out = m.select("journal", "begin_offset", "end_offset", "codec", "mod_time", "path").orderBy("journal", "begin_offset")
    else:
        out = fragments.aged_out(m, a.retention, int(time.time())).select("path").orderBy("path")
    for r in out.toLocalIterator():
        print("\t".join(map(str, r)))
        if a.command == "prune":
            store, _ = journal.filesystem(r.path.replace("file:/", "file:///", 1) if r.path.startswith("file:/") and not r.path.startswith("file:///") else r.path)
            store.delete_file(r.path.removeprefix("file:"))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
