from __future__ import annotations

import io
import os

from tidemark import __main__ as cli
from tidemark.sources import framing, journal


def test_append_list_read_prune(spark, tmp_path, monkeypatch, capfdbinary):
    root = f"file://{tmp_path}"
    monkeypatch.setattr("sys.stdin", io.StringIO('a\t{"x":1}\nb\t{"x":2}\na\t{"x":3}\n'))
    cli.main(["append", root, "--journals", "t/0,t/1", "--codec", "GZIP"])
    capfdbinary.readouterr()
    cli.main(["read", root])
    assert sorted(capfdbinary.readouterr().out.split()) == [b'{"x":1}', b'{"x":2}', b'{"x":3}']
    cli.main(["list", root, "--prefix", "t/"])
    assert sum(int(x.split(b"\t")[2]) for x in capfdbinary.readouterr().out.splitlines()) == 24
    cli.main(["prune", root, "--retention", "86400"])
    assert len(journal.list_fragments([root])) >= 1
    for f in journal.list_fragments([root]):
        os.utime(f.path, (1, 1))
    cli.main(["prune", root, "--retention", "86400"])
    assert journal.list_fragments([root]) == []


def test_attach_uuids():
    got = list(cli.attach(["head\n", "1,2\n", "3,4\n"], "{uuid},{line}", True))
    assert [g.split(",", 1)[1] for g in got] == ["1,2", "3,4"]
    assert all(f.problem is None for f in framing.csv_records(("\n".join(got) + "\n").encode())) and got[0] < got[1]
