from __future__ import annotations

import hashlib
import os
import uuid

import pytest

from tidemark.sources import codecs, framing, journal
from tidemark.sources.framing import Frame

U = str(uuid.UUID(int=7)).encode()


def test_ndjson():
    data = b'{"A":42}\n{"Bar":63}\n{"cut'
    assert list(framing.ndjson(data, 100)) == [Frame(100, 109, b'{"A":42}'), Frame(109, 120, b'{"Bar":63}'), Frame(120, 125, b'{"cut', "unexpected end")]


def test_csv():
    data = U + b',123,"qu""o\nte"\n' + U + b',"567,891"\n' + b"nope,1,2\n"
    got = list(framing.csv_records(data))
    assert [f.problem for f in got] == [None, "wrong number of fields", "first field is no UUID"]
    assert got[0].payload.endswith(b'"qu""o\nte"') and got[1].begin == got[0].end == len(U) + 16


def test_fixed():
    one = bytes.fromhex("66339336") + b"\x14\0\0\0test message content"
    two = framing.encode_fixed(b"foo message")
    got = list(framing.fixed(b"foobar" + one + two + b"\n"))
    assert [(f.payload, f.problem) for f in got] == [(b"foobar", "desync"), (b"test message content", None), (b"foo message", None)]
    assert list(framing.fixed(one[:10]))[0].problem == "unexpected end"
    assert framing.encode_fixed(b"test message content") == one


def test_recovery_log():
    create = bytes([0x08, 1, 0x15, 1, 0, 0, 0, 0x1D, 2, 0, 0, 0, 0x22, 3, 0x0A, 1, ord("f")])
    write = bytes([0x08, 2, 0x3A, 6, 0x08, 1, 0x10, 0, 0x18, 4])
    data = framing.encode_fixed(create) + framing.encode_fixed(write) + b"DATA" + framing.encode_fixed(create)
    got = list(framing.recovery_log(data, 10))
    assert [f.problem for f in got] == [None] * 3
    assert got[1].end - got[1].begin == 8 + len(write) + 4 and got[2].end == 10 + len(data)
    op = framing.recorded_op(got[0].payload)
    assert (op["seq_no"], op["checksum"], op["author"], op["op_create"], op["op_write"]) == (1, 1, 2, {"path": "f"}, None)
    assert framing.recorded_op(got[1].payload)["op_write"] == {"fnode": 1, "write_offset": 0, "write_length": 4}


def test_registry():
    assert framing.by_content_type("text/csv; charset=utf-8") is framing.csv_records
    with pytest.raises(framing.FramingError):
        framing.by_content_type("text/unknown")
    with pytest.raises(framing.FramingError):
        framing.register("text/csv", framing.ndjson)


@pytest.mark.parametrize("codec", ["NONE", "GZIP", "ZSTANDARD", "SNAPPY", "GZIP_OFFLOAD_DECOMPRESSION"])
def test_codecs(codec):
    for data in (b"", b"x", os.urandom(200_000), b"abc" * 100_000):
        assert codecs.decompress(codec, codecs.compress(codec, data)) == data
    joined = codecs.compress(codec, b"one") + codecs.compress(codec, b"two")
    assert codecs.decompress(codec, joined) == b"onetwo"


def put(root, name, begin, content, codec="NONE", postfix=""):
    folder = os.path.join(root, name, postfix)
    os.makedirs(folder, exist_ok=True)
    end = begin + len(content)
    ext = {"NONE": ".raw", "GZIP": ".gz", "ZSTANDARD": ".zst", "SNAPPY": ".sz"}[codec]
    with open(os.path.join(folder, f"{begin:016x}-{end:016x}-{hashlib.sha1(content).hexdigest()}{ext}"), "wb") as f:
        f.write(codecs.compress(codec, content))
    return end


@pytest.fixture
def store(tmp_path):
    root = str(tmp_path)
    put(root, "a/one", 0, b"1\n2\n3\n")
    put(root, "a/one", 0, b"1\n2\n", "GZIP", "utc_date=2025-01-01")
    put(root, "a/one", 4, b"3\n4\n", "ZSTANDARD")
    put(root, "a/one", 20, b"9\n", "SNAPPY")
    put(root, "a/two", 0, b"x\n")
    open(os.path.join(root, "a", "one", "junk.txt"), "w").close()
    return root


def read(spark, store, **options):
    journal.register(spark)
    r = spark.read.format("journal").option("path", store)
    for k, v in options.items():
        r = r.option(k, v)
    return sorted((x.journal, x.begin_offset, bytes(x.payload).decode()) for x in r.load().collect())


def test_read_each_record_once(spark, store):
    assert read(spark, store) == [("a/one", 0, "1"), ("a/one", 2, "2"), ("a/one", 4, "3"), ("a/one", 6, "4"), ("a/one", 20, "9"), ("a/two", 0, "x")]


def test_ranges_and_holes(spark, store):
    assert read(spark, store, journal="a/one", beginOffset=2, endOffset=6) == [("a/one", 2, "2"), ("a/one", 4, "3")]
    assert read(spark, store, journal="a/one", holePolicy="stop")[-1] == ("a/one", 6, "4")
    with pytest.raises(Exception, match="nothing holds"):
        read(spark, store, holePolicy="fail")
    assert read(spark, store, prefix="a/t") == [("a/two", 0, "x")]
    assert read(spark, store, beginModTime=4_000_000_000) == []


def test_filters_prune_files(spark, store):
    journal.register(spark)
    df = spark.read.format("journal").option("path", store).load().where("journal = 'a/one' and begin_offset >= 20")
    assert [r.begin_offset for r in df.collect()] == [20]
    assert df.rdd.getNumPartitions() == 1


def test_wrong_length_is_an_error(spark, store):
    name = next(f for f in os.listdir(os.path.join(store, "a", "two")))
    with open(os.path.join(store, "a", "two", name), "ab") as f:
        f.write(b"more\n")
    with pytest.raises(Exception, match="instead of"):
        read(spark, store)


def test_append_and_expected_offset(spark, tmp_path):
    journal.register(spark)
    root = str(tmp_path)
    rows = spark.createDataFrame([("j/a", b"one"), ("j/a", b"two"), ("j/b", b"x")], "journal string, payload binary").coalesce(1)
    w = lambda **o: rows.write.format("journal").options(path=root, codec="GZIP", **o).mode("append").save()
    w()
    assert journal.write_head([root], "j/a") == 8
    with pytest.raises(Exception, match="not 3"):
        w(expectOffset=3)
    w()
    assert [x[1] for x in read(spark, root, journal="j/a")] == [0, 4, 8, 12]
    assert journal.status(16, [root], "j/a") == "OFFSET_NOT_YET_AVAILABLE" and journal.status(3, [root], "j/a") == "OK"
    assert not [d for d in os.listdir(root) if d.startswith(".spool")]


def test_manifest(spark, store):
    m = {(r.journal, r.begin_offset, r.end_offset, r.codec, r.path_postfix) for r in journal.manifest(spark, [f"file://{store}"]).collect()}
    assert ("a/one", 0, 4, "GZIP", "utc_date=2025-01-01") in m and len(m) == 5


def test_stream_resumes_where_it_stopped(spark, store, tmp_path):
    journal.register(spark)
    check, out = str(tmp_path / "check"), str(tmp_path / "out")

    def drain():
        s = spark.readStream.format("journal").option("path", store).option("journal", "a/two").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted((r.begin_offset, bytes(r.payload)) for r in spark.read.parquet(out).collect())

    assert drain() == [(0, b"x")]
    put(store, "a/two", 2, b"y\nz\n")
    assert drain() == [(0, b"x"), (2, b"y"), (4, b"z")]


def test_filter_and_option_are_intersected(spark, store):
    journal.register(spark)
    r = lambda **o: spark.read.format("journal").options(path=store, **o).load()
    assert r(journal="a/one").where("journal = 'a/two'").count() == 0
    assert r(journals="a/one,a/two").where("journal = 'a/two'").count() == 1
    assert r(journals="a/one").where("journal = 'a/two'").count() == 0
    assert r(prefix="a/o").where("journal = 'a/two'").count() == 0
    assert r(journal="a/two").where("journal = 'a/two'").count() == 1


def test_small_files_share_tasks(spark, tmp_path):
    at = 0
    for i in range(20):
        at = put(str(tmp_path), "j", at, b"%d\n" % i * 10)
    journal.register(spark)
    df = spark.read.format("journal").options(path=str(tmp_path), partitionBytes=100).load()
    assert df.count() == 200 and 4 <= df.rdd.getNumPartitions() <= 10
    assert spark.read.format("journal").options(path=str(tmp_path)).load().rdd.getNumPartitions() == 1


def _writer(root, rows, **options):
    from pyspark.sql.types import StructType

    w = journal.JournalWriter(journal._Options({"path": str(root), **options}), StructType.fromDDL("journal string, payload binary"))
    row = type("Row", (), {})
    made = []
    for j, p in rows:
        r = row()
        r.journal, r.payload = j, p
        made.append(r)
    return w, [w.write(iter(made))]


def heads(root):
    return {f.journal: f.end for f in sorted(journal.list_fragments([str(root)]), key=lambda f: f.end)}


ROWS = [("a", b"one"), ("b", b"two"), ("a", b"three")]


@pytest.mark.parametrize("crash_at", range(6))
def test_a_crash_anywhere_publishes_nothing_or_all(tmp_path, monkeypatch, crash_at):
    """The writer dies at its nth change to the store: what readers see is the state before or after, for all journals."""
    first, spooled = _writer(tmp_path, ROWS)
    first.commit(spooled)
    before = heads(tmp_path)
    w, spooled = _writer(tmp_path, ROWS)
    real, left = journal.filesystem, [crash_at]

    class Dying:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            if name in ("move", "delete_file"):
                if left[0] <= 0:
                    raise SystemExit
                left[0] -= 1
            return getattr(self.store, name)

    monkeypatch.setattr(journal, "filesystem", lambda root: (Dying(real(root)[0]), real(root)[1]))
    with pytest.raises(SystemExit):
        w.commit(spooled)
        raise SystemExit
    monkeypatch.setattr(journal, "filesystem", real)
    after = heads(tmp_path)
    assert after in (before, {j: 2 * n for j, n in before.items()})
    assert (after != before) == (crash_at >= 4)  # intent moved, two files moved, intent deleted
    journal.recover(str(tmp_path), older_than=0)
    assert heads(tmp_path) == after and not list((tmp_path / ".intents").glob("*"))
    again, spooled = _writer(tmp_path, ROWS)
    again.commit(spooled)
    assert heads(tmp_path) == {j: after[j] + before[j] for j in before}


def test_of_two_writers_at_one_offset_one_goes_on(tmp_path, monkeypatch):
    """The other one commits between this one's look at the end and its claim, or claims at the same time."""
    a, of_a = _writer(tmp_path, ROWS)
    b, of_b = _writer(tmp_path, ROWS)
    real = a._heads
    calls = []

    def meanwhile(names):
        out = real(names)
        if not calls:
            calls.append(1)
            b.commit(of_b)
        return out

    monkeypatch.setattr(a, "_heads", meanwhile)
    with pytest.raises(journal.WrongAppendOffset):
        a.commit(of_a)
    assert heads(tmp_path) == {"a": 10, "b": 4}
    c, of_c = _writer(tmp_path, ROWS)
    (tmp_path / ".claims" / "a").mkdir(parents=True, exist_ok=True)
    (tmp_path / ".claims" / "a" / f"{10:016x}.other").touch()
    with pytest.raises(journal.WrongAppendOffset, match="another writer"):
        c.commit(of_c)
    assert heads(tmp_path) == {"a": 10, "b": 4} and not [d for d in os.listdir(tmp_path) if d.startswith(".spool")]


def test_writers_hold_a_bounded_buffer(tmp_path):
    w, spooled = _writer(tmp_path, [(f"j{i % 50}", b"x" * 99) for i in range(1000)], maxFileBytes="5000")
    w.commit(spooled)
    got = heads(tmp_path)
    assert set(got.values()) == {2000} and len(got) == 50
