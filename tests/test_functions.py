from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions import mapping, names, uuids
from tidemark.functions.checksums import crc32c_update, crc64, crc64_update
from tidemark.functions.ngrams import ngrams

#: Key, its partition of 443 by modulo, its partition of 400 by rendezvous.
MAPPED = [("It always", 119, 21), ("seems", 54, 179), ("impossible", 308, 50), ("until", 97, 13), ("it is done.", 179, 337), ("- Nelson Mandela", 437, 29), ("Shall I compare", 84, 110), ("thee to", 300, 395), ("a summer's day?", 214, 192), ("Thou art more", 135, 394), ("lovely and more", 118, 344), ("temperate - Shakespeare", 228, 75)]


def parts(n):
    return [f"a/topic/part-{i:03d}" for i in range(n)]


def test_mappings(spark):
    df = spark.createDataFrame(MAPPED, "key string, m int, r int")
    got = df.select("m", "r", mapping.modulo("key", parts(443)).alias("modulo"), mapping.rendezvous("key", parts(400)).alias("rendezvous")).collect()
    for r in got:
        assert r.modulo == f"a/topic/part-{r.m:03d}"
        assert r.rendezvous == f"a/topic/part-{r.r:03d}"


def test_rendezvous_is_stable_as_partitions_are_added(spark):
    df = spark.createDataFrame(MAPPED, "key string, m int, r int")
    few, many = (df.select(mapping.rendezvous("key", parts(n)).alias("p")).collect() for n in (400, 500))
    assert all(a == b or b.p > "a/topic/part-399" for a, b in zip(few, many))


def test_fnv_of_empty_null_and_multibyte(spark):
    df = spark.createDataFrame([("",), (None,), ("üñ漢",)], "k string")
    assert [r[0] for r in df.select(mapping.fnv1a("k")).collect()] == [mapping.OFFSET, None, mapping.fnv1a_python("üñ漢".encode())]


def test_no_partitions():
    with pytest.raises(ValueError, match="no partitions"):
        mapping.modulo("k", [])


def test_uuid_roundtrip(spark):
    rows = [("01aabbccddee", (uuids.EPOCH_TICKS + 17_000_000_000_000_123) << 4 | c, f) for c in (0, 9, 15) for f in (0, 1, 2, 0x3FF)]
    df = spark.createDataFrame(rows, "p string, c bigint, f int").withColumn("u", uuids.build(F.col("p"), F.col("c"), F.col("f")))
    got = df.select(uuids.producer("u"), uuids.clock("u"), uuids.flags("u"), F.col("u")).collect()
    assert [tuple(r)[:3] for r in got] == rows
    assert all(r.u[14] == "1" and r.u[19] in "89ab" for r in got)


def test_flags_are_limited(spark):
    with pytest.raises(Exception, match="10 bits"):
        spark.range(1).select(uuids.build(F.lit("0" * 12), F.lit(0).cast("long"), F.lit(0x400))).collect()


def test_clock(spark):
    r = spark.range(1).select(uuids.tick(uuids.tick(F.lit(0))).alias("two"), uuids.as_time(uuids.clock_of(F.lit(12_000_000))).cast("timestamp_ntz").cast("string").alias("t"), uuids.update(F.lit(10**18), F.lit(0)).alias("up")).first()
    assert (r.two, r.t) == (320, "1970-01-01 00:00:12")
    assert r.up == max(10**18, uuids.EPOCH_TICKS << 4)


#: Label sets and whether the selector below matches them.
CASES = [
    ([], False),
    ([("inc-1", "a-val/a/1"), ("inc-2", "any"), ("inc-3", "val-1")], True),
    ([("inc-1", "a-val/b/2"), ("inc-2", "foo"), ("inc-3", "val-1")], True),
    ([("inc-1", "a-val/c/3"), ("inc-2", "any"), ("inc-3", "val-2")], True),
    ([("inc-1", "bad-val/4"), ("inc-2", "any"), ("inc-3", "val-1")], False),
    ([("inc-1", "a-val/5"), ("inc-3", "val-1")], False),
    ([("inc-1", "a-val/6"), ("inc-2", "any"), ("inc-3", "val-other")], False),
    ([("exc-1", "any"), ("inc-1", "a-val/a/7"), ("inc-2", "any"), ("inc-3", "val-1")], False),
    ([("exc-2", "val-4"), ("inc-1", "a-val/8"), ("inc-2", "any"), ("inc-3", "val-1")], False),
    ([("exc-2", "val-ok"), ("inc-1", "a-val/9/9"), ("inc-2", "any"), ("inc-3", "val-1")], True),
]
SELECTOR = "inc-1:prefix=a-val/, inc-2, inc-3 in (val-1, val-2), !exc-1, exc-2 notin (val-3,val-4)"


def test_selector(spark):
    df = spark.createDataFrame([(c, e) for c, e in CASES], f"labels {lb.LABELS}, expected boolean")
    assert [r[0] for r in df.select(lb.matches("labels", SELECTOR) == F.col("expected")).collect()] == [True] * len(CASES)
    only_exclude = df.select(lb.matches("labels", "!exc-1, exc-2 not in (val-3, val-4)")).collect()
    assert [r[0] for r in only_exclude] == [True] * 7 + [False, False, True]


@pytest.mark.parametrize(
    ("text", "include", "exclude"),
    [
        ("foo = bar", {"foo": ["bar"]}, {}),
        ("foo:prefix =bar", {"foo:prefix": ["bar"]}, {}),
        ("foo != bar", {}, {"foo": ["bar"]}),
        ("foo ", {"foo": [""]}, {}),
        (" !foo", {}, {"foo": [""]}),
        (" foo in (bing, baz,bar)", {"foo": ["bing", "baz", "bar"]}, {}),
        (" foo not in ( pear, apple )", {}, {"foo": ["pear", "apple"]}),
        ("foo==bar, baz !=bing ,apple:prefix in (fruit, banana)", {"foo": ["bar"], "apple:prefix": ["fruit", "banana"]}, {"baz": ["bing"]}),
        ("!foo,baz,bing:prefix not in (thing-one, thing-2),!bar,", {"baz": [""]}, {"foo": [""], "bing:prefix": ["thing-one", "thing-2"], "bar": [""]}),
        ("foo = ba=ar, baz=bi=ngo,exc!=who=ops", {"foo": ["ba=ar"], "baz": ["bi=ngo"]}, {"exc": ["who=ops"]}),
        ("foo in (bi=ng,ba=ar), exc notin (who=ops,oth=er)", {"foo": ["bi=ng", "ba=ar"]}, {"exc": ["who=ops", "oth=er"]}),
    ],
)
def test_selector_parsing(text, include, exclude):
    sel = lb.parse_selector(text)
    assert (sel.include, sel.exclude) == (include, exclude)
    again = lb.parse_selector(str(sel))
    assert {k: sorted(v) for k, v in again.include.items()} == {k: sorted(v) for k, v in include.items()}
    assert {k: sorted(v) for k, v in again.exclude.items()} == {k: sorted(v) for k, v in exclude.items()}


@pytest.mark.parametrize("text", ["foo bar", "a", "foo in", "=x", "foo = b ar"])
def test_bad_selectors(text):
    with pytest.raises(ValueError, match="no selector"):
        lb.parse_selector(text)


def test_label_algebra(spark):
    a = [("aa", "1"), ("bb", "1"), ("bb", "2"), ("cc", "")]
    b = [("bb", "1"), ("bb", "2"), ("cc", "x"), ("dd", "9")]
    r = spark.createDataFrame([(a, b)], f"a {lb.LABELS}, b {lb.LABELS}").select(lb.union(F.col("a"), F.col("b")).alias("u"), lb.intersect(F.col("a"), F.col("b")).alias("i"), lb.subtract(F.col("a"), F.col("b")).alias("s"), lb.set_value(F.col("a"), "bb", "z").alias("v"), lb.problems(F.col("a")).alias("p")).first()
    plain = lambda x: [tuple(y) for y in x]
    assert plain(r.u) == [*a, ("dd", "9")]
    assert plain(r.i) == [("bb", "1"), ("bb", "2")]
    assert plain(r.s) == [("aa", "1"), ("cc", "")]
    assert plain(r.v) == [("aa", "1"), ("bb", "z"), ("cc", "")]
    assert r.p == []


def test_label_problems(spark):
    rows = [([("a", "1")],), ([("bb", "x y")],), ([("bb", "2"), ("bb", "1")],), ([("bb", ""), ("bb", "1")],)]
    got = spark.createDataFrame(rows, f"s {lb.LABELS}").select(lb.problems(F.col("s"))).collect()
    assert [r[0] for r in got] == [["name"], ["value"], ["order"], ["mixed"]]


def test_fragment_names(spark):
    name = "a=1/b=2/00000000499602d2-7fffffffffffffff-0102030405060708090a0b0c0d0e0f1011121314.gz"
    bad = ["x", "0-1-2.gz", name.replace(".gz", ".rar"), "5-3-" + "0" * 40 + ".gz", "0-8000000000000000-" + "0" * 40]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [name, *bad]], "n string").select(names.parse_content_path(F.col("n"))).collect()]
    assert got[0].asDict() == {"path_postfix": "a=1/b=2", "begin_offset": 1234567890, "end_offset": 2**63 - 1, "frag_sum": bytearray(range(1, 21)), "codec": "GZIP"}
    assert got[1:] == [None] * len(bad)


def test_journal_names(spark):
    rows = [("a/b;c;d", "a/b", ";c;d", False), ("good/name", "good/name", "", True), ("/rooted", "/rooted", "", False), ("a/../b", "a/../b", "", False), ("abc", "abc", "", False)]
    df = spark.createDataFrame(rows, "n string, s string, m string, ok boolean")
    got = df.select(names.strip_meta(F.col("n")) == F.col("s"), names.meta(F.col("n")) == F.col("m"), names.is_journal(F.col("n")) == F.col("ok")).collect()
    assert all(all(r) for r in got)
    r = spark.range(1).select(names.rewrite_path(F.lit("a/b/b"), "/b", "/.*"), names.rewrite_path(F.lit("a"), "z", "y"), names.date_postfix(F.lit("2025-03-01 07:08:09").cast("timestamp"))).first()
    assert tuple(r) == ("a/.*/b", "a", "utc_date=2025-03-01/utc_hour=07")


def test_checksums(spark):
    assert crc64_update(0, b"battery horse") == 0xAE763109C1192ED6
    assert crc64_update(crc64_update(0, b"battery"), b" horse") == 0xAE763109C1192ED6
    assert crc64_update(0, b"battery") == 0x2BE55FC66A381C84
    assert crc32c_update(0, b"123456789") == 0xE3069283
    df = spark.createDataFrame([(b"battery",), (None,), (b"",)], "b binary")
    assert [r[0] for r in df.select(crc64("b")).collect()] == ["2be55fc66a381c84", None, "0" * 16]


def test_ngrams(spark):
    text = "How much wood would a wood chuck chuck if a wood chuck could chuck wood?"
    df = spark.createDataFrame([(text,), ("",), (None,), ("123 !",)], "t string")
    grams = [r[0] for r in df.select(ngrams(F.col("t"), 2)).collect()]
    assert len(grams[0]) == 17
    assert [grams[0].count(g) for g in ("START how", "wood chuck", "chuck chuck", "a wood", "wood END", "wood would", "END END")] == [1, 2, 1, 2, 1, 1, 1]
    assert grams[1] == grams[3] == ["START END", "END END"] and grams[2] is None


def test_long_checksums_against_byte_by_byte():
    import random

    from tidemark.functions import checksums as ck

    rnd = random.Random(2)
    for n in (1024, 1025, 4096, 5000, 70_001):
        data = rnd.randbytes(n)
        for update, start in ((ck.crc64_update, rnd.getrandbits(64)), (ck.crc32c_update, rnd.getrandbits(32)), (ck.crc64_update, 0)):
            slow = start
            for at in range(0, n, 1000):  # pieces below the size from which the wide way is taken
                slow = update(slow, data[at : at + 1000])
            assert update(start, data) == slow
    assert ck.crc32c_update(0, b"123456789") == 0xE3069283


def test_varints(spark):
    from tidemark.functions import varint
    from tidemark.sources.framing import _put_varint

    values = [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1, -1, -(2**63)]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint").withColumn("e", varint.encode("v")).withColumn("d", varint.decode("e")).collect()
    assert [r.d for r in got] == [*values, None] and got[-1].e is None
    assert [bytes(r.e) for r in got[:-1]] == [_put_varint(v % 2**64) for v in values]
    odd = spark.createDataFrame([(b"",), (b"\x80",), (b"\x05\xff",), (b"\xff" * 11,), (None,)], "e binary").select(varint.decode("e").alias("d"))
    assert [r.d for r in odd.collect()] == [None, None, 5, None, None]
