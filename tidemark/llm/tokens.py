"""Encode a corpus with a public byte-level BPE tokenizer, and decode it again.

A text of at most `chunk_chars` is encoded in one call. A longer one is cut into overlapping
chunks, spread over the cluster and pre-tokenised in parallel. A chunk that begins in the middle of
a word has wrong boundaries at first; but since the pre-token pattern looks at nothing to the left
of a match, from the first boundary on which both neighbours agree within their overlap their
boundaries are the same. Each seam is moved to that place, and each piece between two seams is
encoded alone. A text with a seam at which its chunks never agree (one token longer than the
overlap) is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, width

#: Fixed value: how texts are split before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary, by path; where a machine has no such file, the one of that name among spark.files is taken.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    if not os.path.exists(ranks):  # shipped with spark.files or addFile
        from pyspark import SparkFiles

        ranks = SparkFiles.get(os.path.basename(ranks))
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), {v: k for k, v in merges.items()}


def _encode(ranks: str, pattern: str):
    """Batches (key..., text) -> (key..., ids). Null and empty texts give empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks, pattern)[0]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = [enc.encode_ordinary(t) if t else [] for t in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """(doc, text) -> (doc, row, chunk_no, last, piece); row tells repeated ids apart."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 64):
                    own = starts[first : first + 64]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([b.column(0).slice(i, 1)] * n),
                            pa.array([row] * n, pa.int64()),
                            pa.array(range(first, first + n), pa.int32()),
                            pa.array([s == starts[-1] for s in own]),
                            pa.array([text[s : s + chunk + overlap] for s in own]),
                        ],
                        names=["doc", "row", "chunk_no", "last", "piece"],
                    )
                row += 1

    return run


def _boundaries(chunk: int, overlap: int, pattern: str):
    """Adds head and tail: offsets of pre-token boundaries in the overlaps with the chunks before and after.

    Only boundaries after a visible character count: there the text before can be encoded alone,
    as no white space is left whose split depends on what follows. The last token of a cut chunk
    may go on, so its end does not count.
    """
    import regex

    find = regex.compile(pattern)

    def run(batches):
        for b in batches:
            heads, tails = [], []
            for last, piece in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ends = [m.end() for m in find.finditer(piece)]
                if not last and ends:
                    ends.pop()
                ends = [e for e in ends if not piece[e - 1].isspace()]
                heads.append([e for e in ends if e < overlap])
                tails.append([] if last else [e - chunk for e in ends if chunk <= e])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*b.schema.names, "head", "tail"])

    return run


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, ranks: str = RANKS, pattern: str = PATTERN, chunk_chars: int = 8192, overlap: int = 512) -> DataFrame:
    """id_col, ids: one row per row of docs, the token ids of its text.

    Null and empty texts give an empty list; blank ones their white-space tokens; strings of
    special tokens are ordinary text. A row whose id is null or repeated gets its own row. Other
    columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode(ranks, pattern), out)
    cut = T.StructType([T.StructField("doc", kind), *T._parse_datatype_string("row bigint, chunk_no int, last boolean, piece string").fields])
    found = T.StructType([*cut.fields, *T._parse_datatype_string("head array<int>, tail array<int>").fields])
    chunks = rows.where(is_long).mapInArrow(_cut(chunk_chars, overlap), cut)
    pieces = materialize(chunks.repartition(width(spark), "row", "chunk_no").mapInArrow(_boundaries(chunk_chars, overlap, pattern), found), "token-chunks")
    order = Window.partitionBy("row").orderBy("chunk_no")
    # Seams need only the short lists of offsets; the texts stay where they are.
    seams = pieces.select("row", "chunk_no", "last", "tail", F.lead("head").over(order).alias("next"))
    seams = seams.withColumn("seam", F.array_min(F.array_intersect("tail", "next")))
    seams = seams.withColumn("from", F.lag("seam").over(order))
    broken = seams.where("not last and seam is null").select("row").distinct()
    ranges = seams.select("row", "chunk_no", F.coalesce("from", F.lit(0)).alias("from"), F.when(F.col("last"), 2**31 - 1).otherwise(F.col("seam") + chunk_chars).alias("to"))
    sound = pieces.join(ranges.join(broken, "row", "left_anti"), ["row", "chunk_no"]).select("doc", "row", "chunk_no", F.expr("substring(piece, from + 1, to - from)").alias("text"))
    some = T.StructType([*T._parse_datatype_string("row bigint, chunk_no int").fields, T.StructField("doc", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    coded = sound.select("row", "chunk_no", "doc", "text").mapInArrow(_encode(ranks, pattern), some)
    joined = coded.groupBy("row").agg(F.first("doc").alias(id_col), F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))).alias("parts"))
    stitched = joined.select(id_col, F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
    # Whole texts whose chunks never agreed, put together again from the chunks' own parts.
    parts = pieces.join(broken, "row").select("row", "doc", "chunk_no", F.substring("piece", 1, chunk_chars).alias("piece"))
    whole = parts.groupBy("row").agg(F.first("doc").alias(id_col), F.array_sort(F.collect_list(F.struct("chunk_no", "piece"))).alias("parts"))
    whole = whole.select(id_col, F.array_join(F.transform("parts", lambda p: p.piece), "").alias("text")).mapInArrow(_encode(ranks, pattern), out)
    return short.unionByName(stitched).unionByName(whole)


def decode_corpus(coded: DataFrame, id_col: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """id_col, text: the texts of lists of ids. The raw bytes of the tokens are joined before they are read as UTF-8."""
    out = T.StructType([T.StructField(id_col, coded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        raw = _encoding(ranks, pattern)[1]
        for b in batches:
            texts = [b"".join(map(raw.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, "ids").mapInArrow(run, out)
