"""Evaluation texts leaking into training text: which documents carry which held-out items.

1. Each text is decoded, freed of markup and quoting, and folded to plain words.
2. Candidates come from an exact index of short word runs. However the changed words lie, a passage of
   L words of which at most L * `changed` are altered keeps a run of unaltered words of a length
   that `kept_run` computes: four words for passages of 16 words or more, fewer for shorter ones. All such
   runs of the items are indexed and all runs of all documents are looked up, so no passage is missed.
3. A (document, item) pair is verified: a passage of at least `share` of the item must be there in its
   order with at most the `changed` part missing, and what is there must hold `weight` of the
   passage's weight, rare words weighing more. Bounds that hold for every passage sort out most pairs
   beforehand for all items of a document at once.

Why no SimHash of item-sized windows: with one word in five changed, SimHashes of windows of a third of
an item differ in 10 of 64 bits by the median and 16 by the 95th percentile (features words; 17 and
23 with word pairs). Blocks that guarantee such a radius are three or four bits wide and select
every pair of windows, and other items come as near as 15 bits. In windows as short as the runs one
changed word moves half of the bits, so that within any radius with usable blocks there are equal windows only.

The documents are read once a block of items and nothing is shuffled but the result. The items are
the stated query set; they go to the tasks in blocks of about `block_words` words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.mail import readable, unquote

_WORD = re.compile(r"[^\W_]+")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝμνοαικρτυβεηАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwuvoaikptuben" + "abekmhopctyxijsabezhikmnoptyx")
_EPS = 1e-9


def fold(text: str) -> str:
    """Lower case, without accents, invisible characters and look-alikes of other scripts."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.translate(_LOOKALIKE))
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).lower()


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def document_words(text: str | None) -> list[str]:
    """Words of a message: all readable parts, quote marks and line breaks gone."""
    return [w for part in readable(text) for w in words(unquote(part))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: list[str]) -> np.ndarray:
    import xxhash

    coded = pa.array(flat, pa.string()).dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return each[coded.indices.to_numpy()]


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(3) + hashes[k : len(hashes) - n + 1 + k])
    return out


def needed(n: int, share: float) -> int:
    """Words of the shortest passage of an item of n words."""
    return max(1, int(np.ceil(share * n - _EPS)))


def kept_run(n: int, share: float, changed: float) -> int:
    """The longest run of unaltered words which every passage of an item of n words keeps.

    L words with e altered fall into e + 1 runs, the longest of which has at least (L - e) / (e + 1) words.
    """
    alterations = ((size, int(size * changed + _EPS)) for size in range(needed(n, share), n + 1))
    return min(-(-(size - e) // (e + 1)) for size, e in alterations)


class ItemIndex:
    """All kept runs of a block of items, and what verification needs of them."""

    def __init__(self, ids: list, texts: list[list[str]], weights: list[np.ndarray], share: float, changed: float):
        self.ids, self.words, self.weights = ids, texts, weights
        self.need = np.array([needed(len(t), share) for t in texts], np.int64)
        length = [kept_run(len(t), share, changed) for t in texts]
        #: Per run length: sorted hashes of the items' runs, the items they are of, and a filter on 22 bits.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(length)):
            mine = [i for i, x in enumerate(length) if x == n]
            found = [run_hashes(word_hashes(texts[i]), n) for i in mine]
            h = np.concatenate(found)
            item = np.repeat(mine, [len(f) for f in found])
            h, item = np.unique(np.stack([h, item.astype(np.uint64)]), axis=1) if len(h) else (h, item)
            bits = np.zeros(1 << 22, bool)
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
            self.runs[n] = (h, item.astype(np.int64), bits)
        vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.vocabulary = vocabulary
        width = max(map(len, texts), default=0)
        self.length = np.array([len(t) for t in texts], np.int64)
        #: Words of each item as numbers, filled up with one that no document has; their weights.
        self.coded = np.full((len(texts), width), len(vocabulary), np.int32)
        self.weight = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            self.coded[i, : len(t)] = [vocabulary[w] for w in t]
            self.weight[i, : len(t)] = weights[i]

    def lookup(self, hashes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the documents, item) of every shared run. inside[k]: words left in the document from k on."""
        at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (h, item, bits) in self.runs.items():
            run = run_hashes(hashes, n)
            some = np.flatnonzero(bits[(run >> np.uint64(42)).astype(np.int64)])
            some = some[inside[some] >= n]
            lo = np.searchsorted(h, run[some])
            k = np.searchsorted(h, run[some], side="right") - lo
            at.append(np.repeat(some, k))
            of.append(item[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)])
        return np.concatenate(at), np.concatenate(of)

    def possible(self, items: np.ndarray, text: list[str], changed: float, weight: float) -> np.ndarray:
        """Those of `items` of which, by the words alone, text may hold a passage.

        For any passage, words of it in the text are at least as many and weigh at least as much as those in order.
        """
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[[k for w in set(text) if (k := self.vocabulary.get(w)) is not None]] = True
        width = int(self.length[items].max(initial=0))
        there = present[self.coded[items, :width]]
        w, need = self.weight[items, :width], self.need[items]
        ok = np.ones(len(items), bool)
        ends = np.arange(width + 1)[None, :]
        valid = (ends >= need[:, None]) & (ends <= self.length[items][:, None])
        begin = np.maximum(ends - need[:, None], 0)
        for gain in (there - (1 - changed), w * (there - weight)):
            total = np.concatenate([np.zeros((len(items), 1)), np.cumsum(gain, 1)], 1)
            lowest = np.minimum.accumulate(total, 1)
            ok &= (valid & (total - np.take_along_axis(lowest, begin, 1) >= -1e-6)).any(1)
        return items[ok]


def passage(item: list[str], weights: np.ndarray, text: list[str], share: float, changed: float, weight: float) -> bool:
    """Does text hold, in order, a passage of at least `share` of item's words, at most the `changed` part of them altered?

    The words of the passage that text has must also hold the part `weight` of its weight. The longest common
    subsequences of text and all passages from one beginning come from one pass of bit operations.
    """
    n, need = len(item), needed(len(item), share)
    masks: dict[str, int] = {}
    for k, w in enumerate(text):
        masks[w] = masks.get(w, 0) | (1 << k)
    full = (1 << len(text)) - 1
    found = [masks.get(w, 0) for w in item]
    bag = np.array([x != 0 for x in found])
    c = np.concatenate([[0], np.cumsum(bag)])
    cw = np.concatenate([[0], np.cumsum(weights * bag)])
    tw = np.concatenate([[0], np.cumsum(weights)])
    for i in range(n - need + 1):
        j = np.arange(i + need, n + 1)
        fit = j[(c[j] - c[i] >= (1 - changed) * (j - i) - 1e-6) & (cw[j] - cw[i] >= weight * (tw[j] - tw[i]) - 1e-6)]
        if not len(fit):
            continue
        ends, v = set(fit.tolist()), full
        for p in range(i, int(fit[-1])):
            u = v & found[p]
            v = ((v + u) | (v - u)) & full
            if p + 1 in ends and len(text) - v.bit_count() >= (1 - changed) * (p + 1 - i) - 1e-6:
                return True
    return False


def _matches(docs: list[list[str]], index: ItemIndex, share: float, changed: float, weight: float) -> Iterator[tuple[int, int]]:
    """(document, item) positions of a batch of word lists."""
    flat = [w for d in docs for w in d]
    if not flat or not index.ids:
        return
    size = np.array([len(d) for d in docs])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(docs)), size)
    at, item = index.lookup(word_hashes(flat), first[of] + size[of] - np.arange(len(flat)))
    doc = of[at]
    order = np.lexsort((at, item, doc))
    at, item, doc = at[order], item[order], doc[order]
    for k in np.unique(doc):
        a, z = np.searchsorted(doc, [k, k + 1])
        for i in index.possible(np.unique(item[a:z]), docs[k], changed, weight):
            lo, hi = a + np.searchsorted(item[a:z], [i, i + 1])
            hits = at[lo:hi] - first[k]
            reach = len(index.words[i])
            # Places of the document that lie apart are tried apart: a passage has its words close together.
            for cluster in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
                region = docs[k][max(0, cluster[0] - reach) : cluster[-1] + 2 * reach]
                if passage(index.words[i], index.weights[i], region, share, changed, weight):
                    yield int(k), int(i)
                    break


def _scan(index: ItemIndex, doc_name: str, item_type: pa.DataType, share: float, changed: float, weight: float, batch_words: int = 60_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            hits = list(_matches(docs, index, share, changed, weight))
            if hits:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([keys[k] for k, _ in hits])), pa.array([index.ids[i] for _, i in hits], item_type)], names=[doc_name, "item_id"])

        for b in batches:
            docs, keys, size = [], [], 0
            for at in range(b.num_rows):
                if w := document_words(b.column(1)[at].as_py()):
                    docs.append(w)
                    keys.append(at)
                    size += len(w)
                if size > batch_words:
                    yield from flush()
                    docs, keys, size = [], [], 0
            yield from flush()

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text", share: float = 1 / 3, changed: float = 0.2, weight: float = 0.6, block_words: int = 1_000_000) -> DataFrame:
    """id_col, item_id: each document with each item of which it carries a passage.

    The words of a passage must lie within the item's length of a run they share with it. A word weighs
    the square of the log of how rare it is among the items; if all words of an item are common to all items, order
    and number alone decide. Null, empty and blank texts leak nothing, nor do items without a word
    or with a null id or text; items of equal text are found together, and of several texts with one id
    each counts. A repeated document row counts once. Other columns are ignored. Any number of items
    is taken, in as many passes over the documents as they have blocks of `block_words` words.
    """
    id_type, key = items.schema[item_col].dataType, docs.schema[id_col]
    parsed = T.StructType([T.StructField("item_id", id_type), T.StructField("words", T.ArrayType(T.StringType()))])
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).dropna().dropDuplicates()
    texts = rows.mapInArrow(_words_of, parsed).where("size(words) > 0")
    total = texts.agg(F.sum(F.size("words")), F.count("*")).first()
    n_words, n_items = total[0] or 0, total[1]
    blocks = max(1, -(-n_words // block_words))
    frequency = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    out = T.StructType([T.StructField(id_col, key.dataType), T.StructField("item_id", id_type)])
    source = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null")
    result = None
    for k in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k)
        mine = sorted(((r.item_id, r.words) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))
        known = block.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
        idf = {r.word: float(np.log((1 + n_items) / r["count"])) ** 2 for r in known.collect()}
        index = ItemIndex([i for i, _ in mine], [t for _, t in mine], [np.array([idf[w] for w in t]) for _, t in mine], share, changed)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            yield from _scan(shared.value, id_col, to_arrow_type(id_type), share, changed, weight)(batches)

        found = source.mapInArrow(run, out)
        result = found if result is None else result.unionByName(found)
    return result.dropDuplicates()
