"""Ranked lexical search: the terms of all items in one Aho-Corasick automaton that scans texts.

Each term stands in the automaton with a guard on both sides, so that it only
matches whole terms of a text whose other characters have become single guards'
places. A scan counts how often each item term occurs in a document, without any
index of the documents; an array maps terms to the items that hold them, so one
scan serves all items of a block.

Weights need document counts, so a scan writes down what it found (per document its
length and the counts of item terms, and per task the sums) before scores are
computed. A task keeps the best of its own documents for each item; only these are
shuffled.
"""

from __future__ import annotations

import math
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ALNUM_LOWER, slices, stage, union_all

#: Bytes of item texts whose terms are broadcast at once; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20
#: Score cells, and entries of terms by item, that a task holds at once.
CELLS, ENTRIES = 1 << 21, 1 << 20
#: Candidates that a task holds before it sorts them out.
CANDIDATES = 1 << 18
#: Parts in which an item's candidates are sorted out before they meet.
SALTS = 32

#: Fixed values of the ranking.
SHARE, SCALE, STEEP, UNIT = 75, 1_000_000_000, 8, 1000


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(ALNUM_LOWER).split()


class Terms:
    """The terms of a block of items: ``items[begin[t]:begin[t + 1]]`` hold term ``t``, each ``times`` times."""

    def __init__(self, texts: list[bytes]):
        counted: dict[bytes, dict[int, int]] = {}
        for i, text in enumerate(texts):
            for t in terms_of(text):
                of = counted.setdefault(t, {})
                of[i] = of.get(i, 0) + 1
        self.terms, self.n_items = list(counted), len(texts)
        self.begin = np.cumsum([0, *(len(x) for x in counted.values())])
        self.items = np.fromiter(chain.from_iterable(counted.values()), np.int64, int(self.begin[-1]))
        self.times = np.fromiter(chain.from_iterable(x.values() for x in counted.values()), np.int64, int(self.begin[-1]))


_last: list = []


def _automaton(terms: list[bytes]):
    """The guarded automaton of a broadcast list of terms; a worker process keeps the last one."""
    import ahocorasick

    if not _last or _last[0] is not terms:
        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(f" {t.decode()} ", i)
        a.make_automaton()
        _last[:] = terms, a
    return _last[1]


def scan(docs: DataFrame, block: Terms) -> DataFrame:
    """What a block's terms count in every document: ``doc_id, n, terms, counts``, and one row for each task: ``df, docs, words``.

    ``terms`` and ``counts`` are packed 32-bit numbers. Documents without a term are
    in no row and in no count.
    """
    sent = docs.sparkSession.sparkContext.broadcast(block.terms)  # a block's bound
    most = len(block.terms)

    def run(batches):
        a = _automaton(sent.value) if most else None
        df, n_docs, n_words = np.zeros(most, np.int64), 0, 0
        for batch in slices(batches):
            found, upto, sizes = [], [0], []
            for text in batch.column("text"):
                data = (text.as_py() or b"").translate(ALNUM_LOWER)
                inside = np.zeros(len(data) + 1, np.int8)
                inside[1:] = np.frombuffer(data, np.uint8) != 0x20
                sizes.append(int(np.count_nonzero(inside[1:] > inside[:-1])))
                if a is not None and sizes[-1]:
                    found.extend(map(itemgetter(1), a.iter(f" {data.decode()} ")))
                upto.append(len(found))
            rows = np.repeat(np.arange(len(sizes)), np.diff(upto))
            key, counts = np.unique(rows * max(most, 1) + np.array(found, np.int64), return_counts=True)
            terms = key % max(most, 1)
            cut = np.searchsorted(key, np.arange(len(sizes) + 1) * max(most, 1))
            df += np.bincount(terms, minlength=most)
            n_docs, n_words = n_docs + int(np.count_nonzero(sizes)), n_words + sum(sizes)
            some = [i for i, n in enumerate(sizes) if n]
            packed = [pa.array([x[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in some], pa.binary()) for x in (terms, counts)]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array([sizes[i] for i in some], pa.int64()), *packed, pa.nulls(len(some), pa.list_(pa.int64())), none, none], names)
        one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n_docs], pa.int64()), pa.array([n_words], pa.int64())]
        yield pa.RecordBatch.from_arrays(one, names)

    names = ["doc_id", "n", "terms", "counts", "df", "docs", "words"]
    return docs.mapInArrow(run, "doc_id long, n long, terms binary, counts binary, df array<long>, docs long, words long")


class Best:
    """The ``k`` best documents of each item: highest score, then least id, null first."""

    def __init__(self, k: int, n_items: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.held = [np.empty(0, np.int64) for _ in range(4)]  # item, score, has an id, id
        self.new: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.new.append((item, scores[row, item], known[row], ids[row]))
        self.count += len(row)
        if self.count > CANDIDATES:
            self.trim()

    def trim(self) -> None:
        item, score, known, ids = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, known, -score, item))
        item, score, known, ids = item[order], score[order], known[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[item[last]] = score[last]
        self.held, self.new, self.count = [item[keep], score[keep], known[keep], ids[keep]], [], 0


def _tops(found: DataFrame, block: Terms, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``item`` (its place in the block), ``doc_id, score``: the best of each task's documents."""
    sent = found.sparkSession.sparkContext.broadcast((block.begin, block.items, block.times, weights))  # a block's bound
    n_items = block.n_items
    step = max(1, min(256, CELLS // n_items))

    def run(batches):
        begin, items, times, w = sent.value
        best = Best(k, n_items)
        for batch in slices(batches, step):
            t, tf = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("terms", "counts"))
            row = np.repeat(np.arange(batch.num_rows), [len(x) // 4 for x in batch.column("terms").to_pylist()])
            m = 100 - SHARE + SHARE * batch.column("n").to_numpy() * n_docs // n_words
            value = w[t] * (SCALE * tf // (UNIT * tf + STEEP * m[row]))
            scores = np.zeros(batch.num_rows * n_items, np.int64)
            size = begin[t + 1] - begin[t]
            upto = np.cumsum(size)
            lo = 0
            while lo < len(t):  # as many terms at once as their items allow
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ENTRIES, "right")))
                n, total = size[lo:hi], int(size[lo:hi].sum())
                at = np.repeat(begin[t[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(total)
                np.add.at(scores, np.repeat(row[lo:hi] * n_items, n) + items[at], np.repeat(value[lo:hi], n) * times[at])
                lo = hi
            ids = batch.column("doc_id")
            best.add(scores.reshape(-1, n_items), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy())
        best.trim()
        item, score, known, ids = best.held
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=known == 0), pa.array(score)], ["item", "doc_id", "score"])

    return found.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, bytes_: int) -> DataFrame:
    """``items`` with ``block``: dealt by hash, finer until no block has more than ``bytes_`` unless it is one item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = 1 if total <= bytes_ else -(-2 * total // bytes_)
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
        over = dealt.groupBy("block").agg(F.sum(size).alias("size"), F.count("*").alias("n")).filter((F.col("size") > bytes_) & (F.col("n") > 1))
        if over.isEmpty():
            return dealt
        parts *= 2


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    Items are taken in blocks of bounded size; all documents are scanned for each
    block. Rows are documents and items of their own, also if they share an id;
    null and empty texts have no terms and are no documents, items without terms
    get no rows; a null document id comes before others. Equal scores follow the
    document id. Further columns of either table are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    t = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    t = stage(_blocks(stage(t, "items"), block_bytes), "item-blocks")
    kind = t.schema["item_id"].dataType.simpleString()
    out = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for b in [r.block for r in t.select("block").distinct().orderBy("block").collect()]:  # a number for each BLOCK_BYTES of items
        rows = t.filter(F.col("block") == b).orderBy("item").select("item", "text").collect()  # a block's bound
        block = Terms([r.text for r in rows])
        found = stage(scan(d, block), "scanned")
        n_docs, n_words = (x or 0 for x in found.agg(F.sum("docs"), F.sum("words")).first())
        if not n_docs or not block.terms:
            continue
        df = np.zeros(len(block.terms), np.int64)
        counted = found.filter("df is not null").select(F.posexplode("df").alias("term", "n")).filter("n > 0").groupBy("term").agg(F.sum("n").alias("n"))
        for r in counted.toArrow().to_pylist():  # a row for each of the block's terms
            df[r["term"]] = r["n"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        tops = _tops(found.filter("n is not null"), block, weights, n_docs, n_words, k)
        best = [F.desc("score"), F.asc_nulls_first("doc_id")]
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        tops = tops.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*best))).filter(F.col("rank") <= k)
        tops = tops.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)  # ``k`` of each salt at most
        of = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], "item long, row long")
        named = of.join(t.select(F.col("item").alias("row"), "item_id"), "row")
        out.append(tops.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return union_all(out)
