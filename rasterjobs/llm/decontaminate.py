"""Benchmark decontamination by winnowing.

A shared run of ``n`` words holds ``n - k + 1`` k-grams, and winnowing over
windows of that many keeps at least one of them on both sides. So joining kept
fingerprints finds every document that may hold a window of an item. A hit is
extended inside its document to the windows around it, and only those that some
item holds are taken on: they go to all tasks if their size, which the items
bound, allows that, else to their documents by a join. There words are compared
one by one. A fingerprint that many documents and items share so makes no pairs of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, BROADCAST_BYTES, BROADCAST_ROWS, ngram_hashes, slices, small, stage, text_words, winnow

#: Most fingerprints of test items that are sent to tasks as one sorted array (8 MiB).
MOST_PRINTS = 1 << 20


def item_words(text: bytes | None) -> list[bytes]:
    """Lower-case words: runs of digits, letters and non-ASCII characters."""
    return (text or b"").translate(ALNUM_LOWER).split()


def _among(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in ``values``, which are sorted and at least one."""
    return values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h


def _prints(words: np.ndarray, n: int, k: int, lengths: list[int]):
    """``(length, fingerprints, where they begin)``: winnowed k-grams stand under ``n``, whole runs under their length."""
    if len(words) >= n:
        grams = ngram_hashes(words, k)
        at = winnow(grams, n - k + 1)
        yield n, grams[at], at
    for m in lengths:
        runs = ngram_hashes(words, m)
        yield m, runs, np.arange(len(runs))


def _item_prints(items: DataFrame, n: int, k: int) -> DataFrame:
    """Fingerprints of each item; one of fewer than ``n`` words has one, of all its words."""

    def run(batches):
        for batch in slices(batches):
            lengths, hashes = [], []
            for (words,) in text_words(batch.column("text"), ALNUM_LOWER):
                for m, h, _ in _prints(words, n, k, [len(words)] if 0 < len(words) < n else []):
                    h = np.unique(h)
                    lengths.append(np.full(len(h), m, np.int32))
                    hashes.append(h)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lengths)), pa.array(np.concatenate(hashes).view(np.int64))], ["len", "hash"])

    return items.select("text").mapInArrow(run, "len int, hash long").distinct()


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """``len, window, words, items``: each window that items hold once, its hash and the items that hold it."""

    def run(batches):
        for batch in slices(batches):
            lengths, windows, grams, names = [], [], [], []
            for text, item, (words,) in zip(batch.column("text"), batch.column("item").to_pylist(), text_words(batch.column("text"), ALNUM_LOWER), strict=True):
                size = min(n, len(words))
                w = item_words(text.as_py())
                new = {b" ".join(w[i : i + size]): h for i, h in enumerate(ngram_hashes(words, size).view(np.int64).tolist())} if size else {}
                lengths += [size] * len(new)
                windows += new.values()
                grams += new
                names += [item] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(windows, pa.int64()), pa.array(grams, pa.binary()), pa.array(names, pa.string())], ["len", "window", "words", "item"])

    rows = items.mapInArrow(run, "len int, window long, words binary, item string")
    return rows.groupBy("len", "window", "words").agg(F.collect_set("item").alias("items"))


def _near_windows(docs: DataFrame, id_type: str, n: int, k: int, lengths: list[int], keep) -> DataFrame:
    """``id, len, hash, window``: a document's fingerprints, each with the hashes of the windows around it."""

    def run(batches):
        for batch in slices(batches):
            counts, sizes, hashes, windows = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for (words,) in text_words(batch.column("text"), ALNUM_LOWER):
                count = 0
                for m, h, at in _prints(words, n, k, lengths):
                    if keep is not None:
                        held = _among(h, keep.value)
                        h, at = h[held], at[held]
                    if not len(h):
                        continue
                    around = ngram_hashes(words, m)
                    begins = at[:, None] - np.arange(n - k + 1 if m == n else 1)
                    inside = (begins >= 0) & (begins < len(around))
                    h, w = np.broadcast_to(h[:, None], begins.shape)[inside], around[begins[inside]]
                    order = np.lexsort((w, h))
                    h, w = h[order], w[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
                    hashes.append(h[new])
                    windows.append(w[new])
                    sizes += [m] * int(new.sum())
                    count += int(new.sum())
                counts.append(count)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(sizes, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(windows).view(np.int64))], ["id", "len", "hash", "window"])

    return docs.mapInArrow(run, f"id {id_type}, len int, hash long, window long")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, k: int = 5) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``items`` (ids, sorted as strings).

    A window is ``n`` consecutive words of an item, or all words of a shorter
    one; every document word inside an occurrence of a window is hit. Null and
    empty texts have no words and no hits; items without words have no window;
    an item without an id still hits but is not listed. Repeated document rows
    give repeated rows; further columns of either table are ignored. A long
    document is one row of work and needs memory for its words only.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    t = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").cast("binary").alias("text"))
    t = stage(t, "items")
    test = stage(_item_prints(t, n, k), "item-prints")
    lengths = sorted(r.len for r in test.filter(F.col("len") < n).select("len").distinct().collect())  # at most n - 1
    prints = test.select("hash").distinct()
    keep = None
    if 0 < prints.limit(MOST_PRINTS + 1).count() <= MOST_PRINTS:
        keep = spark.sparkContext.broadcast(np.sort(prints.toArrow()["hash"].to_numpy().view(np.uint64)))

    id_type = d.schema["id"].dataType.simpleString()
    near = _near_windows(d, id_type, n, k, lengths, keep).join(small(test), ["len", "hash"], "left_semi")
    near = stage(near.select("id", "len", "window").distinct(), "near-windows")
    windows = _item_windows(t, n).join(small(near.select("len", "window").distinct()), ["len", "window"], "left_semi")
    windows = stage(windows, "item-windows")
    size = windows.agg(F.count("*").alias("rows"), F.sum(F.length("words") + F.length(F.array_join("items", ","))).alias("bytes")).first()
    if size.rows <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        both, held = d, spark.sparkContext.broadcast(windows.toArrow().to_struct_array().combine_chunks())
    else:
        found = near.join(windows, ["len", "window"]).groupBy("id").agg(F.collect_list(F.struct("len", "window", "words", "items")).alias("windows"))
        both, held = d.join(small(stage(found.withColumnRenamed("id", "cid"), "candidates")), F.col("id").eqNullSafe(F.col("cid")), "left").select("id", "text", "windows"), None

    def verify(batches):
        known = _by_length(held.value) if held else None
        for batch in slices(batches):
            words, hits, names = [], [], []
            near = [None] * batch.num_rows if held else batch.column("windows")
            for text, (hashes,), x in zip(batch.column("text"), text_words(batch.column("text"), ALNUM_LOWER), near, strict=True):
                hit, which = _extend(text, hashes, known if held else _by_length(x.values))
                words.append(len(hashes))
                hits.append(hit)
                names.append(which)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["id", "n_words", "n_hit", "items"])

    out = both.mapInArrow(verify, f"id {id_type}, n_words long, n_hit long, items array<string>")
    return out.withColumnRenamed("id", doc_id)


def _by_length(windows: pa.StructArray | None) -> dict[int, tuple[np.ndarray, pa.Array, pa.Array]]:
    """Windows by their number of words: their hashes, sorted, and in this order their words and the items that hold them.

    All stay Arrow arrays: as Python objects they would take many times their bytes in each task.
    """
    if not windows:
        return {}
    sizes, hashes = windows.field("len").to_numpy(), windows.field("window").to_numpy().view(np.uint64)
    out = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        rows = rows[np.argsort(hashes[rows], kind="stable")]
        out[size] = hashes[rows], windows.field("words").take(pa.array(rows)), windows.field("items").take(pa.array(rows))
    return out


def _extend(text: pa.Scalar, hashes: np.ndarray, windows: dict) -> tuple[int, list[str]]:
    """Words of a document inside ``windows`` and the items that hold these; where hashes agree, words are compared one by one."""
    hit = np.zeros(len(hashes), bool)
    named: set[str] = set()
    words = None
    for size, (values, known, items) in windows.items():
        seen = set()
        own = ngram_hashes(hashes, size)
        at = np.flatnonzero(_among(own, values))
        first, last = (np.searchsorted(values, own[at], side).tolist() for side in ("left", "right"))
        for i, lo, hi in zip(at.tolist(), first, last, strict=True):
            words = item_words(text.as_py()) if words is None else words
            window = b" ".join(words[i : i + size])
            for row in range(lo, hi):  # more than one only where different windows share a hash
                if known[row].as_py() == window:
                    hit[i : i + size] = True
                    seen.add(row)
        for row in seen:
            named.update(items[row].as_py())
    return int(hit.sum()), sorted(named)


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
