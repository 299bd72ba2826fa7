"""Substring dedup by seed and extend.

Anchors are winnowed k-grams: every window of ``n`` words has the least of its
k-grams as anchor, the first of equals, so equal windows have the same anchor at
the same place. Anchors that only one document holds end there. The occurrences
of an anchor meet in order of their documents; each is laid against the first ones
and the match is extended word by word to both sides, as far as windows with this
anchor reach. Extended matches of at least ``n`` words are kept, and those of
neighbouring anchors join up to maximal repeats.

What differs from the first occurrences may still equal a later one: windows that
no extension has settled are grouped by a digest of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Repeated, mix64, ngram_hashes, slices, small, stage, text_words

#: Occurrences of an anchor that the others are laid against.
ROUNDS = 4
#: A null id ranks after all others.
LAST = (1 << 63) - 1


def anchors(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of k-grams that are the first least of some ``w`` neighbours, with the first and last such run's begin."""
    before, after = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    left, right = np.ones(len(grams), bool), np.ones(len(grams), bool)
    for j in range(1, w):
        left[:j] = False
        left[j:] &= grams[:-j] > grams[j:]
        right[max(len(grams) - j, 0) :] = False
        right[:-j] &= grams[j:] >= grams[:-j]
        before += left
        after += right
    at = np.flatnonzero(before + after >= w - 1)
    return at, at - before[at], np.minimum(at, at + after[at] - (w - 1))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts, ends, length: int) -> np.ndarray:
    """Words from one of ``starts`` to its end."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(ends, length), -1)
    return np.cumsum(step)[:length] > 0


def _occurrences(d: DataFrame, n: int, k: int, repeated: Repeated) -> DataFrame:
    """A row for each repeated anchor in a text.

    ``key`` is the anchor's hash, ``part`` splits very frequent ones, ``place`` the
    text's tag and the anchor's position, ``far`` and ``near`` how many words before
    the anchor its windows begin. ``words`` holds the hashes of the words around it
    that its windows reach, and a second hash of the anchor.
    """
    probe, salts, side = repeated.probe(), repeated.salts(), n - k

    def run(batches):
        for batch in slices(batches):
            tags, counts, parts = batch.column("tag").to_numpy().astype(np.int64), [], []
            for (one, two), tag in zip(text_words(batch.column("text"), BLANKS, 2), tags, strict=True):
                grams = ngram_hashes(one, k)
                at, lo, hi = anchors(grams, side + 1) if len(one) >= n else (np.empty(0, np.int64),) * 3
                some = probe(grams[at])
                at, lo, hi = at[some], lo[some], hi[some]
                counts.append(len(at))
                if len(at):
                    wide = np.concatenate([np.zeros(side, np.uint64), two, np.zeros(side, np.uint64)])
                    steps = np.concatenate([np.arange(-side, 0), np.arange(k, n)])
                    around = wide[at[:, None] + steps + side]
                    unused = (steps < (lo - at)[:, None]) | (steps >= (hi - at + n)[:, None])
                    around[unused] = 0
                    key = grams[at]
                    parts.append((key, salts(key), tag << 32 | at, at - lo, at - hi, np.column_stack([around, ngram_hashes(two, k, 1)[at]])))
            if parts:
                key, salt, place, far, near, words = (np.concatenate(x) for x in zip(*parts, strict=True))
                rank = batch.column("rank").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                part = (mix64(rank.to_numpy().view(np.uint64)) % salt.astype(np.uint64)).astype(np.int32) + (salt > 1)
                words = pa.array([x.tobytes() for x in words], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part, pa.int32()), rank, pa.array(place), pa.array(far.astype(np.int16)), pa.array(near.astype(np.int16)), words], ["key", "part", "rank", "place", "far", "near", "words"])

    return repeated.only(d.mapInArrow(run, "key long, part int, rank long, place long, far short, near short, words binary"))


def _extended(rows: DataFrame, n: int, k: int) -> DataFrame:
    """Matches with an earlier occurrence of an anchor (``runs`` windows from ``place`` on), and open windows (``runs`` 0, by digests a and b).

    Rows of an anchor come one after the other. Each is laid against the first one,
    then against the first of those with windows that this did not settle, and so on
    for ``ROUNDS`` of them, which are all that is kept in mind. Where an anchor is
    split each part has first ones of its own, whose windows stay open.
    """
    side = n - k

    def run(batches):
        held = None
        for batch in slices(batches, 8192):
            columns = [batch.column(c).to_numpy() for c in ("key", "part", "rank", "place", "far", "near")]
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(-1, 2 * side + 1)
            new = np.ones(len(words), bool)
            if held is not None:  # those of the last anchor lead the batch
                columns = [np.concatenate([x, y]) for x, y in zip(held[0], columns, strict=True)]
                new = np.concatenate([np.zeros(len(held[1]), bool), new])
                words = np.concatenate([held[1], words])
            key, part, rank, place, far, near = columns
            row = np.arange(len(key))
            begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
            steps = np.arange(side + 1)  # words that a window begins before the anchor
            open_ = (steps >= near[:, None]) & (steps <= far[:, None])
            used, leaders, out = np.zeros(len(key), bool), [], []
            for _ in range(ROUNDS):
                lead = np.minimum.reduceat(np.where(open_.any(1) & ~used, row, len(key)), begins)
                mine = lead[group]
                i = np.flatnonzero((row > mine) & open_.any(1))
                some = lead[lead < len(key)]
                if not len(some):
                    break
                used[some] = True
                leaders += lead[-1:][lead[-1:] < len(key)].tolist()
                j = mine[i]
                same = words[i] == words[j]
                left = np.minimum.accumulate(same[:, :side][:, ::-1], axis=1).sum(1)
                right = np.minimum.accumulate(same[:, side : 2 * side], axis=1).sum(1)
                most, least = np.minimum(far[i], left), np.maximum(near[i], side - right)
                fits = same[:, -1] & (most >= least)
                later = rank[i] > rank[j]
                g = np.flatnonzero(fits & later & new[i])
                out.append((np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), rank[i][g], place[i][g] - most[g], (most - least + 1)[g]))
                settled = fits & (later | (part[i] == 0))  # in a part, the same document's later places stay open too
                open_[i] &= ~(settled[:, None] & (steps >= least[:, None]) & (steps <= most[:, None]))
                whole = some[part[some] == 0]
                open_[whole] = False
            for o in steps:
                i = np.flatnonzero(open_[:, o] & new)
                if len(i):
                    w = words[i]
                    start = mix64(key[i].view(np.uint64) + np.uint64(o)), mix64(w[:, -1] + np.uint64(o + 99))
                    digest = []
                    for h, factor in zip(start, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
                        for c in range(side - o, 2 * side - o):
                            h = mix64(h * np.uint64(factor) + w[:, c])
                        digest.append(h.view(np.int64))
                    out.append((*digest, rank[i], place[i] - o, np.zeros(len(i), np.int64)))
            leaders = [x for x in leaders if x >= begins[-1]] or [begins[-1]]
            held = [x[leaders] for x in columns], words[leaders]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.int32(),), strict=True)], ["a", "b", "rank", "place", "runs"])

    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "rank", "place")
    return rows.mapInArrow(run, "a long, b long, rank long, place long, runs int")


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 13, k: int = 7) -> DataFrame:
    """One row per document with the maximal repeats to remove.

    Columns: the id, ``n_words``, ``spans`` (array of structs ``start``, ``end``
    in words: maximal runs covered by windows of ``n`` words that also start in
    a document with a smaller id), ``n_removed``, ``kept_text`` (the other words
    joined by one space). Words are what stands between blanks, unchanged.

    Null and empty texts have no words. Rows that share an id remove nothing from
    each other; null ids rank after all others. Every exact copy of a text but
    the one with the least id is covered whole (from ``n`` words on), which is
    settled by one digest per text, so large groups of copies stay one row each.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    t = F.col(text).cast("string")
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("rank"), t.cast("binary").alias("text"), F.md5(t.cast("binary")).alias("digest"), F.hash(t).alias("tag"))
    bytes_ = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    first = d.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first < last and digest is not null").select("digest", "first")
    d = d.join(small(stage(first, "copies")), "digest", "left").select("id", "rank", "tag", "text", F.coalesce(F.col("rank") > F.col("first"), F.lit(False)).alias("copy"))
    own = d.filter(~F.col("copy")).select("rank", "tag", "text")

    def keys(batch):
        found = (ngram_hashes(x, k) for (x,) in text_words(batch.column("text"), BLANKS) if len(x) >= n)
        return [np.unique(g[anchors(g, n - k + 1)[0]]) for g in found]

    repeated = Repeated(own, keys, bytes_ // 20)  # about one key for three words
    found = stage(_extended(_occurrences(own, n, k, repeated), n, k), "matches")
    rows = found.filter("runs = 0")
    least = rows.groupBy("a", "b").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("a", "b", "least")
    late = rows.join(small(stage(least, "least")), ["a", "b"]).filter("rank > least")
    gone = found.filter("runs > 0").select("rank", "place", "runs").unionByName(late.select("rank", "place", F.lit(1).alias("runs")))
    gone = gone.groupBy(F.col("rank").alias("grank"), F.expr("cast(place >> 32 as int)").alias("gtag")).agg(F.collect_set(F.expr(f"(place & 4294967295) * {n} + runs")).alias("runs"))
    gone = stage(gone, "repeats")
    # hashed, not sorted: places are a small part of a partition's texts, which then need no memory
    joined = d.join(gone.hint("shuffle_hash"), (F.col("rank") == F.col("grank")) & (F.col("tag") == F.col("gtag")), "left").select("id", "text", "copy", "runs")

    def cut(batches):
        for batch in slices(batches):
            n_words, removed, spans, kept = [], [], [], []
            for t, copy, runs in zip(batch.column("text"), batch.column("copy"), batch.column("runs"), strict=True):
                words = (t.as_py() or b"").split()
                if copy.as_py():
                    gone = np.full(len(words), len(words) >= n)
                elif runs.is_valid:
                    x = runs.values.to_numpy()
                    gone = covered(x // n, x // n + x % n + (n - 1), len(words))  # an anchor has fewer than n windows
                else:
                    gone = None
                n_words.append(len(words))
                if gone is None:
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                else:
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(*_runs(gone), strict=True)])
                    kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "spans", "kept_text"])

    out = joined.mapInArrow(cut, f"id {id_type}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text binary")
    return out.withColumnRenamed("id", doc_id).withColumn("kept_text", F.col("kept_text").cast("string"))
