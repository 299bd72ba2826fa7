"""Shared helpers: staging tables, size-checked broadcasts, word hashing.

Word hashing works on bytes with numpy, one document at a time, so an executor
never holds more than an Arrow batch plus a few arrays as long as one document.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it has been counted and is below this.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# Staging


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder is used, for local masters only.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Bytes of a batch that Spark hands to a Python task, unless one row has more.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _size(text: str) -> int:
    """Bytes of a setting such as ``64m`` or ``67108864b``."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_BYTES``, or of what is set if that is less, for what is run inside.

    Spark's own 64 MiB take that room several times over, in the executor's JVM and in Python.
    """
    before = spark.conf.get(_BATCH)
    if 0 < _size(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table,
    not the work that made it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and few bytes in its texts and arrays, else as it is."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    deep = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    sizes = [F.octet_length(F.col(f"`{c}`")) for c in wide] + [F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) for c in deep]
    size = sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(8 * len(df.columns)).cast("long"))
    n, bytes_ = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (bytes_ or 0) <= BROADCAST_BYTES else df


#: Bytes of the rows of a slice, unless one row has more.
SLICE_BYTES = 2 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc


def give_back() -> None:
    """Return freed memory to the system: a Python worker goes on to other tasks, and would keep what the largest took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches, rows: int = 256):
    """Arrow batches cut to at most ``rows`` rows and ``SLICE_BYTES``, so that a task's arrays stay small."""
    give_back()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            todo = [batch.slice(lo, rows)]
            while todo:
                part = todo.pop()
                half = part.num_rows // 2
                if half and part.nbytes > SLICE_BYTES:
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


# --------------------------------------------------------------------------
# Hashing

_CHUNK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Factors that spread 32 bits for the probes of a filter; the first leaves them as they are.
_ODD = np.array([1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
#: The lowest k bytes of a block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _chunks(data: bytes):
    at = 0
    while len(data) - at > _CHUNK:
        cut = data.rfind(b" ", at + 1, at + _CHUNK)
        if cut < 0:
            cut = data.find(b" ", at + _CHUNK)
            cut = len(data) if cut < 0 else cut
        yield at, data[at:cut]
        at = cut
    yield at, data[at:]


def _hash_words(data: bytes, lanes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where words begin in ``data``, and their hashes, one array for each lane.

    A word is read in blocks of eight bytes. Each block is scrambled together
    with its place before the blocks are added, so no sum of powers is left that
    regular texts could cancel. Words of 1 MiB and more are hashed by blake2b.
    """
    begins, out = [], [[] for _ in range(lanes)]
    for at, chunk in _chunks(data):
        word = np.zeros(len(chunk) + 2, dtype=np.int8)
        word[1:-1] = np.frombuffer(chunk, dtype=np.uint8) != 0x20
        turn = np.flatnonzero(word[1:] != word[:-1])
        starts, sizes = turn[::2], turn[1::2] - turn[::2]
        if not len(starts):
            continue
        begins.append(starts + at)
        if sizes[0] >= _CHUNK:  # such a word is alone in its chunk
            d = hashlib.blake2b(chunk.strip(b" "), digest_size=16).digest()
            for lane in range(lanes):
                out[lane].append(np.frombuffer(d, dtype=np.uint64)[lane : lane + 1])
            continue
        blocks = (sizes + 7) >> 3
        first = np.cumsum(blocks) - blocks
        place = np.arange(blocks.sum()) - np.repeat(first, blocks)
        where = np.repeat(starts, blocks) + 8 * place
        left = np.minimum(np.repeat(sizes, blocks) - 8 * place, 8)
        every = np.ndarray((len(chunk) + 1,), "<u8", chunk + bytes(8), strides=(1,))
        value = every[where] & _LOW[left]
        later = np.flatnonzero(place)
        for lane in range(lanes):
            h = mix64(value ^ np.uint64(_BASES[lane]))
            h[later] = mix64(h[later] + place[later].astype(np.uint64) * _STEP)
            out[lane].append(mix64(np.add.reduceat(h, first) + sizes.astype(np.uint64) * _STEP))
    join = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]
    return np.concatenate(begins) if begins else np.empty(0, np.int64), join


def word_hashes(data: bytes, lanes: int = 1) -> list[np.ndarray]:
    """64-bit hashes of the words of ``data``, one array for each lane.

    Words are what stands between spaces (0x20); callers turn their other
    separators into spaces first.
    """
    return _hash_words(data, lanes)[1]


def text_words(texts, table: bytes, lanes: int = 1) -> list[list[np.ndarray]]:
    """Word hashes of each of an Arrow array of binary texts, hashed in one go; nulls have no words."""
    data = [(t.as_py() or b"").translate(table) for t in texts]
    begins, hashes = _hash_words(b" ".join(data), lanes)
    cut = np.searchsorted(begins, np.cumsum([0] + [len(x) + 1 for x in data]))
    return [[h[a:b] for h in hashes] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def ngram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words (empty if there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[lane] | 1
    block, size, have, out, left = words, 1, 0, None, n
    while left:
        factor = np.uint64(pow(base, size, 1 << 64))
        if left & 1:
            part = block[have : have + m]
            out = part.copy() if out is None else out * factor + part
            have += size
        left >>= 1
        if left:
            block = block[:-size] * factor + block[size:]
            size *= 2
    return mix64(out + np.uint64(n))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size < w:
        step = min(size, w - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the values that are the least of some ``w`` neighbours.

    Any two sequences that share ``w`` consecutive values share a position of
    that run here. Fewer than ``w`` values count as one window.
    """
    if not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    least = np.zeros(len(h) + w - 1, dtype=np.uint64)
    least[w - 1 : len(h)] = sliding_min(h, w)
    return np.flatnonzero(~sliding_min(~least, w) == h)


#: Bytes of ``[^\x20\x09-\x0D]`` stay; the separators become spaces.
BLANKS = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
#: As BLANKS, with A-Z in lower case.
BLANKS_LOWER = bytes(BLANKS[b + 32 if 0x41 <= b <= 0x5A else b] for b in range(256))
#: A-Z in lower case; digits, letters and non-ASCII bytes stay, all else is a space.
ALNUM_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


# --------------------------------------------------------------------------
# Keys that occur more than once

#: Size of the filter of repeated keys, 2**30 bits (128 MiB) at most; bits aimed at for each of them, and bits that one sets at most.
FILTER_BITS, KEY_BITS, MOST_PROBES = 30, 12, 4
#: Repeated keys for each bit of the largest filter, beyond which a join replaces it.
FULL = 4
#: Keys a task holds before it sends them out, and keys aimed at in a range.
HELD_KEYS, RANGE_KEYS = 1 << 18, 1 << 20
#: A key in fewer documents is never split; keys that can be split at most.
HOT_KEY, MOST_HOT = 1_000, 1_000_000


def _slot(low: np.ndarray, probe: int, width: int) -> np.ndarray:
    """The bit, of a range's ``2**width``, that a probe looks at; ``low`` has the 32 bits of keys after the range's."""
    return (low * _ODD[probe] >> np.uint32(32 - width)).astype(np.int64)


class Repeated:
    """The keys that several documents hold.

    ``keys_of`` gets an Arrow batch of ``rows`` and returns arrays of 64-bit keys,
    each key once per document. Tasks sort the keys they hold and send them as packed
    arrays, one to each range of the key space: those held once, and those held more
    often with their number. The number of ranges grows with ``expected`` keys, so a
    range stays small. Of a key the range's bits and the 32 bits after them travel: a
    chance agreement in these (one key in a thousand, as the ranges grow along) only
    costs a row.

    The repeated keys are turned into a Bloom filter that tasks probe while they
    read the texts a second time; a false positive only costs a row. It has about
    ``KEY_BITS`` bits for each of them, so the share of false positives does not grow
    with the input, and a part of its own for each range. When there are too many
    repeated keys for ``2**bits``, ``bitmap`` is None and ``only`` joins instead.
    """

    def __init__(self, rows: DataFrame, keys_of, expected: int, bits: int = FILTER_BITS):
        spark = rows.sparkSession
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // RANGE_KEYS), 2)
        self.top = top = (ranges - 1).bit_length()
        edges = np.arange((1 << top) + 1, dtype=np.uint64) << np.uint64(32)

        def counted(x):
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            return x[first], np.diff(np.append(first, len(x))).astype(np.uint32)

        def send(held):
            x, n = counted(np.sort(np.concatenate(held) >> np.uint64(32 - top)))
            once, many = x[n == 1], x[n > 1]
            more = np.stack([many.astype(np.uint32), n[n > 1]], 1)
            cut, cut2 = np.searchsorted(once, edges), np.searchsorted(many, edges)
            some = np.flatnonzero(np.diff(cut) + np.diff(cut2))
            low = once.astype(np.uint32)
            packed = [pa.array([v[c[i] : c[i + 1]].tobytes() for i in some], pa.binary()) for v, c in ((low, cut), (more, cut2))]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], ["range", "once", "more"])

        def keys(batches):
            held, size = [], 0
            for batch in slices(batches):
                for x in keys_of(batch):
                    held.append(x)
                    size += len(x)
                    if size >= HELD_KEYS:
                        yield send(held)
                        held, size = [], 0
            if size:
                yield send(held)

        def finish(number, once, more):
            x, n = counted(np.sort(np.concatenate(once)))
            y = np.concatenate(more).reshape(-1, 2)
            every, at = np.unique(np.concatenate([x, y[:, 0]]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n, y[:, 1]]), len(every)).astype(np.int64)
            x, n = every[total > 1], total[total > 1]
            hot = n >= HOT_KEY
            often = pa.array([list(zip((x[hot].astype(np.int64) + (number << 32)).tolist(), n[hot].tolist(), strict=True))], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([x.tobytes()], pa.binary()), often], ["range", "n", "total", "keys", "often"])

        def count(batches):
            number, once, more = None, [], []
            for batch in batches:
                for r, k, m in zip(batch.column("range").to_pylist(), batch.column("once"), batch.column("more"), strict=True):
                    if r != number and once:
                        yield finish(number, once, more)
                        once, more = [], []
                    number = r
                    once.append(np.frombuffer(k.as_py(), np.uint32))
                    more.append(np.frombuffer(m.as_py(), np.uint32))
            if once:
                yield finish(number, once, more)

        sent = rows.mapInArrow(keys, "range int, once binary, more binary").repartition(1 << top, "range").sortWithinPartitions("range")
        self.found = stage(sent.mapInArrow(count, "range int, n long, total long, keys binary, often array<struct<key:long,n:long>>"), "repeated")
        self.n, self.total = (x or 0 for x in self.found.agg(F.sum("n"), F.sum("total")).first())
        self.bitmap = None
        if bits >= top + 3 and FULL * self.n <= 1 << bits:
            self.bits = min(bits, top + 32, max(top + 3, (KEY_BITS * self.n).bit_length()))
            self.probes = min(MOST_PROBES, max(1, int(0.7 * (1 << self.bits) / max(self.n, 1))))
            self.bitmap = spark.sparkContext.broadcast(self._filter())

    def _filter(self) -> np.ndarray:
        width, probes = self.bits - self.top, self.probes
        step = 1 << (width - 3)

        def fill(batches):
            for batch in batches:
                for r, k in zip(batch.column("range").to_pylist(), batch.column("keys"), strict=True):
                    part, low = np.zeros(step, np.uint8), np.frombuffer(k.as_py(), np.uint32)
                    for i in range(probes):
                        slot = _slot(low, i, width)
                        np.bitwise_or.at(part, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["range", "part"])

        out = np.zeros(step << self.top, np.uint8)
        parts = stage(self.found.select("range", "keys").mapInArrow(fill, "range int, part binary"), "filter")
        for r in parts.toLocalIterator():  # 2**bits bits in all
            out[r.range * step : (r.range + 1) * step] = np.frombuffer(r.part, np.uint8)
        return out

    def salts(self):
        """A function for tasks: array of uint64 keys to the number of parts their rows are split into.

        More than one for keys with over a millionth of all occurrences (at least
        ``HOT_KEY``), of which there can be a million at most.
        """
        share = max(HOT_KEY, self.total // MOST_HOT)
        hot = self.found.select(F.explode("often").alias("x")).select("x.key", "x.n").filter(F.col("n") >= share).orderBy("key").toArrow()
        sent = self.found.sparkSession.sparkContext.broadcast((hot["key"].to_numpy(), -(-hot["n"].to_numpy() // share) + 1))
        top = self.top

        def parts(keys: np.ndarray) -> np.ndarray:
            known, n = sent.value
            if not len(known):
                return np.ones(len(keys), np.int64)
            cut = (keys >> np.uint64(32 - top)).astype(np.int64)
            at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
            return np.where(known[at] == cut, n[at], 1)

        return parts

    def probe(self):
        """A function for tasks: array of uint64 keys to a mask of possible repeats."""
        bitmap = self.bitmap
        if bitmap is None:
            return lambda keys: np.ones(len(keys), bool)
        top, width, probes = self.top, self.bits - self.top, self.probes

        def may_repeat(keys: np.ndarray) -> np.ndarray:
            cut = keys >> np.uint64(32 - top)
            low, base = cut.astype(np.uint32), (cut >> np.uint64(32)).astype(np.int64) << width
            left = np.arange(len(keys))
            for i in range(probes):
                slot = base[left] + _slot(low[left], i, width)
                left = left[(bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            out = np.zeros(len(keys), bool)
            out[left] = True
            return out

        return may_repeat

    def only(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a long ``key``) whose key is repeated; all of them where ``probe`` has done it."""
        if self.bitmap is not None:
            return rows
        top = self.top

        def unpack(batches):
            for batch in batches:
                for r, k in zip(batch.column("range").to_pylist(), batch.column("keys"), strict=True):
                    x = np.frombuffer(k.as_py(), np.uint32).astype(np.int64) + (r << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(x)], ["cut_key"])

        known = self.found.select("range", "keys").mapInArrow(unpack, "cut_key long")
        return rows.withColumn("cut_key", F.shiftrightunsigned("key", 32 - top)).join(known, "cut_key", "left_semi").drop("cut_key")


# --------------------------------------------------------------------------
# Connected components


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``edges`` (columns a, b; non-null longs).

    Alternates the large-star and small-star steps, each a minimum per node and
    a join, until the edge set is a forest of stars around the least ids. The
    minimum uses partial aggregation and the join can be split by AQE, so a hub
    needs no group in memory.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        if large:
            half = e.select("a", "b").unionByName(e.select(b.alias("a"), a.alias("b")))
        else:
            half = e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        least = half.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        linked = half.join(least, "a")
        if large:
            new = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            new = new.unionByName(least.select("a", F.col("m").alias("b")))
        return new.filter("a <> b").distinct()

    e = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        e = stage(step(step(e, True), False), "edges")
        sums = [F.count("*"), *(F.sum(F.xxhash64(x, F.lit(7)).cast("decimal(38,0)")) for x in ("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        now = tuple(e.agg(*sums).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
