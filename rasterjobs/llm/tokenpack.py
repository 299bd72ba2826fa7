"""Token ids packed at the least width of the vocabulary, in shards with block offsets.

File format (little-endian), one shard:

* header: ``b"TPK1"``, uint8 bits per id, 3 zero bytes, uint32 ids per block,
  uint64 number of ids, uint64 number of documents, uint64 number of the shard's
  first id, uint64 number of blocks
* uint64 byte offset of each block, counted from the end of the index
* uint64 number of the first id of each document, and one more for the end,
  counted from the shard's start
* blocks: the ids of a block, each in ``bits`` bits, low bits first, padded to a byte

An id is found from its number alone: block ``i // ids_per_block``, bit
``(i % ids_per_block) * bits``.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import give_back, small, stage

MAGIC = b"TPK1"
HEAD = struct.Struct("<4sB3xIQQQQ")
BLOCK = 4096
#: Ids in a shard, about 8 MiB at 16 bits; a longer document has a shard of its own.
SHARD_IDS = 4 << 20
#: Parts of texts whose ids a task remembers; the memory is emptied when full.
CACHE_WORDS = 400_000
LARGE = pa.large_string()
#: Words of letters that the library encodes in one call.
TOGETHER = 256
#: Empty texts, blanks (of any script) other than a single space or newline between other characters, and the mark that parts words here.
ODD = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: A letter and a mark that is no apostrophe, which are always parted.
MARK = rf"(\pL)([{re.escape(string.punctuation.replace("'", ""))}])"


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def pack_shard(docs: list[np.ndarray], bits: int, first: int = 0) -> bytes:
    """One shard's bytes; ``first`` is the number of its first id in the whole corpus."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_block(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    head = HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(docs), first, len(blocks))
    return b"".join([head, offsets.tobytes(), starts.tobytes(), *blocks])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.ids, self.docs, self.first, n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.offsets = np.frombuffer(data, "<u8", n, HEAD.size)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, HEAD.size + 8 * n)
        self.body = memoryview(data)[HEAD.size + 8 * n + 8 * (self.docs + 1) :]

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids number ``lo`` to ``hi`` of the shard; only their blocks are unpacked."""
        parts = []
        for b in range(lo // self.block, -(-hi // self.block)):
            count = min(self.block, self.ids - b * self.block)
            at = int(self.offsets[b])
            parts.append(unpack_block(self.body[at : at + -(-count * self.bits // 8)], count, self.bits))
        base = lo - lo % self.block
        return np.concatenate(parts)[lo - base : hi - base] if parts else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


# --------------------------------------------------------------------------
# Encoding


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, remembering words.

    Its pre-tokenizer always breaks before a single space or newline between two
    other characters, and between a letter and a mark that is no apostrophe, so the
    parts encode apart. Texts are split and their distinct parts found by Arrow; the
    ids of parts stand in one array, from which numpy takes those of a text. A text
    with any other use of blanks is encoded as a whole, and so is one that holds the
    content of an added token, which the library finds before it breaks.

    A word is remembered with the blank before it; the first of a text counts as
    after a newline, whose ids are left out.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = len(self._encode(["\n"])[0])
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ends, self.ids = array("q", [0]), array("I")

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: list[int], ends: np.ndarray) -> None:
        at = len(self.words)
        self.words.update(zip(words, range(at, at + len(words)), strict=True))
        self.ends.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
        self.ids.extend(ids)

    def _add_each(self, words: list[str]) -> None:
        found = self._encode(words)
        self._add(words, [i for x in found for i in x], np.cumsum([len(x) for x in found]))

    def _learn(self, words: list[str]) -> None:
        """Remember new parts; those that are a blank and letters in calls of many."""
        letters: dict[str, list[str]] = {" ": [], "\n": []}
        other = []
        for w in words:
            (letters[w[0]] if w[:1] in letters and w[1:].isalpha() else other).append(w)
        for blank, known in letters.items():
            for lo in range(0, len(known), TOGETHER):
                part = known[lo : lo + TOGETHER]
                e = self.tokenizer.encode("".join(part), add_special_tokens=False)
                where = np.array(e.word_ids)
                ends = np.append(np.flatnonzero(where[1:] != where[:-1]) + 1, len(where))
                ends = ends[1::2] if blank == "\n" else ends  # a newline is a piece of its own
                if len(ends) == len(part):
                    self._add(part, e.ids, ends)
                else:  # letters to Python that the library does not take for letters
                    self._add_each(part)
        for lo in range(0, len(other), 4096):
            self._add_each(other[lo : lo + 4096])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        every = pa.array(texts, LARGE)
        odd = pc.match_substring_regex(every, ODD)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(every, a))
        whole = iter(self._encode(every.filter(odd).to_pylist()))
        plain = iter(self._plain(every.filter(pc.invert(odd))))
        return [np.array(next(whole), np.uint32) if x else next(plain) for x in odd.to_pylist()]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        for blank in (" ", "\n"):
            texts = pc.replace_substring(texts, blank, "\0" + blank)
        texts = pc.replace_substring_regex(texts, MARK, "\\1\0\\2")
        pieces = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", LARGE), texts, pa.scalar("", LARGE)), "\0")
        counts = np.diff(pieces.offsets.to_numpy())
        coded = pieces.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHE_WORDS:
            self._forget()
        of = list(map(self.words.get, distinct))
        new = [i for i, x in enumerate(of) if x is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            of[i] = self.words[distinct[i]]
        of = np.array(of, np.int64)[coded.indices.to_numpy()]
        ends = np.frombuffer(self.ends, np.int64)
        begin = ends[of]
        size = ends[of + 1] - begin
        first = np.cumsum(counts) - counts
        begin[first] += self.newline
        size[first] -= self.newline
        at = np.cumsum(size) - size
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(begin - at, size) + np.arange(size.sum())]
        return np.split(ids, at[first[1:]])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@contextmanager
def encoding(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for one task; the words that the task has met are not kept for other tasks."""
    enc = encoder(path)
    try:
        yield enc
    finally:
        enc._forget()
        give_back()


# --------------------------------------------------------------------------
# Jobs


def _slices(batch: pa.RecordBatch, bytes_: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about ``bytes_`` at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= bytes_:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_shards(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Table of shards in ascending document order: ``part, shard, doc_ids, n_ids, data``.

    Documents are dealt out by ranges of their id (nulls first), encoded and
    packed where they land, so only texts are shuffled and no task holds more
    than a shard. Null texts are empty: only the end id. Repeated rows repeat.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    d = d.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def packed(batches, enc):
        bits = max(1, (max(enc.size - 1, end_id)).bit_length())
        end, shard, ids, docs_, size, part = np.array([end_id], np.uint32), 0, [], [], 0, None

        def out():
            data = pack_shard(docs_, bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "doc_ids", "n_ids", "data"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for some, texts in _slices(batch):
                for i, x in zip(some, enc.batch(texts), strict=True):
                    if size and size + len(x) + 1 > SHARD_IDS:
                        yield out()
                        shard, ids, docs_, size = shard + 1, [], [], 0
                    ids.append(i)
                    docs_.append(np.concatenate([x, end]))
                    size += len(x) + 1
        if ids:
            yield out()

    def run(batches):
        with encoding(tokenizer) as enc:
            yield from packed(batches, enc)

    return d.mapInArrow(run, "part int, shard int, doc_ids array<long>, n_ids long, data binary")


def numbered(shards: DataFrame) -> DataFrame:
    """Shards with ``first``, the number of their first id in the whole corpus.

    Only (part, shard, n_ids) is summed: a few bytes for every 8 MiB of ids.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = shards.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("inside"))
    first = inside.join(small(before), "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))
    return shards.join(small(stage(first, "first")), ["part", "shard"])


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from numbered shards."""

    def run(batches):
        for batch in batches:
            for doc_ids, first, data in zip(batch.column("doc_ids"), batch.column("first"), batch.column("data"), strict=True):
                shard = Shard(data.as_py())
                ids = shard.slice(0, shard.ids).astype("<u4")
                cut = shard.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(cut[:-1] + first.as_py()), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("doc_ids", "first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to the shared folder, read them back and describe each document."""
    return read_documents(numbered(stage(write_shards(docs, tokenizer, **options), "shards")))


def export(shards: DataFrame, folder: str) -> None:
    """Write numbered shards as files ``part-shard.tpk`` into ``folder``, which all executors can reach."""

    def run(rows):
        for r in rows:
            path = os.path.join(folder, f"{r.part:06d}-{r.shard:06d}.tpk")
            data = bytearray(r.data)
            magic, bits, block, ids, docs, _, n = HEAD.unpack_from(data)
            HEAD.pack_into(data, 0, magic, bits, block, ids, docs, r.first, n)
            tmp = f"{path}.{os.getpid()}.tmp"
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, path)

    shards.foreachPartition(run)
