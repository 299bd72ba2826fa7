"""Merkle manifest of a dataset, stored in aligned subtrees with a van Emde Boas layout.

Leaves of a group ascend by id; every ``ARITY`` consecutive nodes become their
hash until one node remains. The tree of a group is cut into aligned subtrees of
``HEIGHT`` steps: a block holds up to ``ARITY ** HEIGHT`` leaves and all nodes
above them, up to its root. Block roots are the leaves of the next tier, and so on
until a group has one block left. Group roots, in group order, are the leaves of
one more tree of the same kind.

A block is one array of digests in van Emde Boas order: a tree is split at half its
height, the top part comes first, then each part below it, each laid out by the
same rule. So a node's place is arithmetic on its level and position alone, and
the nodes of a path lie in few stretches whatever the size of a page.

Rows of a block are one task's work at a time, never more. A block of a group with
a third of all leaves is like any other. Blocks of the tiers above are fewer by
``ARITY ** HEIGHT`` each time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import small, stage

#: Nodes that become one, and steps from the leaves of a block to its root.
ARITY, HEIGHT = 3, 6
DIGEST = 32


# --------------------------------------------------------------------------
# Layout


def nodes(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def places(levels: int) -> tuple[np.ndarray, ...]:
    """For each level from the root on, the place of each of its nodes."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    upper, lower = places(top), places(levels - top)
    trees = nodes(top) + np.arange(ARITY**top, dtype=np.int64)[:, None] * nodes(levels - top)
    return upper + tuple((trees + x[None, :]).ravel() for x in lower)


def steps(leaves: int) -> int:
    """Steps from so many leaves to one node."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // ARITY), n + 1
    return n


def hash_hex(*digests: bytes) -> bytes:
    """The digest of digests, joined as lower-case hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Block:
    """An aligned subtree: ``data`` has its digests in van Emde Boas order, ``leaves`` of them at the lowest level.

    Places of nodes that don't exist, as the last run is short, are zero bytes.
    """

    def __init__(self, data: bytes, leaves: int, height: int):
        self.data, self.leaves, self.height = data, leaves, height

    @classmethod
    def build(cls, digests: list[bytes], height: int) -> Block:
        data = bytearray(nodes(height + 1) * DIGEST)
        block = cls(data, len(digests), height)
        for level in range(height, -1, -1):
            for at, x in zip(places(height + 1)[level][: len(digests)].tolist(), digests, strict=True):
                data[at * DIGEST : (at + 1) * DIGEST] = x
            if level:
                digests = [hash_hex(*digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        block.data = bytes(data)
        return block

    def count(self, level: int) -> int:
        """Nodes at a level, counted from the root."""
        return -(-self.leaves // ARITY ** (self.height - level))

    def node(self, level: int, position: int) -> bytes:
        at = int(places(self.height + 1)[level][position]) * DIGEST
        return self.data[at : at + DIGEST]

    @property
    def root(self) -> bytes:
        return self.data[:DIGEST]

    def siblings(self, leaf: int) -> list[tuple[int, bytes]]:
        """From the leaf's level up to below the root: how many siblings are to the left, and all siblings joined."""
        out = []
        for level in range(self.height, 0, -1):
            first, own = leaf - leaf % ARITY, leaf % ARITY
            run = range(first, min(first + ARITY, self.count(level)))
            out.append((own, b"".join(self.node(level, i) for i in run if i != leaf)))
            leaf //= ARITY
        return out


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, around in path:
        digest = hash_hex(around[: left * DIGEST], digest, around[left * DIGEST :])
    return digest


# --------------------------------------------------------------------------
# Leaves


def field(value: Column) -> Column:
    """A value with its length in bytes before it; null: ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


# --------------------------------------------------------------------------
# Blocks

_NODE = "group long, idx long, digest binary, extra binary"
_BLOCK = "group long, tier int, block long, leaves int, height int, data binary, extras array<binary>"


def numbered(leaves: DataFrame, group: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``group`` (a number in the order of the groups) and ``idx`` in it from 0; and ``group, name, n``.

    A range sort deals the rows out; each range counts its own rows of a group, and
    only these counts, one for each range and group in it, are summed up.
    """
    d = leaves.withColumn("name", group)
    d = d.repartitionByRange(F.col("name").asc_nulls_first(), *order).sortWithinPartitions(F.col("name").asc_nulls_first(), *order)
    d = stage(d.withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    part = F.shiftright("at", 33)
    runs = stage(d.groupBy(part.alias("part"), "name").agg(F.count("*").alias("rows"), F.min("at").alias("first")), "runs")
    # a row for each range and group; summed per group
    before = F.sum("rows").over(W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    offset = runs.withColumn("offset", before)
    named = runs.groupBy("name").agg(F.sum("rows").alias("n"))
    named = _place_groups(stage(named, "groups"))
    run = offset.join(small(named.select(F.col("name").alias("gname"), "group")), F.col("name").eqNullSafe(F.col("gname"))).select("part", F.col("name").alias("rname"), "group", (F.col("offset") - F.col("first")).alias("shift"))
    out = d.join(small(stage(run, "offsets")), (part == F.col("part")) & F.col("name").eqNullSafe(F.col("rname")))
    return out.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "name", "rname", "part", "shift"), named


def _place_groups(named: DataFrame) -> DataFrame:
    """``named`` with ``group``, its place in ascending order from 0, null first: counted in ranges, as leaves are."""
    d = named.repartitionByRange(F.col("name").asc_nulls_first()).sortWithinPartitions(F.col("name").asc_nulls_first())
    d = stage(d.withColumn("at", F.monotonically_increasing_id()), "sorted-groups")
    part = F.shiftright("at", 33)
    sizes = d.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))  # a row for each range
    return d.join(F.broadcast(before), part == F.col("part")).withColumn("group", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def blocks_of(nodes_: DataFrame, counts: DataFrame, tier: int, most: int) -> DataFrame:
    """Blocks (``_BLOCK``) of the nodes (``_NODE``) of one tier; ``counts``: ``group, n`` of the nodes of each group.

    ``most``: steps of a block. Rows of a block come one after the other and are held one block at a time.
    """
    span = ARITY**most
    d = nodes_.join(small(counts.select("group", "n")), "group")
    d = d.withColumn("block", F.expr(f"idx div {span}")).repartition("group", "block").sortWithinPartitions("group", "block", "idx")
    d = d.select("group", "block", "n", "digest", "extra")

    def run(batches):
        key, total, held, extras = None, 0, [], []

        def out():
            group, number = key
            height = most if total > span else steps(total)
            block = Block.build(held, height)
            row = [[group], [tier], [number], [len(held)], [height], [block.data], [extras]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["group", "tier", "block", "leaves", "height", "data", "extras"])

        for batch in batches:
            for g, b, n, x, e in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "n", "digest", "extra")), strict=True):
                if (g, b) != key:
                    if held:
                        yield out()
                    key, total, held, extras = (g, b), n, [], []
                held.append(x)
                extras.append(e)
        if held:
            yield out()

    return d.mapInArrow(run, _BLOCK)


def tree(leaves: DataFrame, counts: DataFrame, height: int) -> list[DataFrame]:
    """The tiers of blocks over ``leaves`` (``_NODE``) of groups with ``counts`` (``group, n``), lowest first, each written down.

    A group leaves the recursion with the tier at which it has one block.
    """
    tiers, span = [], ARITY**height
    while True:
        tiers.append(stage(blocks_of(leaves, counts, len(tiers), height), f"blocks-{len(tiers)}"))
        counts = counts.filter(F.col("n") > span).select("group", F.expr(f"(n + {span - 1}) div {span}").alias("n"))
        if counts.isEmpty():
            return tiers
        up = counts.select(F.col("group").alias("up"))
        leaves = tiers[-1].join(small(up), F.col("group") == F.col("up"), "left_semi").select("group", F.col("block").alias("idx"), F.substring("data", 1, DIGEST).alias("digest"), F.lit(None).cast("binary").alias("extra"))


_PATH = T.ArrayType(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("around", T.BinaryType())]))
_PATHS = pa.list_(pa.struct([("left", pa.int32()), ("around", pa.binary())]))


def block_paths(tiers: list[DataFrame], above: DataFrame, height: int) -> list[DataFrame]:
    """For each tier: ``group, block, path``, the siblings from a block's root on to the very top.

    ``above``: ``group, path`` from the group's root on. Top down: what is above a
    block is its place in the block over it and what is above that one.
    """
    span = ARITY**height

    def run(batches):
        for batch in batches:
            for group, number, n, height, data, rest in zip(*(batch.column(c) for c in ("group", "block", "leaves", "height", "data", "path")), strict=True):
                b, rest = Block(data.as_py(), n.as_py(), height.as_py()), rest.as_py()
                paths = [[{"left": k, "around": x} for k, x in b.siblings(i)] + rest for i in range(b.leaves)]
                first = number.as_py() * span
                yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * b.leaves, pa.int64()), pa.array(range(first, first + b.leaves), pa.int64()), pa.array(paths, _PATHS)], ["group", "block", "path"])

    out: list[DataFrame] = []
    for k in range(len(tiers) - 1, -1, -1):
        only = tiers[k].filter("block = 0").select("group", "block")  # groups whose last tier is this one
        if k + 1 < len(tiers):
            only = only.join(small(tiers[k + 1].select("group").distinct()), "group", "left_anti")
        paths = only.join(small(above), "group").select("group", "block", "path")
        if out:
            lower = tiers[k + 1].select("group", "block", "leaves", "height", "data").join(small(out[-1]), ["group", "block"])
            paths = paths.unionByName(lower.mapInArrow(run, T.StructType([T.StructField("group", T.LongType()), T.StructField("block", T.LongType()), T.StructField("path", _PATH)])))
        out.append(stage(paths, "paths"))
    return out[::-1]


# --------------------------------------------------------------------------
# Manifest


class Manifest:
    """The tree over ``leaves`` and the tree over its groups' roots.

    ``leaves`` has ``doc_id`` (long), ``group`` (the group's name as text, null is
    a group, the first one), ``leaf`` (64 hex digits) and ``shown`` (the leaf to
    prove, null: ``leaf``). Leaves ascend by ``doc_id``, null first; equal ids by
    ``leaf``, then ``shown``. ``tiers`` and ``top`` are the stored blocks, with
    ``height`` steps each.
    """

    def __init__(self, leaves: DataFrame, height: int = HEIGHT):
        self.height = height
        d = leaves.select("doc_id", F.col("group").cast("string").alias("of"), F.unhex("leaf").alias("digest"), F.unhex("shown").alias("shown"))
        d, named = numbered(d, F.col("of"), [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("shown").asc_nulls_first()])
        self.named = stage(named, "group-numbers")
        # a leaf carries its id (8 bytes, none: empty) and the digest to prove
        known = F.when(F.col("doc_id").isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")))
        extra = F.concat(F.coalesce("shown", F.unhex(F.lit("00" * DIGEST))), known)
        self.tiers = tree(d.select("group", "idx", "digest", extra.alias("extra")), self.named.select("group", "n"), height)
        none = F.lit(None).cast("binary")
        # a group's root is the root of its only block at its last tier
        roots = None
        for k, t in enumerate(self.tiers):
            r = t.filter("block = 0").select("group", F.substring("data", 1, DIGEST).alias("digest"))
            if k + 1 < len(self.tiers):
                r = r.join(small(self.tiers[k + 1].select("group").distinct()), "group", "left_anti")
            roots = r if roots is None else roots.unionByName(r)
        self.roots = stage(roots, "group-roots")
        n = self.named.agg(F.count("*").alias("n")).withColumn("group", F.lit(0).cast("long"))
        self.top = tree(self.roots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("idx"), "digest", none.alias("extra")), stage(n.filter("n > 0"), "group-count"), height)

    @property
    def root(self) -> bytes | None:
        """The root of all groups; none over an empty table."""
        row = self.top[-1].select(F.substring("data", 1, DIGEST).alias("x")).first()
        return bytes(row.x) if row else None

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

        Siblings are read from the stored blocks by address. ``folded_root`` is what
        ``shown``, or else the leaf, leads to with the stored siblings.
        """
        root = self.root
        if root is None:
            root = bytes(DIGEST)
        empty, span = F.array().cast(_PATH), ARITY**self.height
        top_paths = block_paths(self.top, self.top[-1].select(F.lit(0).cast("long").alias("group"), empty.alias("path")), self.height)
        at_top = self.top[0].select("group", "block", "leaves", "height", "data").join(small(top_paths[0]), ["group", "block"])

        def of_groups(batches):
            for batch in batches:
                for number, n, height, data, rest in zip(*(batch.column(c) for c in ("block", "leaves", "height", "data", "path")), strict=True):
                    b, rest = Block(data.as_py(), n.as_py(), height.as_py()), rest.as_py()
                    first = number.as_py() * span
                    paths = [[{"left": k, "around": x} for k, x in b.siblings(i)] + rest for i in range(b.leaves)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + b.leaves), pa.int64()), pa.array(paths, _PATHS)], ["group", "path"])

        above = stage(at_top.mapInArrow(of_groups, T.StructType([T.StructField("group", T.LongType()), T.StructField("path", _PATH)])), "above-groups")
        paths = block_paths(self.tiers, above, self.height)[0]
        d = self.tiers[0].select("group", "block", "leaves", "height", "data", "extras").join(small(paths), ["group", "block"]).join(small(self.roots.select("group", F.col("digest").alias("subroot"))), "group")

        def prove(batches):
            for batch in batches:
                for n, height, data, extras, rest, subroot in zip(*(batch.column(c) for c in ("leaves", "height", "data", "extras", "path", "subroot")), strict=True):
                    b = Block(data.as_py(), n.as_py(), height.as_py())
                    rest = [(x["left"], x["around"]) for x in rest.as_py()]
                    tail = b"".join(x for _, x in rest).hex().encode()
                    rows = []
                    for i, extra in enumerate(extras.as_py()):
                        leaf, path = b.node(b.height, i), b.siblings(i)
                        shown, known = extra[:DIGEST], extra[DIGEST:]
                        proof = hashlib.sha256(b"".join(x for _, x in path).hex().encode() + tail).hexdigest()
                        got = fold(fold(shown if any(shown) else leaf, path), rest)
                        rows.append((int.from_bytes(known, "big", signed=True) if known else None, leaf.hex(), proof, got.hex(), got == root))
                    ids, leaf, proof, got, right = zip(*rows, strict=True)
                    same = [subroot.as_py().hex()] * len(rows), [root.hex()] * len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (leaf, *same, proof, got)), pa.array(right, pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        return d.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, group, leaf, shown`` of documents: what a check of tampered copies has to prove.

    A leaf hashes ``doc_id, source, lang, n_chars, text``. Where 2 divides the crc32 of
    the decimal id, the copy lacks the newlines of its text; rows without an id are
    never tampered with.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, leaf_hash(*fields, F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("group"), leaf_hash(*fields, text).alias("leaf"), cut.alias("shown"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and the proof of each row; see ``document_leaves`` and ``Manifest``.

    Rows that share an id are leaves of their own, also equal ones; a null id comes
    first and a null source is the first group. An empty table has no rows. Empty and
    very long texts are leaves like others. Further columns are ignored.
    """
    return Manifest(document_leaves(docs)).proofs()
