"""The Merkle manifest against a plain tree, and its layout."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import merkle, queries


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _around(levels, at):
    """(siblings before, siblings after) from the lowest level up."""
    out = []
    for row in levels[:-1]:
        lo = at - at % 3
        out.append((row[lo:at], row[at + 1 : lo + 3]))
        at //= 3
    return out


def _brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted results."""
    def leaf(*values):
        return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for i, source, lang, n, text in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        shown = leaf(i, source, lang, n, None if text is None else text.replace("\n", "")) if even else None
        groups.setdefault(source, []).append((i, leaf(i, source, lang, n, text), shown))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], (r[2] is not None, r[2] or "")))
        trees[s] = _levels([r[1] for r in groups[s]])
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for at, (i, own, shown) in enumerate(groups[s]):
            path = _around(trees[s], at) + _around(top, g)
            x = shown or own
            for lo, hi in path:
                x = _h(*lo, x, *hi)
            out.append((i, own, trees[s][-1][0], top[-1][0], _h(*(y for lo, hi in path for y in lo + hi)), x, x == top[-1][0]))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", range(1, 8))
def test_places_are_a_permutation_split_at_half_height(levels):
    flat = [int(x) for row in merkle.places(levels) for x in row]
    assert sorted(flat) == list(range(merkle.nodes(levels))) and flat[0] == 0
    if levels > 1:
        top, below = levels // 2, levels - levels // 2
        assert {int(x) for row in merkle.places(levels)[:top] for x in row} == set(range(merkle.nodes(top)))
        first = {int(row[i]) for k, row in enumerate(merkle.places(levels)[top:]) for i in range(3**k)}
        assert first == set(range(merkle.nodes(top), merkle.nodes(top) + merkle.nodes(below)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80])
def test_a_block_is_the_plain_tree(n):
    nodes = [_h(str(i)) for i in range(n)]
    levels = _levels(nodes)
    b = merkle.Block.build([bytes.fromhex(x) for x in nodes], merkle.steps(n))
    assert b.height == len(levels) - 1 and b.root.hex() == levels[-1][0]
    for i in range(n):
        want = _around(levels, i)
        assert [(k, x.hex()) for k, x in b.siblings(i)] == [(len(lo), "".join(lo + hi)) for lo, hi in want]
        assert merkle.fold(bytes.fromhex(nodes[i]), b.siblings(i)) == b.root


def _rows(n, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "z", "\U0001f600", *(f"s{i}" for i in range(8))]
    rows = [(rng.choice([i, i, i, i // 2, None]), "hot" if rng.random() < 0.4 else rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["a\nb", "\n", "", None, "x" * 3000 + "\n", "ü\r\n"])) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("n,height", [(400, 1), (400, 2), (1, 6), (2, 1)])
def test_manifest_against_a_plain_tree(spark, n, height):
    rows = _rows(n, n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("group", "leaf", "shown", "idx", "at", "name", "block", "digest", "n"):
        df = df.withColumn(c, F.lit("clash"))
    m = merkle.Manifest(merkle.document_leaves(df), height)
    assert _got(m.proofs()) == _brute(rows)
    if n == 400:
        assert len(m.tiers) > 2


def test_a_group_of_several_blocks(spark):
    rows = [(i, "one" if i < 2300 else f"s{i % 900}", "en", 1, f"text\n{i}") for i in range(3500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _got(merkle.verify_documents(df)) == _brute(rows)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    m = merkle.Manifest(merkle.document_leaves(docs))
    assert m.root is None and m.proofs().collect() == []


def test_op11_matches_sql(same):
    same(queries.op11_merkle_manifest, queries.OP11)
