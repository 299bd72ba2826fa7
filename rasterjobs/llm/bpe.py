"""Byte-pair encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled into a deterministic automaton whose arcs
are labelled with tokens and whose paths are exactly the right tokenizations. It
starts as one state with an arc for each byte. Each merge (a, b), in order, is a
gadget: arcs labelled ``a`` get a target of their own, a copy of the old one without
the arc ``b``; and wherever ``a`` could be read, a new arc ``ab`` leads to where ``b``
leads. All arcs with one label lead to one state, so the automaton is a table from
tokens to states, and from states to the arcs they lack.

Copies share what they lack: a state is a chain of cells, one for each merge. What a
merge takes from a state is ``b`` and each token that begins with ``b`` and is made
later. In an order of tokens by their left parts, latest first, these are one
stretch, so a state's missing arcs are a few stretches.

Encoding a word walks all tokens that match from each place; every prefix of a word
has one right path, so the walk meets each place in one state. Decoding joins the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenpack import WordEncoder, _slices

#: Stretches of states that a worker remembers; forgotten when there are more.
MOST_STRETCHES = 1 << 21
#: Bytes of words that are walked at once; a longer word is walked alone.
TOGETHER = 1 << 17
PLACE_BITS = 32


def pattern(letters: str = r"\p{L}", numbers: str = r"\p{N}") -> str:
    """Fixed value: how a byte-level tokenizer parts texts before merging."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Automaton:
    """Tables by token id, and by cell (one for each merge); a few megabytes for 50,000 tokens.

    ``labels``: bytes of a token. ``state``: the cell at the head of the state that
    its arcs lead to, -1 for the first state. ``place``: its place in the order of
    left parts, -1 if no text has it. ``below``: the next cell of a cell's chain.
    ``lo, hi``: the stretch of places that a cell takes away. ``added``: contents of
    tokens that are found in texts before they are parted. ``pattern`` parts them.
    """

    labels: list[bytes]
    state: np.ndarray
    place: np.ndarray
    below: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    added: dict[str, int]
    pattern: str = pattern()


def compile_merges(labels: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int] | None = None) -> Automaton:
    """The automaton of ``merges`` (left, right and merged token, in order) over the tokens of one byte in ``labels``."""
    state, live = [-1] * len(labels), [False] * len(labels)
    taken, below = [], []  # of a cell: the token it takes away, the next cell
    parent, other, made = ([-1] * len(labels) for _ in range(3))  # left and right part of a token, and the merge that made it
    cell_of: dict[tuple[int, int], int] = {}
    for t, label in enumerate(labels):
        live[t] = len(label) == 1
    for t in (added or {}).values():
        live[t] = False

    def lacks(a: int, token: int) -> bool:
        """The state after ``a`` has no arc ``token``: a cell took it away, or one of its left parts before the next was made.

        Its cells are the merges of ``a`` so far, and those of its right part, and of
        the right part of that, until the whole was made.
        """
        known = len(below)
        while a >= 0:
            until, e = known, token
            while e >= 0:
                if cell_of.get((a, e), known) < min(until, known):
                    return True
                until, e = made[e] + 1, parent[e]
            known, a = made[a], other[a]
        return False

    for a, b, c in merges:
        head, rank = state[a], len(below)
        if not live[a] or not live[b] or live[c] or lacks(a, b):
            continue  # no text has a before b
        beyond = state[b]
        taken.append(b)
        below.append(head)
        cell_of[a, b] = rank
        state[a], state[c] = rank, beyond
        live[c], parent[c], other[c], made[c] = True, a, b, rank

    # tokens in the order of their left parts, the children made last first
    children: dict[int, list[int]] = {}
    for t, p in enumerate(parent):
        if p >= 0:
            children.setdefault(p, []).append(t)
    for c in children.values():
        c.sort(key=lambda t: made[t])  # a stack takes the last first
    place, end = [-1] * len(labels), [-1] * len(labels)
    count = 0
    todo = [(t, False) for t in range(len(labels)) if live[t] and parent[t] < 0]
    while todo:
        t, done = todo.pop()
        if done:
            end[t] = count
            continue
        place[t], count = count, count + 1
        todo.append((t, True))
        todo += [(c, False) for c in children.get(t, ())]
    ranks = {t: [made[c] for c in cs] for t, cs in children.items()}
    hi = []
    for cell, b in enumerate(taken):
        earlier = bisect_left(ranks.get(b, ()), cell)  # children of b that were made before stay
        hi.append(place[children[b][earlier - 1]] if earlier else end[b])
    lo = [place[b] for b in taken]
    return Automaton(labels, *(np.array(x, np.int32) for x in (state, place, below, lo, hi)), added or {})


def load(path: str) -> Automaton:
    """Compile a byte-level BPE file of the tokenizers library. The file is read here, on the driver, and nowhere else."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, plain = spec["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    flags = [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
    if model["type"] != "BPE" or odd or flags or spec["normalizer"] or {k: (spec["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
        raise ValueError(f"not a plain byte-level BPE: {path} {odd} {flags}")
    byte = byte_alphabet()
    vocab, added = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for text, t in [*vocab.items(), *added.items()]:
        labels[t] = bytes(byte[c] for c in text) if all(c in byte for c in text) else text.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len({x for x in labels if len(x) == 1}) < 256:
        raise ValueError(f"bytes without a token: {path}")
    automaton = compile_merges(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], added)
    automaton.pattern = pattern_of_library()
    return automaton


@lru_cache(maxsize=1)
def pattern_of_library() -> str:
    """``pattern`` for letters and numbers as the tokenizers library knows them.

    Libraries follow Unicode at their own pace. Characters that Python does not know
    yet and that are letters or numbers to ``regex`` are shown to the library once;
    those that it doesn't take for such are taken out of the classes.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    new = "".join(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    out = {"L": [], "N": []}
    for kind, before in (("L", "a"), ("N", "1")):
        for c in regex.findall(rf"\p{{{kind}}}", new):
            if len(split(before + c)) > 1:
                out[kind].append(ord(c))
    classes = []
    for kind, codes in out.items():
        edges = [i for i in range(len(codes)) if not i or codes[i] != codes[i - 1] + 1] + [len(codes)]
        runs = "".join(rf"\U{codes[a]:08X}-\U{codes[b - 1]:08X}" for a, b in zip(edges[:-1], edges[1:], strict=True))
        classes.append(rf"[\p{{{kind}}}--[{runs}]]" if codes else rf"\p{{{kind}}}")
    return pattern(*classes)


class Walker:
    """Walks an automaton over many words at once, with tables that numpy reads."""

    def __init__(self, automaton: Automaton):
        self.state, self.place = automaton.state, automaton.place.astype(np.int64)
        self.size = np.array([len(x) for x in automaton.labels], np.int64)
        self.below, self.lo, self.hi = automaton.below.tolist(), automaton.lo.tolist(), automaton.hi.tolist()
        # a trie of the labels: node and byte to node
        nxt: dict[int, int] = {}
        token = [-1]
        special = set(automaton.added.values())
        for t, label in enumerate(automaton.labels):
            if t in special or automaton.place[t] < 0:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                node = nxt.get(key, 0)
                if not node:
                    node = nxt[key] = len(token)
                    token.append(-1)
            token[node] = t
        self.token = np.array(token, np.int64)
        keys = np.fromiter(nxt, np.int64, len(nxt))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(nxt.values(), np.int64, len(nxt))[order]
        self.pair = np.zeros(1 << 16, np.int64)
        for x in range(256):
            lo, hi = np.searchsorted(self.keys, [nxt.get(x, 0) << 8, (nxt.get(x, 0) + 1) << 8])
            if nxt.get(x):
                self.pair[x << 8 | (self.keys[lo:hi] & 255)] = self.nodes[lo:hi]
        self.single = np.array([nxt.get(x, 0) for x in range(256)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.row = np.full(len(self.below) + 1, -1, np.int64)
        self.rows = 0
        self.starts, self.ends = np.array([-1], np.int64), np.zeros(1, np.int64)

    def _learn(self, heads: np.ndarray) -> None:
        """The stretches of places that states lack, each row sorted and put together."""
        starts, ends = [self.starts], [self.ends]
        for head in heads.tolist():
            both, at = [], head
            while at >= 0:
                both.append((self.lo[at], self.hi[at]))
                at = self.below[at]
            mine: list[list[int]] = []
            for lo, hi in sorted(both):
                if mine and lo <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], hi)
                else:
                    mine.append([lo, hi])
            found = np.array(mine, np.int64).reshape(-1, 2)
            starts.append(found[:, 0] + (self.rows << PLACE_BITS))
            ends.append(found[:, 1])
            self.row[head], self.rows = self.rows, self.rows + 1
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)

    def has_arc(self, heads: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the states have arcs with these labels; the first state has all."""
        if len(self.starts) > MOST_STRETCHES:
            self._forget()
        new = heads[self.row[heads] < 0]
        if len(new):
            self._learn(np.unique(new[new >= 0]))
        row, place = self.row[heads], self.place[tokens]
        at = np.searchsorted(self.starts, (row << PLACE_BITS) + place, "right") - 1
        return (heads < 0) | (self.starts[at] >> PLACE_BITS != row) | (place >= self.ends[at])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after the other, and their number for each word."""
        ids, counts, lo, size = [], [], 0, 0
        for hi in range(len(words) + 1):
            if hi == len(words) or size + len(words[hi]) > TOGETHER:
                if lo < hi:
                    x, n = self._walk(words[lo:hi])
                    ids.append(x)
                    counts.append(n)
                lo, size = hi, 0
            size += len(words[hi]) if hi < len(words) else 0
        none = np.empty(0, np.int64)
        return np.concatenate([none, *ids]), np.concatenate([none, *counts])

    def _walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lens = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lens) - lens
        word = np.repeat(np.arange(len(words)), lens)
        left = np.repeat(starts + lens, lens) - np.arange(len(data))
        # tokens that match from each byte
        at, node = np.arange(len(data)), self.single[data]
        found, depth = [], 1
        while len(at):
            t = self.token[node]
            hit = t >= 0
            found.append((at[hit], t[hit]))
            more = left[at] > depth
            at, node = at[more], node[more]
            if depth == 1:
                node = self.pair[data[at] << 8 | data[at + 1]]
                more = node > 0
            else:
                key = node << 8 | data[at + depth]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                more = self.keys[place] == key
                node = self.nodes[place]
            at, node, depth = at[more], node[more], depth + 1
        at, t = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        # all words step by step; a word has a border before, between and after its bytes
        inside = at - starts[word[at]]
        order = np.argsort(inside, kind="stable")
        at, t, inside = at[order], t[order], inside[order]
        begin = at + word[at]
        end = begin + self.size[t]
        heads, via = np.full(len(data) + len(words), -2, np.int64), np.zeros(len(data) + len(words), np.int64)
        first = starts + np.arange(len(words))
        heads[first] = -1
        cut = np.searchsorted(inside, np.arange(int(lens.max(initial=0)) + 1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            ok = self.has_arc(heads[begin[lo:hi]], t[lo:hi])
            to = end[lo:hi][ok]
            via[to] = t[lo:hi][ok]
            heads[to] = self.state[via[to]]
        # back along the arcs
        passed = np.zeros(len(via), bool)
        here, floor = first + lens, first
        while len(here):
            on = here > floor
            here, floor = here[on], floor[on]
            passed[here] = True
            here = here - self.size[via[here]]
        return via[passed], np.bincount(np.repeat(np.arange(len(words)), lens + 1)[passed], minlength=len(words))


class AutomatonEncoder(WordEncoder):
    """Encodes texts by a ``Walker``; parts and remembers words as ``WordEncoder`` does, without its library."""

    def __init__(self, automaton: Automaton):
        self.walker = Walker(automaton)
        self.pattern = regex.compile(automaton.pattern, regex.V1)
        self.specials = automaton.added
        self.added = list(automaton.added)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.newline = len(self._encode(["\n"])[0])
        lengths = np.array([len(x) for x in automaton.labels], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(automaton.labels), np.uint8)
        self._forget()

    @property
    def size(self) -> int:
        return len(self.lengths)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.encode() for p in pieces]
        return self.walker.encode(words)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts: added tokens are found first, what stands between them is parted and walked."""
        out = []
        for text in texts:
            ids, at = [], 0
            for m in self.marks.finditer(text) if self.marks else ():
                ids += [*self._ids(self.pattern.findall(text[at : m.start()]))[0].tolist(), self.specials[m.group()]]
                at = m.end()
            out.append(ids + self._ids(self.pattern.findall(text[at:] if at else text))[0].tolist())
        return out

    def _learn(self, words: list[str]) -> None:
        pieces, counts = [], []
        for w in words:
            before = len(pieces)
            if w[0] == " " and w[1:].isalpha():
                pieces.append(w)
            elif w[0] == "\n" and w[1:].isalpha():
                pieces += ["\n", w[1:]]
            else:
                pieces += self.pattern.findall(w)
            counts.append(len(pieces) - before)
        if words:
            ids, n = self._ids(pieces)
            self._add(words, ids.tolist(), np.cumsum(n)[np.cumsum(counts) - 1])

    def decode(self, docs: list[np.ndarray]) -> list[str]:
        """The text of each list of ids: labels joined, bytes that are no UTF-8 replaced."""
        if not docs:
            return []
        ids = np.concatenate(docs).astype(np.int64)
        size = self.lengths[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(ids) else 0
        data = self.bytes[np.repeat(self.begins[ids] - (upto - size), size) + np.arange(total)].tobytes()
        cut = np.append(0, upto)[np.cumsum([0, *map(len, docs)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


_last: list = []


def _encoder(automaton: Automaton) -> AutomatonEncoder:
    """One encoder for each worker process and automaton; the last one is kept."""
    if not _last or _last[0] is not automaton:
        _last[:] = automaton, AutomatonEncoder(automaton)
    return _last[1]


def _mapped(docs: DataFrame, doc_id: str, value: Column, automaton: Automaton, parts, finish, schema: str) -> DataFrame:
    """``finish`` gets the encoder and the values of a few rows, as ``parts`` cuts them, and returns columns by name."""
    d = docs.select(F.col(doc_id).alias("id"), value.alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(automaton)  # as large as the vocabulary

    def run(batches):
        enc = _encoder(sent.value)
        for batch in batches:
            at = 0
            for some, values in parts(batch):
                cols = finish(enc, values)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(some)), *cols.values()], ["id", *cols])
                at += len(some)

    return d.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", doc_id)


def encode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text; null texts are empty. Repeated rows repeat, a null id stays null."""

    def finish(enc, texts):
        return {"ids": pa.array([x.astype(np.int32) for x in enc.batch(texts)], pa.list_(pa.int32()))}

    return _mapped(docs, doc_id, F.col(text).cast("string"), load(tokenizer), _slices, finish, "ids array<int>")


def decode(tokens: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row of token ids (as ``encode`` gives them), added tokens included; null ids are an empty text."""

    def finish(enc, rows):
        return {"text": pa.array(enc.decode([np.array(x or [], np.int64) for x in rows]), pa.string())}

    def rows(batch):
        for lo in range(0, batch.num_rows, 64):
            part = batch.column("text").slice(lo, 64)
            yield range(len(part)), part.to_pylist()

    return _mapped(tokens, doc_id, F.col(ids).cast("array<int>"), load(tokenizer), rows, finish, "text string")


def round_trip(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text: encoded, then decoded from the ids alone.

    One pass over the texts without a shuffle. Null and empty texts have no tokens
    and decode to an empty text. A very long text costs memory for its own ids and
    bytes. Repeated rows repeat; a null id stays null; further columns are ignored.
    """

    def finish(enc, texts):
        found = enc.batch(texts)
        back = enc.decode(found)
        return {
            "n_tokens": pa.array([len(x) for x in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
        }

    return _mapped(docs, doc_id, F.col(text).cast("string"), load(tokenizer), _slices, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
