"""Bit-level entropy decoding.

A restart interval is decoded by one task, but a long one is cut into chunks of
bytes that are decoded apart. Where a chunk's first unit begins, and which unit of an
MCU it is, hangs on all bytes before. Decoding from a wrong place soon fails, or falls
into step with the right one, as Huffman codes do, so each chunk is first walked from
every place where it may begin, for a few guesses at where the next one begins. Then each chunk is walked exactly
from what was guessed for it; these steps are put together in order, and what is
missing in the chain is walked again, until every chunk has its true beginning.
Only then are units decoded, all chunks at once.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


class BadData(Exception):
    """The reason why an interval stops decoding."""


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> array:
    """For every 16 next bits: code length * 256 + symbol, or 0 where no code begins (128 KiB)."""
    out = np.zeros(1 << 16, np.uint16)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return array("H", out.tobytes())


class Bits:
    """Reads bits from the most significant end; raises at the end of the data."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.at, self.held, self.n, self.left = data + bytes(8), start >> 3, 0, 0, 8 * len(data) - (start & ~7)
        self.take(start & 7)

    def _fill(self) -> None:
        self.held = (self.held << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")) & 0xFFFFFFFFFFFFFFFF
        self.at, self.n = self.at + 4, self.n + 32

    def symbol(self, table: array, bad: str) -> int:
        if self.n < 16:
            self._fill()
        x = table[self.held >> (self.n - 16) & 0xFFFF]
        if not x:
            raise BadData(bad if self.left >= 16 else "exhausted")
        length = x >> 8
        self.n -= length
        self.left -= length
        if self.left < 0:
            raise BadData("exhausted")
        return x & 255

    def take(self, k: int) -> int:
        if self.n < k:
            self._fill()
        self.n -= k
        self.left -= k
        if self.left < 0:
            raise BadData("exhausted")
        return self.held >> self.n & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        v = self.take(k)
        return v - (1 << k) + 1 if k and v < 1 << (k - 1) else v


def _dc(bits: Bits, table: list[int]) -> int:
    size = bits.symbol(table, "bad_dc_symbol")
    if size > 11:
        raise BadData("dc_length")
    return bits.signed(size)


def _baseline(bits: Bits, dc: list[int], ac: list[int]) -> tuple[int, list[int], list[int]]:
    """DC difference, positions and values of a unit."""
    diff, pos, values = _dc(bits, dc), [], []
    i = 1
    while i < 64:
        s = bits.symbol(ac, "bad_ac_symbol")
        if not s:
            break
        run, size = s >> 4, s & 15
        if i + run >= 64:
            raise BadData("zero_run")
        if size > 10:
            raise BadData("ac_length")
        pos.append(i + run)
        values.append(bits.signed(size))
        i += run + 1
    return diff, pos, values


def decode_interval(data: bytes, cells: list[tuple[int, list[int] | None, list[int] | None]], units: int, progressive: bool = False, ss: int = 0, se: int = 63, ah: int = 0, al: int = 0, start: int = 0, cell: int = 0, end: int | None = None, whole: bool = False):
    """Units of an interval as (component, dc_diff, positions, values, error), until an error ends it.

    ``cells``: component, DC and AC lookup of each unit of an MCU, in order. The
    first unit begins at bit ``start`` with ``cell``; none begins at bit ``end`` or later,
    or with ``whole`` no MCU.
    Positions are those of the values in scan order. A progressive scan decodes its
    own part on coefficients that are all zero.
    """
    bits, skips = Bits(data, start), 0
    stop = 0 if end is None else 8 * len(data) - end  # bits left where units may begin no more
    for k in range(units):
        if end is not None and bits.left <= stop and not (whole and (cell + k) % len(cells)):
            return
        component, dc, ac = cells[(cell + k) % len(cells)]
        diff, pos, values = 0, [], []
        try:
            if not progressive:
                diff, pos, values = _baseline(bits, dc, ac)
            elif ss == 0:
                diff = bits.take(1) if ah else _dc(bits, dc)
            elif skips:
                skips -= 1
            else:
                i = ss
                while i <= se:
                    s = bits.symbol(ac, "bad_ac_symbol")
                    run, size = s >> 4, s & 15
                    if not size and run < 15:
                        skips = (1 << run) - 1 + bits.take(run)
                        break
                    if not ah and i + run > se:
                        raise BadData("zero_run")
                    if ah and size > 1:
                        raise BadData("bad_ac_symbol")
                    if size > 10:
                        raise BadData("ac_length")
                    value = (1 if bits.take(1) else -1) << al if ah and size else bits.signed(size) * (1 << al) if size else 0
                    i += run
                    if value and i <= se:
                        pos.append(i)
                        values.append(value)
                    i += 1
        except BadData as e:
            yield component, 0, [], [], str(e)
            return
        yield component, diff, pos, values, None


# --------------------------------------------------------------------------
# Chunks of long intervals

#: Bytes of a chunk; longer baseline intervals are cut.
CHUNK = 1 << 16
#: Chunks whose steps a task holds at once.
CHUNKS = 256
#: Bytes after a chunk that a unit begun in it may need: 64 codes and values of 27 bits at most.
TAIL = 216
#: From so few places walks go on one by one.
FEW = 32
#: Bytes of chunks that are walked in step.
STEP_BYTES = 1 << 15
#: Intervals of an image that share a copy of its tables.
GROUP = 64

Lookups = list[tuple[int, array | None, array | None]]


def _kinds(cells: Lookups) -> list[int]:
    """Of each cell, the first cell that has the same tables."""
    same: dict = {}
    return [same.setdefault((id(dc), id(ac)), k) for k, (_, dc, ac) in enumerate(cells)]


class _Walker:
    """Units of a chunk as (bit after it, DC difference), none where the data can't be decoded; each is decoded once."""

    def __init__(self, data: bytes, cells: Lookups):
        self.data, self.cells, self.kinds, self.known, self.bits = data, cells, _kinds(cells), {}, Bits(data)

    def unit(self, at: int, cell: int) -> tuple[int, int] | None:
        key = at, self.kinds[cell]
        if key not in self.known:
            if 8 * len(self.data) - self.bits.left != at:
                self.bits = Bits(self.data, at)
            try:
                diff = _baseline(self.bits, *self.cells[cell][1:])[0]
                self.known[key] = 8 * len(self.data) - self.bits.left, diff
            except BadData:
                self.known[key] = None
        return self.known[key]


def unit_ends(data: bytes, dc: array, ac: array, starts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The bit after the unit that begins at each of ``starts``, -1 where none ends up to bit ``most``; all in step."""
    dc, ac = np.frombuffer(dc, np.uint16), np.frombuffer(ac, np.uint16)
    x = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    words = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]

    def codes(table, at):
        x = table[words[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & 0xFFFF].astype(np.int64)
        return x > 0, at + (x >> 8), x & 255

    out = np.full(len(starts), -1, np.int64)
    fine, at, size = codes(dc, starts)
    at = at + size
    left = np.flatnonzero(fine & (size <= 11) & (at <= most))
    at, most, i = at[left], most[left], np.ones(len(left), np.int64)
    while len(left):
        fine, at, symbol = codes(ac, at)
        run, size = symbol >> 4, symbol & 15
        last = symbol == 0
        at = at + size
        i = i + run + 1
        fine &= (at <= most) & (last | (i <= 64) & (size <= 10))
        done = fine & (last | (i == 64))
        out[left[done]] = at[done]
        on = fine & ~done
        left, at, most, i = left[on], at[on], most[on], i[on]
    return out


def guesses(chunks: list[bytes], cells: Lookups, ends: list[int]) -> list[set[tuple[int, int]]]:
    """Where the chunk after each of ``chunks`` may begin: (bits after its end, cell).

    Walks begin at every bit at which a chunk may begin, as each cell of an MCU. A unit of
    the chunk before ends within ``TAIL`` bytes, so what the true walk leads to is among
    them. Walks from wrong bits soon fail or meet others; while there are many, those of
    all chunks go on in step, and the last ones one by one.
    """
    n, kinds = len(cells), np.array(_kinds(cells))
    data = b"".join(x + bytes(8) for x in chunks)  # apart, as codes are looked up 32 bits at a time
    base = 8 * np.cumsum([0, *(len(x) + 8 for x in chunks)])[:-1]
    most, end = base + [8 * len(x) for x in chunks], base + ends
    out: list[set[tuple[int, int]]] = [set() for _ in chunks]

    def leave(chunk, at, cell):
        for c, bit, to in zip(chunk.tolist(), (at - end[chunk]).tolist(), cell.tolist(), strict=True):
            out[c].add((bit, to))

    first = np.concatenate([np.arange(a, a + min(b, 8 * TAIL)) for a, b in zip(base.tolist(), ends, strict=True)])
    state = (first[:, None] * n + np.arange(n)).ravel()  # bit and cell in one number
    while True:
        at, cell = np.divmod(state, n)
        chunk = np.searchsorted(base, at, "right") - 1
        over = at >= end[chunk]
        leave(chunk[over], at[over], cell[over])
        at, cell, chunk = at[~over], cell[~over], chunk[~over]
        if len(np.unique(at)) <= FEW:
            break
        found = []
        for k in np.unique(kinds[cell]):
            here = kinds[cell] == k
            starts, one, which = np.unique(at[here], return_index=True, return_inverse=True)
            after = unit_ends(data, *cells[k][1:], starts, most[chunk[here][one]])[which]
            found.append((after * n + (cell[here] + 1) % n)[after >= 0])
        state = np.unique(np.concatenate(found))
    walkers, seen = {}, set()
    for c, at, cell in zip(chunk.tolist(), (at - base[chunk]).tolist(), cell.tolist(), strict=True):
        walker = walkers.setdefault(c, _Walker(chunks[c], cells))
        while at < ends[c] and (c, at, cell) not in seen:
            seen.add((c, at, cell))
            unit = walker.unit(at, cell)
            if unit is None:
                break
            at, cell = unit[0], (cell + 1) % n
        if at >= ends[c]:
            out[c].add((at - ends[c], cell))
    return out


def guess(data: bytes, cells: Lookups, end: int) -> set[tuple[int, int]]:
    """``guesses`` of one chunk."""
    return guesses([data], cells, [end])[0]


def components(cells) -> list[int]:
    """The components of an MCU, each once; DC sums stand in this order."""
    return sorted({c[0] for c in cells})


def walk(data: bytes, cells: Lookups, end: int, entries, sums: dict | None = None) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each entry (bit, cell) of a chunk: where the next one begins, and the units in between.

    (-1, 0, units) where the data can't be decoded so far. Walks that meet go on as one.
    ``sums`` gets the DC differences of each entry's units, added up by component.
    """
    out, met = {}, {}
    order = components(cells)
    place = [order.index(c[0]) for c in cells]
    walker = _Walker(data, cells)
    for entry in entries:
        (at, cell), units, path, total = entry, 0, [], [0] * len(order)
        while True:
            if (at, cell) in met:
                bit, to, more, rest = met[at, cell]
                exit_ = (bit, to, units + more)
                total = [a + b for a, b in zip(total, rest, strict=True)]
                break
            if at >= end:
                exit_ = (at - end, cell, units)
                break
            path.append((at, cell, units, *total))
            unit = walker.unit(at, cell)
            if unit is None:
                exit_ = (-1, 0, units)
                break
            total[place[cell]] += unit[1]
            at, cell, units = unit[0], (cell + 1) % len(cells), units + 1
        for a, c, n, *before in path:
            met[a, c] = (*exit_[:2], exit_[2] - n, [x - y for x, y in zip(total, before, strict=True)])
        out[entry] = exit_
        if sums is not None:
            sums[entry] = total
    return out


def _lookups(cells: list[dict]) -> Lookups:
    return [(c["component"], *(lookup(tuple(c[f"{k}_counts"]), tuple(c[f"{k}_symbols"])) if c[f"{k}_counts"] else None for k in ("dc", "ac"))) for c in cells]


_KEY = ["image_id", "interval_no", "chunk_no"]
_STEPS = pa.list_(pa.struct([*((n, pa.int32()) for n in ("bit", "cell", "to_bit", "to_cell", "units")), ("sums", pa.list_(pa.int64()))]))
_STEP = "array<struct<bit:int,cell:int,to_bit:int,to_cell:int,units:int,sums:array<bigint>>>"


def _walked(chunks: DataFrame, exact: bool) -> DataFrame:
    """``image_id, interval_no, chunk_no, steps``: of exact walks from ``entries``, or with guesses as ``to_bit, to_cell``."""
    kind = chunks.schema["image_id"].dataType.simpleString()

    def walks(batch):
        tables, use = None, None  # neighbours mostly have equal tables
        for data, n, cells, entries in zip(*(batch.column(c) for c in ("data", "bytes", "cells", "entries")), strict=True):
            if tables is None or not cells.equals(tables):
                tables, use = cells, _lookups(cells.as_py())
            sums: dict = {}
            found = walk(data.as_py(), use, 8 * n.as_py(), sorted({(e["bit"], e["cell"]) for e in entries.as_py()}), sums)
            yield [{"bit": b, "cell": c, "to_bit": x, "to_cell": y, "units": u, "sums": sums[b, c]} for (b, c), (x, y, u) in found.items()]

    def guessed(batch):
        rows, known = list(zip(batch.column("data").to_pylist(), batch.column("bytes").to_pylist(), batch.column("cells"), strict=True)), None
        at = 0
        while at < len(rows):
            tables, to, size = rows[at][2], at, 0
            while to < len(rows) and (to == at or size + len(rows[to][0]) <= STEP_BYTES) and rows[to][2].equals(tables):
                to, size = to + 1, size + len(rows[to][0])
            known = known if known and tables.equals(known[0]) else (tables, _lookups(tables.as_py()))
            for found in guesses([r[0] for r in rows[at:to]], known[1], [8 * r[1] for r in rows[at:to]]):
                yield [{"bit": 0, "cell": 0, "to_bit": x, "to_cell": y, "units": 0, "sums": []} for x, y in sorted(found)]
            at = to

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, CHUNKS) for k in range(0, batch.num_rows, CHUNKS)):
                steps = list((walks if exact else guessed)(part))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _KEY), pa.array(steps, _STEPS)], [*_KEY, "steps"])

    return chunks.select(*_KEY, "data", "bytes", "cells", "entries").mapInArrow(run, f"image_id {kind}, interval_no int, chunk_no int, steps {_STEP}")


def _chain(steps: DataFrame) -> DataFrame:
    """``image_id, interval_no, chunk_no, bit, cell, first, sums``: the true beginnings that ``steps`` lead to, the units before them and the DC values there (empty: 0).

    A group has a few numbers for each chunk of one interval.
    """
    kind = steps.schema["image_id"].dataType.simpleString()

    def fold(key, group: pa.Table) -> pa.Table:
        known: dict[int, dict] = {}
        for chunk, some in zip(group.column("chunk_no").to_pylist(), group.column("steps").to_pylist(), strict=True):
            known.setdefault(chunk, {}).update({(s["bit"], s["cell"]): (s["to_bit"], s["to_cell"], s["units"], s["sums"]) for s in some})
        rows, at, first, sums, chunk = [], (0, 0), 0, [], 0
        while at[0] >= 0:
            rows.append((chunk, *at, first, sums))
            if at not in known.get(chunk, {}):
                break
            *at, units, more = known[chunk][at]
            sums = [a + b for a, b in zip(sums or [0] * len(more), more, strict=True)]
            at, first, chunk = tuple(at), first + units, chunk + 1
        cols = list(zip(*rows, strict=True))
        n = len(rows)
        return pa.table({"image_id": pa.array([key[0].as_py()] * n, group.schema.field("image_id").type), "interval_no": pa.array([key[1].as_py()] * n, pa.int32()), **{c: pa.array(x, k) for c, x, k in zip(("chunk_no", "bit", "cell", "first", "sums"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)}})

    return steps.groupBy("image_id", "interval_no").applyInArrow(lambda key, group: fold(key, group), f"image_id {kind}, interval_no int, chunk_no int, bit int, cell int, first bigint, sums array<bigint>")


def cut_intervals(intervals: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk_no, chunks, bytes, data`` in place of ``data``: the bytes of each chunk, and what an MCU begun in it may need more."""
    n = F.ceil(F.greatest(F.length("data"), F.lit(1)) / chunk_bytes).cast("int")
    rows = intervals.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    size = F.least(F.lit(chunk_bytes), F.length("data") - F.col("chunk_no") * chunk_bytes)
    return rows.withColumn("bytes", size).withColumn("data", F.substring("data", F.col("chunk_no") * chunk_bytes + 1, chunk_bytes + TAIL * F.size("cells")))


def _dealt(chunks: DataFrame) -> DataFrame:
    """``chunks`` in as many tasks as shuffles have: their bytes are few for the time they take, so the planner would put them together."""
    return chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY)


def beginnings(chunks: DataFrame) -> DataFrame:
    """``image_id, interval_no, chunk_no, bit, cell, first, sums`` of every chunk that the data can be decoded up to.

    ``chunks`` are written down. Each round walks the entries that are known for a
    chunk and not walked yet: first the guesses, later what exact walks lead to.
    The chain from the first chunk on grows with every round and is exact; the
    rounds end when no chain stops for want of a step.
    """
    inner = chunks.filter("chunk_no < chunks - 1")  # where the last one ends does not matter
    places = F.transform("steps", lambda s: F.struct(s.to_bit.alias("bit"), s.to_cell.alias("cell")))
    none = F.array().cast("array<struct<bit:int,cell:int>>")
    guessed = stage(_walked(_dealt(inner.withColumn("entries", none)), False), "guesses")
    start = chunks.filter("chunk_no = 0").select(*_KEY, F.array(F.struct(F.lit(0).alias("bit"), F.lit(0).alias("cell"))).alias("entries"))
    entries = guessed.select("image_id", "interval_no", (F.col("chunk_no") + 1).alias("chunk_no"), places.alias("entries")).unionByName(start)
    steps = None
    while True:
        new = stage(_walked(_dealt(inner.join(entries, _KEY)), True), "steps")
        steps = new if steps is None else steps.unionByName(new)
        known = steps.groupBy(*_KEY).agg(F.flatten(F.collect_list("steps")).alias("steps"))  # a chunk has few
        chain = stage(_chain(known), "chain")
        last = chain.groupBy("image_id", "interval_no").agg(F.max_by(F.struct(*_KEY[2:], "bit", "cell"), "chunk_no").alias("x"))
        stops = last.join(inner.select(*_KEY), [F.col("x.chunk_no") == inner["chunk_no"], last["image_id"] == inner["image_id"], last["interval_no"] == inner["interval_no"]]).select(last["image_id"], last["interval_no"], "x")
        stops = stops.join(known.withColumnRenamed("chunk_no", "at"), (stops["image_id"] == known["image_id"]) & (stops["interval_no"] == known["interval_no"]) & (F.col("x.chunk_no") == F.col("at")), "left")
        lacks = ~F.exists(F.coalesce("steps", F.array().cast(_STEP)), lambda s: (s.bit == F.col("x.bit")) & (s.cell == F.col("x.cell")))
        if stops.filter(lacks).isEmpty():
            return chain
        after = known.select("image_id", "interval_no", (F.col("chunk_no") + 1).alias("chunk_no"), F.filter(places, lambda p: p.bit >= 0).alias("next"))
        own = known.select(*_KEY, F.transform("steps", lambda s: F.struct(s.bit.alias("bit"), s.cell.alias("cell"))).alias("own"))
        entries = after.join(own, _KEY, "left").select(*_KEY, F.array_except("next", F.coalesce("own", none)).alias("entries")).filter("size(entries) > 0")


def with_tables(intervals: DataFrame, tables: DataFrame) -> DataFrame:
    """``intervals`` with the columns of their image's row in ``tables``.

    A table row is copied for each ``GROUP`` intervals, so intervals are dealt out once,
    by image and group, and a large image is many tasks. ``intervals`` are written down.
    A merge join: the planner may take entropy bytes for the side to broadcast.
    """
    df = intervals.withColumn("_group", F.floor(F.col("interval_no") / GROUP))
    copies = df.select("image_id", "_group").distinct().join(tables, "image_id")
    return df.join(copies.hint("merge"), ["image_id", "_group"]).drop("_group")


def decodable(intervals: DataFrame, tables: DataFrame, chunk_bytes: int) -> list[DataFrame]:
    """Rows that tasks can decode apart: whole intervals, and chunks of long ones if there are any.

    Both have ``bit, cell, first, sums, bytes``: where to begin, with which unit of an MCU,
    after how many units, from which DC values, and the bytes in which units may begin (null: all).
    """
    df = with_tables(intervals.select("image_id", "interval_no", "data"), tables)
    begin = [F.lit(x).cast(k).alias(n) for n, x, k in (("bit", 0, "int"), ("cell", 0, "int"), ("first", 0, "bigint"), ("bytes", None, "int"))]
    begin.append(F.array().cast("array<bigint>").alias("sums"))
    long = (F.length("data") > chunk_bytes) & (F.col("frame_type") == 0)
    cut = df.filter(long)
    if cut.select("image_id").isEmpty():
        return [df.select("*", *begin)]
    chunks = stage(_dealt(cut_intervals(cut, chunk_bytes)), "chunks")
    inside = _dealt(chunks.join(beginnings(chunks), _KEY))
    inside = inside.withColumn("bytes", F.when(F.col("chunk_no") < F.col("chunks") - 1, F.col("bytes"))).drop("chunk_no", "chunks")
    return [df.filter(~F.coalesce(long, F.lit(False))).select("*", *begin), inside]


_INFO = ["cells", "mcus", "restart_interval", "frame_type", "ss", "se", "ah", "al"]
_BEGIN = ["bit", "cell", "first", "sums", "bytes"]


def decoded_rows(batch: pa.RecordBatch, whole: bool = False):
    """(place, row, lookups, seq of the first unit, units) of each row of ``batch`` that has units; ``units`` is an iterator."""
    names = ["interval_no", "data", *_INFO[1:], *_BEGIN]
    last, cells = None, None  # neighbours mostly have equal tables
    for place, (tables, *row) in enumerate(zip(*(batch.column(n) for n in ("cells", *names)), strict=True)):
        if last is None or not tables.equals(last):
            last, cells = tables, tables.as_py()
        r = {"cells": cells} | {n: x.as_py() for n, x in zip(names, row, strict=True)}
        number, gap, size = r["interval_no"], r["restart_interval"], r["bytes"]
        begun = number * gap if gap else 0
        use = _lookups(cells)
        count = (min(gap, r["mcus"] - begun) if gap else r["mcus"]) * len(use) - r["first"]
        if count > 0 and not (number and not gap):
            units = decode_interval(r["data"] or b"", use, count, r["frame_type"] != 0, r["ss"], r["se"], r["ah"], r["al"], r["bit"], r["cell"], None if size is None else 8 * size, whole)
            yield place, r, use, begun * len(use) + r["first"], units


def decode_units(intervals: DataFrame, tables: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """``image_id, interval_no, seq, component, dc_diff, pos, vals, error`` of every data unit.

    ``tables`` has a row per image: ``cells`` (the components of an MCU with their
    Huffman tables), ``mcus``, ``restart_interval``, ``frame_type, ss, se, ah, al``.
    Intervals are dealt out by image and number, so one image with restart markers
    uses many tasks. A baseline interval of more than ``chunk_bytes`` is cut into
    chunks (``intervals`` are written down); a progressive one is one task.
    ``mcus.decode_mcus`` gives the same as blocks.
    """
    first, *more = [_units(df) for df in decodable(intervals, tables.select("image_id", *_INFO), chunk_bytes)]
    return first.unionByName(more[0]) if more else first


def _units(df: DataFrame) -> DataFrame:
    """Units of whole intervals, or of chunks: from ``bit`` on with ``cell``, after ``first`` units, none begun after ``bytes``."""
    kind = df.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for place, r, _, seq, units in decoded_rows(batch):
                for k, (component, diff, pos, vals, error) in enumerate(units):
                    at.append(place)
                    rows.append((r["interval_no"], seq + k, component, diff, pos, vals, error))
                    if len(rows) > 20_000:
                        yield pack(batch, at, rows)
                        rows, at = [], []
            if rows:
                yield pack(batch, at, rows)

    ints = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), ints, ints, pa.string()]
    fields = ["interval_no", "seq", "component", "dc_diff", "pos", "vals", "error"]

    def pack(batch, at, rows):
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["image_id", *fields])

    return df.select("image_id", "interval_no", "data", *_INFO, *_BEGIN).mapInArrow(run, f"image_id {kind}, interval_no int, seq bigint, component int, dc_diff int, pos array<int>, vals array<int>, error string")


def with_huffman(components: DataFrame, tables: DataFrame) -> DataFrame:
    """Scan components (``image_id, component, dc_id, ac_id``) with the counts and symbols of their tables."""
    out = components
    for k, n in (("dc", 0), ("ac", 1)):
        t = tables.filter(F.col("table_class") == n).select("image_id", F.col("table_id").alias(f"{k}_id"), F.col("counts").alias(f"{k}_counts"), F.col("symbols").alias(f"{k}_symbols"))
        out = out.join(t, ["image_id", f"{k}_id"], "left")
    return out


def decode_errors(units: DataFrame) -> DataFrame:
    """Rows of ``errors`` for images whose entropy data can't be decoded."""
    bad = units.filter("error is not null")
    return bad.select("image_id", F.col("error").alias("code"), F.concat_ws("/", "interval_no", "seq").alias("detail"), F.lit(1_500_000).alias("ord"), F.lit(105).alias("step"))
