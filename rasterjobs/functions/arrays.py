"""Column functions for coefficients, colours and bytes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Row-major index of each scan position (ITU-T T.81, figure 5), from its rule: diagonals in turn.
ZIGZAG = [8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]
#: Scan position of each row-major index.
UNZIGZAG = [ZIGZAG.index(i) for i in range(64)]

#: Colour factors over 2**22.
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 5880414, 1442840, 2994733, 7432306
SHIFT = 22


def _ints(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where lambdas inside ``body`` use it."""
    return F.get(F.transform(F.array(value), body), 0)


def dezigzag(arr: Column) -> Column:
    """64 values in scan order as 64 values in row order."""
    return let(arr, lambda a: F.transform(_ints(UNZIGZAG), lambda p: F.get(a, p)))


def extend_sign(v: Column, n: Column) -> Column:
    """The value of an ``n``-bit magnitude; 0 bits: 0."""
    one = F.lit(1)
    return F.when(n == 0, 0).when(v < F.call_function("shiftleft", one, n - 1), v - F.call_function("shiftleft", one, n) + 1).otherwise(v)


def wrap16(x: Column) -> Column:
    """A whole number as a 16-bit short that wraps around."""
    return (((x + 32768).bitwiseAND(65535)) - 32768).cast("smallint")


def densify(pos: Column, val: Column) -> Column:
    """64 values with ``val`` at ``pos`` (distinct, scan order) and 0 elsewhere."""
    return let(F.map_from_arrays(pos, val), lambda m: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.coalesce(F.try_element_at(m, p), F.lit(0))))


def dequantize(coef: Column, q: Column) -> Column:
    """Products of coefficients and quantization steps, as wrapping shorts."""
    return F.zip_with(coef, q, lambda a, b: wrap16(a.cast("int") * b))


def upsample(chroma: Column, row: Column, col: Column, h: Column, v: Column) -> Column:
    """The chroma of a luma unit at (row, col), nearest neighbour."""
    y0, x0 = 4 * (row % v), 4 * (col % h)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.get(chroma, (8 * (F.floor(F.floor(p / 8) / v) + y0) + F.floor((p % 8) / h) + x0).cast("int")))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("smallint")


def _scaled(factor: int, x: Column) -> Column:
    return F.shiftright(x.cast("bigint") * factor, SHIFT)


def red(y: Column, cb: Column, cr: Column) -> Column:
    return _clamp(y + _scaled(RED_CR, cr) + 128)


def green(y: Column, cb: Column, cr: Column) -> Column:
    return _clamp(y - _scaled(GREEN_CB, cb) - _scaled(GREEN_CR, cr) + 128)


def blue(y: Column, cb: Column, cr: Column) -> Column:
    return _clamp(y + _scaled(BLUE_CB, cb) + 128)


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Arrays of 64 samples to a struct of arrays r, g, b."""
    triples = F.arrays_zip(y.alias("y"), cb.alias("cb"), cr.alias("cr"))

    def plane(f) -> Column:
        return F.transform(triples, lambda t: f(t.getField("y"), t.getField("cb"), t.getField("cr")))

    return F.struct(plane(red).alias("r"), plane(green).alias("g"), plane(blue).alias("b"))


def byte_at(data: Column, at: Column | int) -> Column:
    """The byte at a position from 0; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.nullif(F.hex(F.substring(data, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


def be16(data: Column, at: Column | int) -> Column:
    return byte_at(data, at) * 256 + byte_at(data, at + 1)


def le_hex(x: Column, size: int) -> Column:
    """``size`` low bytes of a whole number as little-endian hex text."""
    text = F.lpad(F.hex(x.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))))
