"""Integer hashes, label and set functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants and shifts of Robert Jenkins' public integer hash; for 16 bits, the low halves and other shifts.
CONSTANTS = (0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)
SHIFTS = {32: (12, 19, 5, 9, 3, 16), 16: (6, 9, 5, 7, 3, 8)}


def _hash(x, width: int, shl, shr, xor, low):
    """Six steps; shl, shr and xor are the operations of x's kind, low keeps its low bits."""
    a, b, c, d, e, f = (k & ((1 << width) - 1) for k in CONSTANTS)
    s = SHIFTS[width]
    x = low(x + a + shl(x, s[0]), width)
    x = low(xor(xor(x, b), shr(x, s[1])), width)
    x = low(x + c + shl(x, s[2]), width)
    x = low(xor(x + d, shl(x, s[3])), width)
    x = low(x + e + shl(x, s[4]), width)
    return low(xor(xor(x, f), shr(x, s[5])), width)


def _windows(n: int) -> tuple[int, list[int]]:
    """The width hashed at a time and the shifts at which, so that n bits are permuted."""
    if not 17 <= n <= 63:
        raise ValueError("n must be between 17 and 63")
    if n == 32:
        return 32, [0]
    width = 32 if n > 32 else 16
    up = list(range(n - width + 1))
    return width, [*up, *reversed(up)]


def hash_column(x: Column, width: int = 32) -> Column:
    """The hash of x's low bits (32 or 16), as a non-negative long."""
    mask = (1 << width) - 1
    low = lambda v, w: v.bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    xor = lambda a, b: a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b).cast("long"))
    return _hash(x.cast("long").bitwiseAND(F.lit(mask).cast("long")), width, F.shiftleft, F.shiftrightunsigned, xor, low)


def owner(a: Column, b: Column, parts: int) -> Column:
    """The part that an edge belongs to, the same for either direction."""
    return F.pmod(hash_column(a).bitwiseXOR(hash_column(b)), F.lit(parts)).cast("int")


def hash_array(x: np.ndarray, width: int = 32) -> np.ndarray:
    mask = np.uint64((1 << width) - 1)
    return _hash(
        x.astype(np.uint64) & mask, width, lambda v, b: v << np.uint64(b), lambda v, b: v >> np.uint64(b),
        lambda a, b: a ^ (b if isinstance(b, np.ndarray) else np.uint64(b)), lambda v, w: v & np.uint64((1 << w) - 1),
    )


def scramble_array(x: np.ndarray, n: int) -> np.ndarray:
    """A permutation of the n-bit numbers."""
    width, shifts = _windows(n)
    x = x.astype(np.uint64)
    for s in shifts:
        window = np.uint64(((1 << width) - 1) << s)
        x = (x & ~window) | (hash_array(x >> np.uint64(s), width) << np.uint64(s))
    return x


def scramble_column(x: Column, n: int) -> Column:
    """The same permutation in an expression; every window hashes what the last one left."""
    width, shifts = _windows(n)

    def at(s: int):
        rest = F.lit(~(((1 << width) - 1) << s))
        return lambda v: v.bitwiseAND(rest).bitwiseOR(F.shiftleft(hash_column(F.shiftrightunsigned(v, s), width), s))

    for s in shifts:
        x = F.transform(F.array(x.cast("long")), at(s))[0]  # a variable, so that x is not spelled out again and again
    return x


def degree_label(degree: Column) -> Column:
    """ceil(log2(degree + 1))"""
    return F.ceil(F.log2(degree + F.lit(1))).cast("long")


def bit_set(members: Column) -> Column:
    """The set of small numbers in a group, as the bits of a long."""
    return F.bit_or(F.element_at(F.array(*(F.lit(1 << u).cast("long") for u in range(63))), members.cast("int") + 1))


def has_bit(bits: Column, u: Column | int) -> Column:
    return F.getbit(bits, u if isinstance(u, Column) else F.lit(u)) == 1


def edge_mask(a: int, b: int) -> int:
    """A query edge as a set of two bits, the same for either direction."""
    return 1 << a | 1 << b


def out_of_range(*ids: Column) -> Column:
    """Whether any id is negative; ids above 2^63-1 can't be stored and fail when they are read."""
    out = F.lit(False)
    for i in ids:
        out = out | (i < 0)
    return out


def one_hot(labels: Sequence[int], width: int) -> np.ndarray:
    out = np.zeros((len(labels), width), dtype=np.float32)
    out[np.arange(len(labels)), np.asarray(labels, dtype=np.int64)] = 1.0
    return out
