"""Scalar rules of the grid and the tree sizes, and tolerant comparison."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading digits of the alpha grid (0.5, 0.2, 0.1, 0.05, …) and of allowed alphas.
ALPHA_DIGITS = (5, 2, 1)


def alpha_value(k: int) -> float:
    """The k-th alpha of the grid, from 0.5 down."""
    return ALPHA_DIGITS[k % 3] / 10 ** (k // 3 + 1)


def alpha_column(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in ALPHA_DIGITS]), (k % 3 + 1).cast("int")) / F.pow(F.lit(10.0), F.floor(k / 3) + 1)


def tree_count(k: int) -> int:
    """The k-th number of trees in a grove: 1, 2, 3, 4, 6, 8, 11, 16, …"""
    return int(math.sqrt(2.0 ** (k + 1)) + 0.5)


def tree_count_column(k: Column) -> Column:
    return F.floor(F.sqrt(F.pow(F.lit(2.0), k + 1)) + 0.5).cast("int")


def tree_count_steps(n: int) -> int:
    """How many grid values do not exceed n."""
    k = 0
    while tree_count(k) <= n:
        k += 1
    return k


def snap_tree_count(n: int) -> int:
    """The largest grid value that n reaches."""
    return tree_count(max(0, tree_count_steps(n) - 1))


def alpha_steps(least: float, rows: int) -> int:
    """How many alphas a grid down to ``least`` has; 0 stands for one row."""
    low, k = (least or 1.0 / rows), 0
    while alpha_value(k) > low * (1 + 1e-9):
        k += 1
    return k + 1


def snap_alpha(alpha: float, rows: float) -> float:
    """0 where a leaf of that share has at most one row, else the nearest 1, 2 or 5 times a power of ten."""
    if alpha <= 1.0 / rows or same(alpha, 1.0 / rows):
        return 0.0
    shift = max(0, math.ceil(-math.log10(alpha) - 1e-12))
    for s in (shift, shift - 1, shift + 1):
        if any(same(alpha * 10.0**s, d) for d in (1.0, 2.0, 5.0)):
            return alpha
    scaled, power = alpha, 0
    while scaled <= 0.7:
        scaled, power = scaled * 10, power + 1
    return (5 if scaled > 3 else 2 if scaled > 1.5 else 1) / 10**power


def alpha_text(alpha: float) -> str:
    if alpha == 0:
        return "0.0"
    if alpha > 0.8:
        return "1.0"
    zeros = 0
    while (scaled := alpha * 10 ** (zeros + 1)) <= 0.8:
        zeros += 1
    return "0." + "0" * zeros + ("5" if scaled > 4.5 else "2" if scaled > 1.5 else "1")


def leaf_share(alpha: float, rows: float, depth: int) -> float | None:
    """Share of a bag's rows below which a node at that depth is a leaf; None: no limit.  It rises geometrically from
    1 / rows at the root, through alpha at depth -log2(alpha)."""
    if alpha <= 0:
        return None
    if alpha >= 1:
        return 1.0
    height = -math.log2(alpha)
    base = min(-math.log2(rows), -height)
    return 2.0 ** (base - (base + height) * depth / height)


def leaf_share_column(alpha: Column, rows: Column, depth: Column) -> Column:
    """leaf_share of columns; null for no limit."""
    height = -F.log2(alpha)
    base = F.least(-F.log2(rows), -height)
    share = F.pow(F.lit(2.0), base - (base + height) * depth / height)
    return F.when(alpha >= 1, F.lit(1.0)).when(alpha > 0, share)


def round_two_digits(n: int) -> int:
    """Numbers over 100 rounded to two leading digits, halves up."""
    if n <= 100:
        return n
    unit = 10 ** (len(str(n - 1)) - 2)
    return int(math.floor(n / unit + 0.5)) * unit


def _ordered(x: float) -> int:
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def same(a: float, b: float, steps: int = 4) -> bool:
    """Equal but for at most ``steps`` representable numbers."""
    return not (math.isnan(a) or math.isnan(b)) and abs(_ordered(a) - _ordered(b)) <= steps


def below(a: float, b: float) -> bool:
    return a < b and not same(a, b)


def at_most(a: float, b: float) -> bool:
    return a < b or same(a, b)


def missing_text(c: Column) -> Column:
    """A number as text, a missing one as ``?``."""
    return F.coalesce(c.cast("string"), F.lit("?"))


def in_base(n: int, base: int = 10) -> str:
    """A whole number in base 2 to 36, with a minus sign below 0."""
    if not 2 <= base <= 36:
        raise ValueError(f"base {base}")
    digits, rest = "", abs(n)
    while rest or not digits:
        rest, d = divmod(rest, base)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "-" + digits if n < 0 else digits


def first_digit_place(x: float) -> int:
    """Place after the point of the first significant digit of 0 < x < 1."""
    return math.ceil(-math.log10(x) - 1e-12)


def with_suffix(name: str, suffix: str) -> str:
    """``a.b.txt`` and ``fs`` give ``a.b.fs.txt``."""
    stem, dot, end = name.rpartition(".")
    return f"{stem}.{suffix}.{end}" if dot else f"{name}.{suffix}"
