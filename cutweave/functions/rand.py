"""Randomness as a pure function of a key: the same after a retry, on any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def u(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the parts, joined with a bar."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def order(*parts) -> Column:
    """The whole MD5, as text: an order without ties in practice."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


#: Rounds of a keyed permutation.
ROUNDS = 16


def turns(n, *parts) -> Column:
    """What ``permuted`` needs of its key alone: to be made once a key, before its places are listed."""
    size = n if isinstance(n, Column) else F.lit(int(n)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.named_struct(F.lit("r"), r, F.lit("k"), F.floor(u(*parts, r, "k") * size).cast("long")))


def permuted(i: Column, n, *parts, by: Column | None = None) -> Column:
    """Where a keyed permutation of 0..n-1 sends ``i``: the i-th of n things in random order, without a list of them.

    Swap-or-not (Hoang, Morris and Rogaway 2012): a round pairs x with k - x modulo n and swaps a pair or not by a hash of
    its greater member, so it is a permutation for every n. ``n``: a number or a column, over 0; ``i`` from 0 to n - 1.
    ``by``: a column of ``turns``, made before.
    """
    size = n if isinstance(n, Column) else F.lit(int(n)).cast("long")

    def turn(x: Column, t: Column) -> Column:
        y = F.pmod(t["k"] - x, size)
        return F.when(F.substring(order(*parts, t["r"], F.greatest(x, y)), 1, 1) < "8", y).otherwise(x)  # u < 0.5

    return F.aggregate(turns(n, *parts) if by is None else by, i.cast("long"), turn)
