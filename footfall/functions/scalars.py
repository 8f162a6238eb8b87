"""Scalar helpers: clipping, hashing, text and array shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 1 << 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Limit a value to ``[lo, hi]``; nulls stay null."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def to_class(c, threshold: float = 0.5) -> Column:
    """1 where the probability reaches the threshold, else 0."""
    return (_col(c) >= F.lit(threshold)).cast("int")


def hash_number(*parts) -> Column:
    """A 32-bit number drawn from the md5 of the parts joined by ``_``.

    It depends on the values alone, so retried tasks, other partitionings and
    other engines all see the same draw.
    """
    text = F.concat_ws("_", *[_col(p).cast("string") if not isinstance(p, int) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Uniform draw in [0, 1) from :func:`hash_number`."""
    return hash_number(*parts) / F.lit(float(HASH_SPAN))


def hash_normal(*parts) -> Column:
    """Standard normal draw from two hash draws (Box-Muller)."""
    u = (hash_number(*parts, 1) + 1) / F.lit(float(HASH_SPAN))
    v = hash_uniform(*parts, 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def strip_suffix(c) -> Column:
    """Remove a trailing ``_<digits>``."""
    return F.regexp_replace(_col(c), "_[0-9]+$", "")


def plain_name(c) -> Column:
    """Event name without parentheses, so log and dimension spellings agree."""
    return F.regexp_replace(_col(c), "[()]", "")


def pad_left(c, size: int, zero) -> Column:
    """Array filled with ``zero`` at the front up to ``size`` entries."""
    c = _col(c)
    return F.concat(F.array_repeat(zero, F.lit(size) - F.size(c)), c)


def pad_right(c, size: int, zero) -> Column:
    """Array filled with ``zero`` at the end up to ``size`` entries."""
    c = _col(c)
    return F.concat(c, F.array_repeat(zero, F.lit(size) - F.size(c)))
