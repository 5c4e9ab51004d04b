"""Column helpers shared by the operators; everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, the precision at which results are published."""
    return F.round(col(c).cast("double"), 6)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def share(num: Column | str, den: Column | str) -> Column:
    """num / max(den, 1) as a double."""
    return col(num).cast("double") / F.greatest(col(den).cast("double"), F.lit(1.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def sigmoid_of_logits(l0: Column | str, l1: Column | str) -> Column:
    """Foreground probability of a two-channel output."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(col(l0) - col(l1)))


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, as_col(lo)), as_col(hi))


def rows_of(items: Sequence[tuple], names: Sequence[str]) -> Column:
    """A small fixed parameter table as an array of structs, to ``inline`` next to each row."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in items])


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the keys only, so it is the same under any partitioning.

    The first 52 bits of the MD5 of ``seed:key:key...``, which any SQL engine can compute too.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    d = [F.col(p) - F.col(q) for p, q in zip(a, b)]
    return dot(d, d)


def symmetric_eigenvalues(m: dict[str, Column]) -> list[Column]:
    """Ascending eigenvalues of a symmetric 3x3 matrix (keys zz yy xx zy zx yx), in trigonometric form."""
    a, b, c, d, e, f = (m[k] for k in ("zz", "yy", "xx", "zy", "zx", "yx"))
    off = d * d + e * e + f * f
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * off) / 6)
    safe = F.when(p < 1e-15, F.lit(1.0)).otherwise(p)
    a1, b1, c1 = (a - q) / safe, (b - q) / safe, (c - q) / safe
    d1, e1, f1 = d / safe, e / safe, f / safe
    det = a1 * (b1 * c1 - f1 * f1) - d1 * (d1 * c1 - f1 * e1) + e1 * (d1 * f1 - b1 * e1)
    phi = F.acos(clip(det / 2, -1, 1)) / 3
    top = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2.0943951023931953)
    return [low, 3 * q - top - low, top]
