"""Scalar expressions: angles, booleans spelled as text, seeds, counter-based random numbers, losses, bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_diff(a: Column, b: Column) -> Column:
    """a - b wrapped to [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi


def text_bool(c: Column, words=("1", "true", "t", "yes")) -> Column:
    """Text in ``words`` (trimmed, any case) or a number equal to one."""
    t = F.lower(F.trim(c))
    return F.coalesce(t.isin(*words) | (t.try_cast("double") == 1), F.lit(False))


def strict_bool(c: Column) -> Column:
    """true, false, 1, 0; anything else is null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def yes_bool(c: Column) -> Column:
    """true, 1, yes; anything else is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def stable_seed(*parts: Column) -> Column:
    """First eight hex digits of the SHA-1 of the parts joined by bars, modulo 2^31."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") % (1 << 31)


def uniform(*parts: Column) -> Column:
    """Counter-based uniform in (0, 1) from an MD5 of the parts; the same in any engine and any order of rows."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(*parts: Column) -> Column:
    """Standard normal by Box-Muller from two counter uniforms."""
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("a")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def bins(c: Column, edges: list[tuple[float, str]], last: str, unknown: str = "unknown") -> Column:
    """Half-open bins by upper edge; the rest is ``last``; null and non-finite are ``unknown``."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), unknown)
    for edge, name in edges:
        out = out.when(c < edge, name)
    return out.otherwise(last)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def bce_with_logits(z: Column, y: Column, positive_weight: float = 1.0) -> Column:
    soft = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return (1 - y) * (z + soft) + positive_weight * y * soft


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def quantized_heading(yaw: Column) -> Column:
    """Nearest right angle of -yaw, half-even, in [0, 360)."""
    return F.pmod(F.rint(F.pmod(-yaw, F.lit(360.0)) / 90) * 90, F.lit(360.0))


def safe_ratio(a: Column, b: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(b == 0, 0.0).otherwise(a / b)
