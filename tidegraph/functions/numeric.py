"""Label arithmetic, in doubles or in fixed point.

Fixed point keeps weights x 1e6 and labels x 1e8 as longs, so results do not depend on the order of sums and agree
bit for bit between engines. Sums of products are decimals, so no hub overflows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

WEIGHT, LABEL = 1_000_000, 100_000_000


@dataclass(frozen=True)
class Numeric:
    fixed: bool = False

    @property
    def one(self):
        return LABEL if self.fixed else 1.0

    @property
    def half(self):
        return LABEL // 2 if self.fixed else 0.5

    def lit(self, x) -> Column:
        return F.lit(x).cast("long" if self.fixed else "double")

    def delta(self, delta: float):
        return round(delta * LABEL) if self.fixed else delta

    def class_label(self, gt: Column) -> Column:
        """0 or 1 of a known class, null of an unknown one."""
        return gt.cast("long") * LABEL if self.fixed else gt.cast("double")

    def products(self, w: Column, f: Column) -> Column:
        """Sum of w f over a group."""
        return F.sum((w.cast("decimal(19,0)") * f.cast("decimal(10,0)")).cast("decimal(38,0)")) if self.fixed else F.sum(w * f)

    def ratio(self, part: Column, whole: Column, otherwise: Column) -> Column:
        """part / whole held to [0, 1] (rounded half up in fixed point), or ``otherwise`` where whole is nothing."""
        # greatest() and least() pass over nulls, so a missing value is told apart first.
        if self.fixed:
            top, bottom = (2 * part + whole).cast("decimal(38,0)"), (2 * whole).cast("decimal(38,0)")
            value = F.when(whole > 0, ((top - top % bottom) / bottom).cast("decimal(38,0)").cast("long"))
        else:
            value = F.when(whole > 1e-10, part / whole)
        return F.when(value.isNull(), otherwise).otherwise(F.least(F.greatest(value, self.lit(0)), self.lit(self.one)))


DOUBLE, FIXED = Numeric(False), Numeric(True)


#: Hashes have 13 hexadecimal digits, 52 bits.
HASHES = 1 << 52


def hashed(*parts: Column | int | str) -> Column:
    """A long under ``HASHES`` from the parts, the same whatever the partitioning and in any engine that has md5."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    """A double in [0, 1) from a hash."""
    return hashed(*parts).cast("double") / float(HASHES)
