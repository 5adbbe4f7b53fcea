"""Text helpers shared by verdict reasons, decisions and display columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*values: Column, default: str) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def is_filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def true_false(flag: Column) -> Column:
    return F.when(flag, "true").otherwise("false")


def to_fixed(x: Column, digits: int) -> Column:
    """Decimal text with `digits` places, exact ties rounded up.

    `format_number` works on the exact binary value but rounds ties to even. A value is a tie
    only if it is an odd multiple of 2^-(digits+1), so those are nudged up first.
    """
    steps = x * F.lit(float(2 ** (digits + 1)))
    is_tie = (steps == F.floor(steps)) & (F.pmod(steps, F.lit(2.0)) == 1.0)
    nudged = F.when(is_tie, x + F.lit(10.0 ** -(digits + 1))).otherwise(x)
    return F.replace(F.format_number(nudged, digits), F.lit(","), F.lit(""))
