"""Column expressions used by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column | str) -> Column:
    """Sum of money to the cent, independent of the order of rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b where b is over 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(otherwise))


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small mapping given by the caller, as an expression: no join."""
    if not values:
        return F.lit(default)
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def holds_any(text: Column, tokens: list[str]) -> Column:
    """Whether the upper-cased text contains one of the tokens; null counts as NAN."""
    out = F.lit(False)
    up = F.upper(F.coalesce(text, F.lit("NAN")))
    for t in tokens:
        out = out | up.contains(t.upper())
    return out
