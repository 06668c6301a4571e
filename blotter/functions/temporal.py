"""Column expressions for time and lookups (all JVM-side, codegen'd)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.functions import fixed


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_map(mapping: dict) -> Column:
    """A literal MAP column built from a small fixed dict."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def parse_timestamp(col, fmt: str = fixed.RAW_TIMESTAMP_FORMAT) -> Column:
    """Text -> wall-clock timestamp (no zone); malformed text gives NULL
    instead of an error (C1)."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("timestamp_ntz")


def hour_of(col) -> Column:
    return F.hour(_c(col))


def month_of(col) -> Column:
    return F.month(_c(col))


def year_of(col) -> Column:
    return F.year(_c(col))


def day_name(col) -> Column:
    """English day name, Monday ... Sunday."""
    return F.date_format(_c(col), "EEEE")


def day_number(col) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(col))


def is_weekend(col) -> Column:
    """Saturday or Sunday; a missing timestamp counts as not weekend (C4)."""
    return F.coalesce(F.weekday(_c(col)) >= 5, F.lit(False))


def season_of_month(month_col) -> Column:
    """Month number -> season name, unmatched / NULL -> NULL."""
    return F.try_element_at(literal_map(fixed.SEASON_OF_MONTH), _c(month_col))


def lookup_or_default(col, mapping: dict, default) -> Column:
    """Exact, case-sensitive dictionary lookup with a default."""
    return F.coalesce(F.try_element_at(literal_map(mapping), _c(col)), F.lit(default))


def severity_of_type(type_col) -> Column:
    mapping = {k: float(v) for k, v in fixed.SEVERITY_OF_TYPE.items()}
    return lookup_or_default(type_col, mapping, fixed.DEFAULT_SEVERITY)


def ordinal_of(col, order: list[str], default: int = 0) -> Column:
    """Position of a name in a fixed order, default when absent."""
    return lookup_or_default(col, {name: i for i, name in enumerate(order)}, default).cast("int")


def period_label(mean_hour_col, decimals: int = 2) -> Column:
    """Day-part of a mean hour, judged on the value rounded first."""
    h = F.bround(_c(mean_hour_col), decimals)
    expr = None
    for bound, label in fixed.PERIOD_BOUNDS:
        expr = F.when(h < bound, label) if expr is None else expr.when(h < bound, label)
    return expr.otherwise(fixed.PERIOD_ELSE)


def round_half_even(col, decimals: int) -> Column:
    """Half-to-even rounding as NumPy / pandas do."""
    return F.bround(_c(col), decimals)


def percent(numerator, denominator, decimals: int | None = None) -> Column:
    out = F.try_divide(_c(numerator).cast("double") * 100.0, _c(denominator).cast("double"))
    return out if decimals is None else F.bround(out, decimals)
