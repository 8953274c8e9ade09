"""Text columns: stripping, sentences, previews, ordered joins. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without blanks of any script at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def sentences(text: Column) -> Column:
    """Non-empty stripped pieces of the stripped text, cut at blanks after ``.``, ``!`` or ``?``; null stays null."""
    pieces = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def preview(text: Column, size: int = 1500) -> Column:
    """The first ``size`` characters, with ``...`` only where something is left out."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def joined_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts of a group joined in order; nulls are left out, equal places in order of text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x.t), separator)


def clock(seconds: Column, mark: str) -> Column:
    """``HH:MM:SS`` + ``mark`` + milliseconds, cut off and not rounded."""
    whole = seconds.cast("bigint")
    part = ((seconds - whole) * 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, part)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Rounding of the exact binary value, ties to even, as languages with correctly rounded printing do.

    ``round`` and ``bround`` round the shortest decimal form, which differs for e.g. 2.675.
    """
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def exact(values):  # noqa: ANN001, ANN202
        return values.map(lambda v: v if v != v else round(v, digits))

    return exact(value)
