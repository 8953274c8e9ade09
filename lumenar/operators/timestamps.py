"""Mixed timestamp formats and zones, normalised to one UTC instant.

An ordered cascade of anchored patterns rewrites each text into one fixed layout
(``format|year|month|day|hour|minute|second|fraction|half|zone``). Everything after that is
built-in expressions, so the whole operator stays in JVM code generation.

Policy (all cases have a defined result):

* null, blank, relative ("3 hours ago"), impossible (30 February, month 13, hour 25) or
  unrecognised text gives null;
* an offset in the text wins over a bracketed region, a region or zone letters in the text win
  over the source's default zone; no zone anywhere gives null;
* zone letters are fixed offsets all year (``ZONE_LETTERS``), unknown letters give null;
* of two equal wall-clock times (clocks set back) the first holds, a skipped wall-clock time
  (clocks set forward) moves on by the gap;
* all-digit dates led by day or month follow the source's locale: ``en-US`` puts the month
  first, every other the day; without a locale the day leads;
* bare counts of ten digits or more count from 1970: up to 11 digits seconds, up to 14
  milliseconds, up to 17 microseconds, up to 19 nanoseconds; longer gives null;
* a date alone is the start of that day in its zone; fractions beyond microseconds are cut off.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone letters and their offset in minutes.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "BRT": -180, "ART": -180,
    "EDT": -240, "EST": -300, "PDT": -420, "PST": -480,
}

# Month names, full, in order, by language; abbreviations are their first letters.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
}

MONTH_FIRST_LOCALES = ("en-US",)

_ZONE = r"(Z|[+-]\d\d(?::?\d\d)?|[A-Z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?(?:\[([A-Za-z]+(?:/[A-Za-z_+-]+)*)\])?"
_HMS = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_WORD = r"([^\W\d_]{3,12})\.?"

#: (name, anchored pattern, layout): the cascade, first match wins.
CASCADE: tuple[tuple[str, str, str], ...] = (
    ("iso", rf"^(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{_HMS} ?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", rf"^(\d{{4}})(\d\d)(\d\d)(?:T(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d{{1,9}}))?)? ?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("epoch", r"^(\d{10,19})(?:\.(\d{1,9}))?$", "$1||||||$2|||"),
    ("slash_ymd", rf"^(\d{{4}})/(\d\d?)/(\d\d?)(?:[T ]{_HMS} ?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("digits", rf"^(\d\d?)([/.-])(\d\d?)\2(\d{{4}})(?:,? {_HMS}{_HALF} ?{_ZONE})?$", "$4|$1|$3|$5|$6|$7|$8|$9|$10|$11"),
    ("mail", rf"^(?:{_WORD},? )?(\d\d?) {_WORD} (\d{{4}}) {_HMS} ?{_ZONE}$", "$4|$3|$2|$5|$6|$7|$8||$9|$10"),
    ("month_first", rf"^{_WORD} (\d\d?),? (\d{{4}})(?:,? {_HMS}{_HALF} ?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("clock_first", rf"^{_HMS}{_HALF} [·-] {_WORD} (\d\d?), (\d{{4}})$", "$8|$6|$7|$1|$2|$3|$4|$5||"),
    ("de", rf"^(\d\d?) de {_WORD} de (\d{{4}})(?:,?(?: às| a las)? (\d\d?)[:h](\d\d)(?::(\d\d))? ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|||$7|$8"),
)


def month_table() -> dict[str, int]:
    """Month names and abbreviations (three letters; four for Spanish "sept") to 1..12."""
    table: dict[str, int] = {}
    for names in MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            for key in {name, name[:3], name[:4]}:
                assert table.setdefault(key, number) == number, key
    return table


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def epoch_micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC, whatever the session zone."""
    day = F.unix_date(ntz.cast("date")).cast("bigint")
    second = (F.hour(ntz) * 3600 + F.minute(ntz) * 60).cast("bigint")
    micros = (F.expr("1000000") * F.date_part(F.lit("second"), ntz)).cast("bigint")
    return (day * 86400 + second) * 1000000 + micros


def parse_layout(text: Column) -> Column:
    """The first cascade pattern that fits, as the fixed layout; null if none does."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    out = F.lit(None).cast("string")
    for name, pattern, layout in reversed(CASCADE):
        pattern = "(?U)" + pattern
        out = F.when(clean.rlike(pattern), F.regexp_replace(clean, pattern, f"{name}|{layout}")).otherwise(out)
    return out


def normalise_timestamps(df: DataFrame, text: str, zone: str | None = None, locale: str | None = None, prefix: str = "ts_") -> DataFrame:
    """Add ``{prefix}format`` and ``{prefix}utc_us`` for the text column ``text``.

    ``zone`` and ``locale`` name columns with the source's default zone and locale. Existing
    columns are kept as they are; the two added names must not exist (ValueError). Rows are
    neither dropped nor merged; an empty table stays empty.
    """
    clash = {f"{prefix}format", f"{prefix}utc_us"} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    col = lambda name: df[name] if name else F.lit(None).cast("string")
    tmp = "__lumenar_"
    work = df.withColumn(f"{tmp}p", F.split(parse_layout(df[text]), r"\|"))
    part = lambda i: F.get(F.col(f"{tmp}p"), F.lit(i))
    number = lambda i: F.expr(f"try_cast(get({tmp}p, {i}) as int)")

    fmt = part(0)
    months = _lookup(month_table())
    month_first = F.coalesce(col(locale).isin(*MONTH_FIRST_LOCALES), F.lit(False))
    swap = (fmt == "digits") & ~month_first
    month = F.when(swap, number(3)).otherwise(F.coalesce(number(2), F.try_element_at(months, F.lower(part(2)))))
    day = F.when(swap, number(2)).otherwise(number(3))
    hour, half = number(4), F.lower(part(8))
    hour24 = (
        F.when(half == "", F.coalesce(hour, F.lit(0)))
        .when(~hour.between(1, 12), F.lit(None))
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    second = F.coalesce(number(6), F.lit(0))
    fraction = F.rpad(F.substring(part(7), 1, 6), 6, "0")
    work = work.withColumns({
        f"{tmp}y": number(1), f"{tmp}mo": month, f"{tmp}d": day, f"{tmp}h": hour24,
        f"{tmp}mi": F.coalesce(number(5), F.lit(0)), f"{tmp}s": second, f"{tmp}f": fraction,
    })
    work = work.withColumn(
        f"{tmp}wall",
        F.expr(
            f"case when {tmp}p is not null and get({tmp}p,0) <> 'epoch' and {tmp}s < 60 and {tmp}h < 24 and {tmp}mi < 60 and {tmp}y > 0 then "
            f"try_make_timestamp_ntz({tmp}y, {tmp}mo, {tmp}d, {tmp}h, {tmp}mi, cast(concat({tmp}s, '.', {tmp}f) as decimal(8,6))) end"
        ),
    )

    inline, bracket = part(9), part(10)
    signed = inline.rlike(r"^[+-]")
    sign = F.when(F.substring(inline, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(inline, r"[^0-9]", "")
    off_h = F.expr("try_cast(substring(regexp_replace(get(%sp, 9), '[^0-9]', ''), 1, 2) as int)" % tmp)
    off_m = F.when(F.length(digits) > 2, F.expr("try_cast(substring(regexp_replace(get(%sp, 9), '[^0-9]', ''), 3, 2) as int)" % tmp)).otherwise(0)
    offset = F.when(signed & (off_h <= 18) & (off_m < 60), sign * (off_h * 60 + off_m)).when(~signed, F.try_element_at(_lookup(ZONE_LETTERS), inline))
    in_text = F.when(inline.contains("/"), inline).when((inline == "") & (bracket != ""), bracket)
    region = F.when((inline == "") & (bracket == ""), col(zone)).otherwise(in_text)
    known = region.isin(*sorted(z for z in available_timezones() if "/" in z and z[0].isupper()), "UTC")
    wall = F.col(f"{tmp}wall")
    by_offset = epoch_micros(wall) - offset.cast("bigint") * 60000000
    by_region = epoch_micros(F.convert_timezone(F.when(known, region), F.lit("UTC"), wall))

    count = F.expr(f"try_cast(get({tmp}p,1) as bigint)")
    width = F.length(part(1))
    after = F.expr(f"try_cast({tmp}f as bigint)")
    epoch = (
        F.when(width <= 11, count * 1000000 + after)
        .when(width <= 14, count * 1000 + F.expr(f"try_cast({tmp}f as bigint) div 1000"))
        .when(width <= 17, count)
        .otherwise(F.expr(f"try_cast(get({tmp}p,1) as bigint) div 1000"))
    )
    utc = F.when(fmt == "epoch", epoch).otherwise(F.coalesce(by_offset, by_region)).cast("bigint")
    return work.select(*[F.col(f"`{c}`") for c in df.columns], fmt.alias(f"{prefix}format"), utc.alias(f"{prefix}utc_us"))


def zone_lookup(authors: DataFrame) -> DataFrame:
    """One row per handle with its zone and locale; a repeated handle keeps its smallest values."""
    return authors.filter("handle is not null").groupBy("handle").agg(F.min("home_zone").alias("home_zone"), F.min("locale").alias("locale"))
