from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lumenar.operators.timestamps import month_table, normalise_timestamps, zone_lookup

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "zone", "locale")])


def us(year, month, day, hour=0, minute=0, second=0, micro=0):
    return int((datetime(year, month, day, hour, minute, second, micro, timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def run(spark, rows):
    df = normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "raw", "zone", "locale")
    return {(r.raw, r.zone): r.ts_utc_us for r in df.collect()}


CASES = [
    ("2024-03-05T10:20:30Z", None, None, us(2024, 3, 5, 10, 20, 30)),
    ("2024-03-05T10:20:30.1234567+05:45", None, None, us(2024, 3, 5, 4, 35, 30, 123456)),
    ("2024-03-05 10:20:30,5-03", None, None, us(2024, 3, 5, 13, 20, 30, 500000)),
    ("2024-03-05T10:20+0100", None, None, us(2024, 3, 5, 9, 20)),
    ("20240305T102030-0300", None, None, us(2024, 3, 5, 13, 20, 30)),
    ("2024-03-05", "Asia/Kolkata", "en-IN", us(2024, 3, 4, 18, 30)),
    ("20240305", "Europe/Madrid", "es-ES", us(2024, 3, 4, 23)),
    ("2024/03/05", "America/Bogota", None, us(2024, 3, 5, 5)),
    ("05/03/2024 01:02", "Europe/London", "en-GB", us(2024, 3, 5, 1, 2)),
    ("05/03/2024 1:02 PM", "America/New_York", "en-US", us(2024, 5, 3, 17, 2)),
    ("12/31/2024 12:00 AM", "America/New_York", "en-US", us(2024, 12, 31, 5)),
    ("03.12.2023", "Africa/Luanda", "pt-AO", us(2023, 12, 2, 23)),
    ("Thu, 01 Feb 2024 13:14:32 +0100", None, None, us(2024, 2, 1, 12, 14, 32)),
    ("Sat, 25 Mar 2023 03:51:34 GMT", "Asia/Kolkata", None, us(2023, 3, 25, 3, 51, 34)),
    ("Mar 28, 2026 22:19:17 EDT", None, None, us(2026, 3, 29, 2, 19, 17)),
    ("March 31, 2026, 6:16 PM", "America/Sao_Paulo", "pt-BR", us(2026, 3, 31, 21, 16)),
    ("8:55 AM · Nov 25, 2022", "Europe/Lisbon", "pt-PT", us(2022, 11, 25, 8, 55)),
    ("24 de out. de 2023 05:18", "America/Sao_Paulo", "pt-BR", us(2023, 10, 24, 8, 18)),
    ("6 de julho de 2025 às 21h22", "America/Sao_Paulo", "pt-BR", us(2025, 7, 7, 0, 22)),
    ("2 de noviembre de 2022", "America/Santiago", "es-CL", us(2022, 11, 2, 3)),
    ("1673770638", None, None, 1673770638 * 10**6),
    ("1782564413.440", None, None, 1782564413440000),
    ("1689454107602", None, None, 1689454107602000),
    ("1667260800458315", None, None, 1667260800458315),
    ("1667260800458315999", None, None, 1667260800458315),
    ("2026-02-20T10:07:49[America/Los_Angeles]", None, None, us(2026, 2, 20, 18, 7, 49)),
    ("2024-03-28 00:49:17 America/New_York", "Asia/Kolkata", None, us(2024, 3, 28, 4, 49, 17)),
    ("  2024-03-05 10:20:30  ", "Europe/London", None, us(2024, 3, 5, 10, 20, 30)),
    # the first of two equal wall-clock times; a skipped one moves on by the gap
    ("2025-10-26T02:30:00", "Europe/Madrid", None, us(2025, 10, 26, 0, 30)),
    ("2025-03-30T02:30:00", "Europe/Madrid", None, us(2025, 3, 30, 1, 30)),
    ("2025-03-09 02:30:00", "America/New_York", None, us(2025, 3, 9, 7, 30)),
    *[(t, "Europe/Madrid", "es-ES", None) for t in (None, "", "  ", "ontem", "3 hours ago", "n/a", "2025-02-30", "31/11/2024", "20251340", "2024-13-05T10:00:00", "0000-00-00", "2024-01-01T25:00:00", "13:05 PM · Nov 5, 2024", "123456789", "9" * 30, "x" * 10000)],
    ("2024-03-05T10:20:30", None, None, None),
    ("2024-03-05T10:20:30 XYZ", "Europe/Madrid", None, None),
    ("2024-03-05T10:20:30", "Nowhere/City", None, None),
]


def test_cases(spark):
    found = run(spark, [c[:3] for c in CASES])
    wrong = [(c, found[(c[0], c[1])]) for c in CASES if found[(c[0], c[1])] != c[3]]
    assert not wrong


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1999, 1, 1), datetime(2030, 1, 1)), st.sampled_from(["Europe/Madrid", "America/Santiago", "Asia/Kathmandu", "America/New_York"])), min_size=1, max_size=60))
def test_local_times_like_zoneinfo(spark, times):
    """Ambiguous times take the first offset, skipped ones move on: as fold=0 and the offset before the gap do."""
    rows = [(t.isoformat(" ", "microseconds"), z, None) for t, z in times]
    found = run(spark, rows)
    for t, z in times:
        local = t.replace(tzinfo=ZoneInfo(z))
        want = (local.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        assert found[(t.isoformat(" ", "microseconds"), z)] == want


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, [("2025-03-30T02:30:00", "Europe/Madrid", None)]) == {("2025-03-30T02:30:00", "Europe/Madrid"): us(2025, 3, 30, 1, 30)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shape(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert normalise_timestamps(empty, "raw").columns == ["raw", "zone", "locale", "ts_format", "ts_utc_us"]
    assert normalise_timestamps(empty, "raw").count() == 0
    with pytest.raises(ValueError):
        normalise_timestamps(normalise_timestamps(empty, "raw"), "raw")


def test_zone_lookup_is_one_row_a_handle(spark):
    authors = spark.createDataFrame([("a", "Europe/Madrid", "es-ES"), ("a", "Europe/Madrid", "es-ES"), (None, "x", "y"), ("b", None, None)], "handle string, home_zone string, locale string")
    assert sorted((r.handle, r.home_zone) for r in zone_lookup(authors).collect()) == [("a", "Europe/Madrid"), ("b", None)]


def test_months():
    table = month_table()
    assert {table[m] for m in ("jan", "ene", "enero", "janeiro", "january")} == {1}
    assert table["sept"] == table["set"] == table["sep"] == 9
