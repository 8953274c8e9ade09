"""Rows of a registered query beside those of its SQL twin, on a folder of tables."""

import datetime
import decimal
import os

import duckdb

DATA = os.environ.get("LUMENAR_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "events", "documents", "posts", "video_inputs", "video_info", "transcribe_runs", "asr_segments", "page_captures", "raw_records", "authors", "glossary", "mix_targets",
)


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return str(value) if isinstance(value, datetime.datetime) else value


def rows(found, columns):
    return sorted((tuple(plain(v) for v in r) for r in found), key=repr), columns


def both(spark, make, sql):
    df = make(spark, DATA)
    names = sorted(df.columns)
    ours = rows(df.select(*names).collect(), names)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        theirs = con.sql(f"SELECT {', '.join(names)} FROM ({sql})")
        return ours, rows(theirs.fetchall(), sorted(theirs.columns))
