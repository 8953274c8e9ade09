"""Queries of the general training-data operators (problems 3, 5 and 7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.operators.drift import schema_changes, steady_table
from lumenar.operators.nested import explode_nodes, index_nested
from lumenar.operators.timestamps import normalise_timestamps, zone_lookup
from lumenar.session import cut_lineage, read_table


def _timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (("posts", "post_id", "author.handle", "timestamp_raw"), ("video_inputs", "input_id", "handle", "date_raw"), ("video_info", "info_id", "uploader_id", "video_date"))
    parts = [
        read_table(spark, sf_dir, table).select(F.lit(table).alias("src"), F.col(key).alias("rec_id"), F.col(handle).alias("handle"), F.col(text).alias("raw"), "ingested_at")
        for table, key, handle, text in sources
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = zone_lookup(read_table(spark, sf_dir, "authors"))
    found = normalise_timestamps(_timestamp_texts(spark, sf_dir).join(zones, "handle", "left"), "raw", "home_zone", "locale")
    latest = F.struct("ingested_at", "ts_utc_us", "ts_format", "raw")
    return found.groupBy("src", "rec_id").agg(F.max(latest).alias("last")).select("src", "rec_id", "last.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).filter("rec_id is not null and ts_utc_us is not null").select("src", "rec_id", F.col("ts_utc_us").alias("utc_us"))


def p3_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each source each pattern of the cascade resolved or left open."""
    return _instants(spark, sf_dir).groupBy("src", "ts_format").agg(F.count("*").alias("n_records"), F.count("ts_utc_us").alias("n_resolved"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(read_table(spark, sf_dir, "raw_records"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "raw_records")
    steady = steady_table(records, cut_lineage(schema_changes(records)))
    names = ["id", "author.name", "author.handle", "platform", "post_url", "timestamp", "views", "content.spanish", "content.english", "content.portuguese"]
    columns = [F.col("values")[n].alias(n.replace(".", "_")) for n in names]
    return steady.select("feed", "file_no", "rec_no", *columns, F.map_filter("values", lambda k, _: ~k.isin(*names)).alias("other_fields"))


def _nested(spark: SparkSession, sf_dir: str, with_fields: bool) -> DataFrame:
    info = read_table(spark, sf_dir, "video_info").select(F.lit("video_info").alias("src"), F.col("info_id").alias("rec_id"), "ingested_at", F.col("info_dict").alias("json"))
    author = F.when(F.col("author").isNotNull(), F.to_json(F.struct("author"), {"ignoreNullFields": "false"}))
    posts = read_table(spark, sf_dir, "posts").select(F.lit("posts").alias("src"), F.col("post_id").alias("rec_id"), "ingested_at", author.alias("json"))
    nodes = index_nested(info.unionByName(posts), "json", with_fields=with_fields)
    if with_fields:  # maps can't be compared, entries can
        entries = lambda n: F.struct(n.node_path, n.parent_path, n.n_fields, F.map_entries(n.fields).alias("fields"))
        nodes = nodes.withColumn("nodes", F.transform("nodes", entries))
    else:
        nodes = nodes.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n.node_path, n.n_fields)))
    return nodes.groupBy("src", "rec_id").agg(F.max(F.struct("ingested_at", "nodes")).alias("last")).select("src", "rec_id", F.col("last.nodes").alias("nodes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nested(spark, sf_dir, False).filter("rec_id is not null").select("src", "rec_id", F.explode("nodes").alias("n"))
    return nodes.filter("n.node_path <> '' and n.n_fields > 0").select("src", "rec_id", "n.node_path").distinct()


def p7_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object as a row of its flat table (``collection``), linked to its parent by (src, rec_id, parent_path)."""
    nodes = _nested(spark, sf_dir, True)
    nodes = nodes.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n.node_path, n.parent_path, n.n_fields, F.map_from_entries(n.fields).alias("fields"))))
    return explode_nodes(nodes)


QUERIES = {"p3_found": p3_found, "p3_formats": p3_formats, "p5_found": p5_found, "p5_table": p5_table, "p7_found": p7_found, "p7_tables": p7_tables}

# ---------------------------------------------------------------- the same rows in SQL

_NODES = """WITH v AS (SELECT DISTINCT 'video_info' AS src, info_id AS rec_id, CASE WHEN json_valid(info_dict) THEN CASE WHEN json_type(info_dict) = 'VARCHAR' THEN json_extract_string(info_dict, '$') ELSE info_dict END END AS d FROM video_info
UNION SELECT 'posts', post_id, CASE WHEN author IS NOT NULL THEN CAST(to_json({'author': author}) AS VARCHAR) END FROM posts),
t AS (SELECT v.src, v.rec_id, j.fullkey, j.path, j.type FROM (SELECT * FROM v WHERE json_valid(d)) v, json_tree(v.d) j),
filled AS (SELECT DISTINCT src, rec_id, path FROM t WHERE type <> 'NULL' AND fullkey <> '$')
SELECT DISTINCT t.src, t.rec_id, replace(substr(t.fullkey, 3), '"', '') AS node_path FROM t JOIN filled f ON f.src = t.src AND f.rec_id = t.rec_id AND f.path = t.fullkey WHERE t.type = 'OBJECT' AND t.fullkey <> '$'"""

_DRIFT = """WITH files AS (SELECT DISTINCT feed, CAST(file_no AS BIGINT) AS n FROM raw_records),
r AS (SELECT DISTINCT feed, CAST(file_no AS BIGINT) AS n, payload FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
f AS (SELECT r.feed, r.n, json_extract_string(r.payload, '$.id') AS rid, replace(substr(j.fullkey, 3), '"', '') AS p,
  CASE j.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'fractional' ELSE 'integer' END AS kind, CAST(j.value AS VARCHAR) AS val
  FROM r, json_tree(r.payload) j WHERE j.fullkey <> '$' AND j.type <> 'NULL' AND NOT contains(j.fullkey, '[')),
s AS (SELECT feed, n, p, mode(kind) AS kind FROM f GROUP BY feed, n, p),
pairs AS (SELECT b.feed, b.n FROM files a JOIN files b ON a.feed = b.feed AND a.n + 1 = b.n),
old AS (SELECT q.feed, q.n, s.p, s.kind FROM pairs q JOIN s ON s.feed = q.feed AND s.n = q.n - 1),
new AS (SELECT q.feed, q.n, s.p, s.kind FROM pairs q JOIN s ON s.feed = q.feed AND s.n = q.n),
gone AS (SELECT o.* FROM old o LEFT JOIN new w ON o.feed = w.feed AND o.n = w.n AND o.p = w.p WHERE w.p IS NULL),
come AS (SELECT w.* FROM new w LEFT JOIN old o ON o.feed = w.feed AND o.n = w.n AND o.p = w.p WHERE o.p IS NULL),
turned AS (SELECT o.feed, o.n, o.p FROM old o JOIN new w ON o.feed = w.feed AND o.n = w.n AND o.p = w.p WHERE o.kind <> w.kind),
gone_tops AS (SELECT g.* FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.feed = g.feed AND x.n = g.n AND starts_with(g.p, x.p || '.')) AND NOT EXISTS (SELECT 1 FROM turned x WHERE x.feed = g.feed AND x.n = g.n AND starts_with(g.p, x.p || '.'))),
come_tops AS (SELECT g.* FROM come g WHERE NOT EXISTS (SELECT 1 FROM come x WHERE x.feed = g.feed AND x.n = g.n AND starts_with(g.p, x.p || '.')) AND NOT EXISTS (SELECT 1 FROM turned x WHERE x.feed = g.feed AND x.n = g.n AND starts_with(g.p, x.p || '.'))),
proof AS (SELECT g.feed, g.n, g.p AS old_p, c.p AS new_p FROM gone_tops g JOIN come_tops c ON g.feed = c.feed AND g.n = c.n AND g.kind = c.kind
  JOIN (SELECT DISTINCT feed, n, rid, p, val FROM f) a ON a.feed = g.feed AND a.n = g.n - 1 AND a.p = g.p JOIN (SELECT DISTINCT feed, n, rid, p, val FROM f) b ON b.feed = g.feed AND b.n = g.n AND b.p = c.p AND a.rid = b.rid
  GROUP BY g.feed, g.n, g.p, c.p HAVING sum(CAST(a.val = b.val AS INT)) > 0 AND 2 * sum(CAST(a.val = b.val AS INT)) >= count(*))
SELECT feed, n AS file_no, old_p AS field_path, 'renamed' AS change_kind, new_p AS new_path FROM proof
UNION ALL SELECT feed, n, p, 'retyped', '' FROM turned t WHERE NOT EXISTS (SELECT 1 FROM turned x WHERE x.feed = t.feed AND x.n = t.n AND starts_with(t.p, x.p || '.'))
UNION ALL SELECT feed, n, p, 'removed', '' FROM gone_tops g WHERE NOT EXISTS (SELECT 1 FROM proof x WHERE x.feed = g.feed AND x.n = g.n AND x.old_p = g.p)
UNION ALL SELECT feed, n, p, 'added', '' FROM come_tops g WHERE NOT EXISTS (SELECT 1 FROM proof x WHERE x.feed = g.feed AND x.n = g.n AND x.new_p = g.p)"""



# The twin of p3_found has its own values. Patterns in the dialect of the SQL engine with the groups of
# year, month, day, hour, minute, second, fraction, half of the day, zone and region; minutes of zone letters; months.
_CLOCK = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
_PLACE = r"(Z|[+-]\d\d(?::?\d\d)?|[A-Z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?(?:\[([A-Za-z]+(?:/[A-Za-z_+-]+)*)\])?"
_MONTH = r"([^0-9_.,: /-]{3,12})\.?"
_AM = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_FORMATS = (
    ("iso", rf"^(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{_CLOCK} ?{_PLACE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("basic", rf"^(\d{{4}})(\d\d)(\d\d)(?:T(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d{{1,9}}))?)? ?{_PLACE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("epoch", r"^(\d{10,19})(?:\.(\d{1,9}))?$", (1, 0, 0, 0, 0, 0, 2, 0, 0, 0)),
    ("slash_ymd", rf"^(\d{{4}})/(\d\d?)/(\d\d?)(?:[T ]{_CLOCK} ?{_PLACE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("digits", rf"^(\d\d?)([/.-])(\d\d?)[/.-](\d{{4}})(?:,? {_CLOCK}{_AM} ?{_PLACE})?$", (4, 1, 3, 5, 6, 7, 8, 9, 10, 11)),
    ("mail", rf"^(?:{_MONTH},? )?(\d\d?) {_MONTH} (\d{{4}}) {_CLOCK} ?{_PLACE}$", (4, 3, 2, 5, 6, 7, 8, 0, 9, 10)),
    ("month_first", rf"^{_MONTH} (\d\d?),? (\d{{4}})(?:,? {_CLOCK}{_AM} ?{_PLACE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    ("clock_first", rf"^{_CLOCK}{_AM} [·-] {_MONTH} (\d\d?), (\d{{4}})$", (8, 6, 7, 1, 2, 3, 4, 5, 0, 0)),
    ("de", rf"^(\d\d?) de {_MONTH} de (\d{{4}})(?:,?(?: às| a las)? (\d\d?)[:h](\d\d)(?::(\d\d))? ?{_PLACE})?$", (3, 2, 1, 4, 5, 6, 0, 0, 7, 8)),
)
_LETTERS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "BRT": -180, "ART": -180, "EDT": -240, "EST": -300, "PDT": -420, "PST": -480}
_MONTHS = (
    "january jan janu janeiro jane enero ene ener", "february feb febrero febr fevereiro fev feve", "march mar marc marzo marz março març", "april apr apri abril abr abri",
    "may mayo maio mai", "june jun junio juni junho junh", "july jul julio juli julho julh", "august aug augu agosto ago agos",
    "september sep sept septiembre setembro set sete", "october oct octo octubre octu outubro out outu", "november nov nove noviembre novi novembro",
    "december dec dece diciembre dic dici dezembro dez deze",
)


def _only_group(pattern: str, wanted: int) -> str:
    """The pattern with one group left that captures."""
    count = 0

    def keep(m: re.Match) -> str:
        nonlocal count
        count += 1
        return "(" if count == wanted else "(?:"

    return re.sub(r"\((?!\?)", keep, pattern)


def _instants_sql(last: str) -> str:
    """The cascade with SQL pattern functions; the later of two equal local times is moved back by hand."""
    fits = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{n}'" for n, p, _ in _FORMATS) + " END"
    slots = ("y", "mo", "d", "h", "mi", "s", "f", "half", "zone", "region")
    columns = []
    for k, slot in enumerate(slots):
        parts = [f"WHEN '{name}' THEN " + (f"regexp_extract(c, '{_only_group(pattern, groups[k])}', 1)" if groups[k] else "''") for name, pattern, groups in _FORMATS]
        columns.append(f"CASE fmt {' '.join(parts)} END AS {slot}")
    months = "CASE lower(mo) " + " ".join(f"WHEN '{m}' THEN {n}" for n, names in enumerate(_MONTHS, 1) for m in names.split()) + " ELSE try_cast(mo AS INT) END"
    letters = "CASE zone " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in _LETTERS.items()) + " END"
    swap = "fmt = 'digits' AND coalesce(locale, '') <> 'en-US'"
    digits = "regexp_replace(zone, '[^0-9]', '', 'g')"
    offset = f"CASE WHEN regexp_matches(zone, '^[+-]') THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST({digits}[1:2] AS INT) * 60 + coalesce(try_cast({digits}[3:4] AS INT), 0)) ELSE {letters} END"
    place = "CASE WHEN contains(zone, '/') THEN zone WHEN zone = '' AND region <> '' THEN region WHEN zone = '' THEN home_zone END"
    blank = r"[\s\x{a0}\x{202f}\x{2009}]+"
    return f"""WITH x AS (SELECT src, rec_id, handle, t FROM (SELECT 'posts' AS src, post_id AS rec_id, author.handle AS handle, timestamp_raw AS t, ingested_at FROM posts UNION ALL SELECT 'video_inputs', input_id, handle, date_raw, ingested_at FROM video_inputs UNION ALL SELECT 'video_info', info_id, uploader_id, video_date, ingested_at FROM video_info) QUALIFY row_number() OVER (PARTITION BY src, rec_id ORDER BY ingested_at DESC NULLS LAST, t DESC NULLS LAST) = 1),
z AS (SELECT handle, min(home_zone) AS home_zone, min(locale) AS locale FROM authors GROUP BY handle),
c AS (SELECT src, rec_id, home_zone, locale, trim(regexp_replace(t, '{blank}', ' ', 'g')) AS c FROM x LEFT JOIN z USING (handle) WHERE t IS NOT NULL),
p AS (SELECT *, {", ".join(columns)} FROM (SELECT *, {fits} AS fmt FROM c) WHERE fmt IS NOT NULL),
n AS (SELECT *, try_cast(y AS BIGINT) AS year, CASE WHEN {swap} THEN try_cast(d AS INT) ELSE {months} END AS month, CASE WHEN {swap} THEN try_cast(mo AS INT) ELSE try_cast(d AS INT) END AS day,
  coalesce(try_cast(h AS INT), 0) AS hour, coalesce(try_cast(mi AS INT), 0) AS minute, coalesce(try_cast(s AS INT), 0) AS second, CAST(rpad(f[1:6], 6, '0') AS BIGINT) AS micro, {offset} AS off, {place} AS place FROM p),
w AS (SELECT *, CASE WHEN fmt <> 'epoch' AND minute < 60 AND second < 60 AND CASE WHEN half = '' THEN hour < 24 ELSE hour BETWEEN 1 AND 12 END THEN
  try_cast(try_cast(printf('%04d-%02d-%02d', year, month, day) AS DATE) AS TIMESTAMP) + to_microseconds(CAST(((CASE WHEN half = '' THEN hour ELSE hour % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END) * 3600 + minute * 60 + second) AS BIGINT) * 1000000 + micro) END AS wall FROM n),
u AS (SELECT *, CASE WHEN off IS NULL AND place IS NOT NULL THEN timezone(place, wall) END AS late FROM w),
r AS (SELECT src, rec_id, fmt, CASE WHEN fmt = 'epoch' THEN CASE WHEN length(y) <= 11 THEN year * 1000000 + micro WHEN length(y) <= 14 THEN year * 1000 + micro // 1000 WHEN length(y) <= 17 THEN year ELSE year // 1000 END
  WHEN off IS NOT NULL THEN epoch_us(wall) - CAST(off AS BIGINT) * 60000000 WHEN timezone(place, late - INTERVAL 1 HOUR) = wall THEN epoch_us(late) - 3600000000 ELSE epoch_us(late) END AS utc_us FROM u)
{last}"""


_P3_FOUND = _instants_sql("SELECT src, rec_id, CAST(utc_us AS BIGINT) AS utc_us FROM r WHERE utc_us IS NOT NULL")
_P3_FORMATS = _instants_sql("SELECT x.src, r.fmt AS ts_format, count(*) AS n_records, count(r.utc_us) AS n_resolved FROM x LEFT JOIN r ON x.src = r.src AND x.rec_id = r.rec_id GROUP BY 1, 2")
ORACLES = {"p3_found": _P3_FOUND, "p3_formats": _P3_FORMATS, "p5_found": _DRIFT, "p7_found": _NODES}
