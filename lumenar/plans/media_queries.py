"""Queries of the media operators over the whole tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.functions import naming, text, urls
from lumenar.operators import clips, html, ledger, notes, transcript
from lumenar.session import read_table
from lumenar.sources.sinks import sidecar_documents
from lumenar.streaming import grid

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(make):  # noqa: ANN001, ANN202
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


#: Blanks of every script, for SQL engines whose \s is ASCII only.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _latest(df: DataFrame, key: str, order: str = "ingested_at", **columns: Column) -> DataFrame:
    """One row per key with ``columns`` of its latest delivery, the greatest of deliveries at one time.

    ``columns`` are worked out first, so what meets per key are results and not the rows they come from.
    """
    made = df.select(key, F.col(order).alias("__lumenar_at"), *[c.alias(n) for n, c in columns.items()])
    return made.groupBy(key).agg(F.max(F.struct("__lumenar_at", *columns)).alias("last")).select(key, *[F.col(f"last.{n}").alias(n) for n in columns])


def _latest_sql(table: str, key: str, where: str = "", order: str = "ingested_at", **columns: str) -> str:
    names = list(columns)
    inner = f"SELECT {key}, {order} AS at_, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table} {where}"
    return f"(SELECT {key}, {', '.join(names)} FROM ({inner}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY at_ DESC NULLS LAST, {', '.join(f'{n} DESC NULLS LAST' for n in names)}) = 1)"


# ---------------------------------------------------------------- addresses

#: The tables hold addresses of one host, so most rows get a made-up address of the hosts that matter.
_URL_CASE = """CASE input_id % 12
 WHEN 0 THEN 'https://www.facebook.com/watch/?v=' || input_id || '&mibextid=x'
 WHEN 1 THEN 'https://m.facebook.com/share/v/' || input_id || 'Ab/?__tn__=R'
 WHEN 2 THEN 'https://www.instagram.com/reel/C' || input_id || '_x/?utm=1'
 WHEN 3 THEN 'https://www.tiktok.com/@user/video/' || input_id
 WHEN 4 THEN 'https://youtu.be/a' || input_id
 WHEN 5 THEN 'https://drive.google.com/file/d/AbCdEf-' || input_id || '_zyxwv/view'
 WHEN 6 THEN 'https://drive.google.com/open?id=short'
 WHEN 7 THEN 'HTTPS://www.Example.org:8080/a b?v=1%20' || input_id
 WHEN 8 THEN 'https://maps.google.de/maps?id=' || input_id
 WHEN 9 THEN 'https://facebook.org/v/' || input_id
 WHEN 10 THEN 'https://lh3.GoogleUserContent.com/d/' || input_id
 ELSE url END"""
_URLS = _latest_sql("video_inputs", "input_id", url=_URL_CASE)
_AUTHORITY = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_HOST = (
    f"CASE WHEN url IS NULL THEN NULL WHEN contains({_AUTHORITY}, 'facebook.com') THEN 'facebook' WHEN contains({_AUTHORITY}, 'instagram.com') OR contains({_AUTHORITY}, 'tiktok.com') THEN 'instagram' "
    f"WHEN contains({_AUTHORITY}, 'youtube.com') OR contains({_AUTHORITY}, 'youtu.be') THEN 'youtube' WHEN contains({_AUTHORITY}, 'google.com') OR contains({_AUTHORITY}, 'googleusercontent.com') THEN 'google_drive' ELSE 'unknown' END"
)


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(read_table(spark, sf_dir, "video_inputs"), "input_id", url=F.expr(_URL_CASE))


@query(
    f"SELECT input_id, coalesce('https://www.facebook.com/watch/?v=' || coalesce(url_decode(nullif(regexp_extract({_QUERY}, '(?:^|&)v=([^&]+)', 1), '')), "
    f"nullif(regexp_extract({_PATH}, '/v/([0-9A-Za-z]+)', 1), '')), url) AS canonical FROM {_URLS}"
)
def url_facebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("input_id", urls.facebook_watch(F.col("url")).alias("canonical"))


@query(
    f"SELECT input_id, CASE WHEN regexp_extract({_PATH}, '/(reel|p|tv)/([^/?]+)', 1) <> '' THEN 'https://www.instagram.com/' || regexp_extract({_PATH}, '/(reel|p|tv)/([^/?]+)', 1) || '/' || "
    f"regexp_extract({_PATH}, '/(reel|p|tv)/([^/?]+)', 2) || '/' ELSE url END AS canonical FROM {_URLS}"
)
def url_instagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("input_id", urls.instagram_post(F.col("url")).alias("canonical"))


@query(f"SELECT input_id, {_HOST} AS host FROM {_URLS}")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("input_id", urls.host_class(F.col("url")).alias("host"))


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM {_URLS} GROUP BY 1")
def url_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).groupBy(urls.host_class(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(rf"SELECT input_id, nullif(regexp_extract(url, '(?:/file/d/|id=)([\w-]{{10,}})', 1), '') AS file_id FROM {_URLS}")
def url_drive_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("input_id", urls.drive_file_id(F.col("url")).alias("file_id"))


_SLUG = "trim(regexp_replace(replace(split_part(string_split(url, '//')[-1], '/', 1), 'www.', ''), '[^A-Za-z0-9_]+', '-', 'g'), '-')"


@query(f"SELECT * FROM {_latest_sql('page_captures', 'page_id', slug=_SLUG)}")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(read_table(spark, sf_dir, "page_captures"), "page_id", slug=urls.slug(F.col("url")))


# ---------------------------------------------------------------- metadata and names

_INFO = "(SELECT info_id, ingested_at, CASE WHEN json_valid(info_dict) THEN info_dict END AS d FROM video_info)"


# Kept fields and the keys they are read from, as the operator must have them.
_MASK = {
    "video_title": ("title",), "video_date": ("upload_date",), "uploader": ("uploader", "uploader_id"), "file_path": ("file_path",),
    "duration": ("duration",), "width": ("width",), "height": ("height",), "ext": ("ext",), "resolution": ("resolution",), "fps": ("fps",),
    "channels": ("channels",), "filesize": ("filesize",), "tbr": ("tbr",), "protocol": ("protocol",), "vcodec": ("vcodec",), "vbr": ("vbr",),
    "acodec": ("acodec",), "abr": ("abr",), "asr": ("asr",),
}


def _masked_sql() -> str:
    columns = {}
    for name, sources in _MASK.items():
        value = "NULL"
        for key in reversed(sources):
            value = f"CASE WHEN list_contains(json_keys(d), '{key}') THEN json_extract_string(d, '$.{key}') ELSE {value} END"
        columns[name] = f"replace({value}, chr(32), chr(95))" if name == "video_title" else value
    return f"SELECT * FROM {_latest_sql(_INFO, 'info_id', **columns)}"


@query(_masked_sql())
def meta_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = read_table(spark, sf_dir, "video_info").select("info_id", "ingested_at", "info_dict")
    masked = naming.masked_metadata(info, "info_dict")
    return _latest(masked, "info_id", **{n: F.col(n) for n in naming.METADATA_FIELDS})


_FILES = _latest_sql(
    "video_info", "info_id",
    filename="replace(replace(coalesce(nullif(" + _strip_sql("uploader") + ", ''), 'unknown_uploader'), ' ', '_'), '/', '_') || '_' || "
    "coalesce(nullif(" + _strip_sql("video_date") + ", ''), 'unknown_date') || '.' || coalesce(ext, 'mp4')",
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = naming.original_filename(F.col("uploader"), F.col("video_date"), F.col("ext"))
    return _latest(read_table(spark, sf_dir, "video_info"), "info_id", filename=name)


@query(f"SELECT info_id, filename FROM {_FILES}")
def meta_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


@query(
    "SELECT info_id, filename, CASE WHEN k = 0 THEN filename ELSE regexp_replace(filename, '^(.*?)(\\.[^./]*)?$', '\\1') || '_' || k || regexp_extract(filename, '(\\.[^./]*)?$', 1) END AS unique_name "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY info_id) - 1 AS k FROM {_FILES})"
)
def meta_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.unique_names(_files(spark, sf_dir), "filename", ["info_id"])


@query(
    "SELECT info_id, '.' || ext AS ext, CASE ext WHEN 'webm' THEN 'libvpx' WHEN 'ogv' THEN 'libtheora' ELSE 'libx264' END AS video_codec, "
    f"CASE WHEN ext IN ('webm', 'ogv') THEN 'libvorbis' ELSE 'aac' END AS audio_codec FROM {_latest_sql('video_info', 'info_id', ext='ext')}"
)
def meta_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _latest(read_table(spark, sf_dir, "video_info"), "info_id", ext=F.concat(F.lit("."), "ext"))
    return naming.with_codecs(info, "ext")


_TIME_CASE = "CASE seg_idx % 5 WHEN 0 THEN '' || seg_idx WHEN 1 THEN '1:' || seg_idx WHEN 2 THEN '2:03:' || seg_idx WHEN 3 THEN 'x' || seg_idx END"


@query(
    f"SELECT media_id, seg_idx, CASE seg_idx % 5 WHEN 0 THEN seg_idx WHEN 1 THEN 60 + seg_idx WHEN 2 THEN 7380 + seg_idx END AS seconds FROM (SELECT DISTINCT media_id, seg_idx, {_TIME_CASE} AS t FROM asr_segments)"
)
def meta_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = read_table(spark, sf_dir, "asr_segments").selectExpr("media_id", "seg_idx", f"{_TIME_CASE} AS t").distinct()
    return times.select("media_id", "seg_idx", naming.seconds_of(F.col("t")).alias("seconds"))


_TASKS = ("perform_download", "apply_watermark", "make_clips", "extract_audio", "generate_captions", "post_process")


_VALID = "coalesce(regexp_matches(url, '^https?://') AND title IS NOT NULL AND date_raw IS NOT NULL AND " + " AND ".join(f"tasks.{t} IS NOT NULL" for t in _TASKS) + ", false)"


@query(f"SELECT * FROM {_latest_sql('video_inputs', 'input_id', valid=_VALID)}")
def meta_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = naming.required_fields_ok(F.col("url"), F.col("title"), F.col("date_raw"), [F.col(f"tasks.{t}") for t in _TASKS])
    return _latest(read_table(spark, sf_dir, "video_inputs"), "input_id", valid=ok)


_FOLDER = "'out/' || media_id || '_' || strftime(run_at AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') || '/clips_' || strftime(run_at AT TIME ZONE 'UTC', '%H%M%S')"


@query(f"SELECT * FROM {_latest_sql('transcribe_runs', 'run_id', folder=_FOLDER)}")
def meta_output_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = naming.output_directory(F.lit("out"), F.col("media_id"), F.col("run_at"), F.lit("clips"))
    return _latest(read_table(spark, sf_dir, "transcribe_runs"), "run_id", folder=folder)


@query(
    "SELECT DISTINCT input_id, CASE WHEN input_id % 3 = 0 THEN 'over' ELSE 'base' END AS a, 'base' AS b, CASE WHEN input_id % 3 = 0 THEN 'new' END AS c FROM video_inputs"
)
def meta_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base"))
    over = F.when(F.col("input_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("over"), F.lit("c"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    laid = read_table(spark, sf_dir, "video_inputs").select("input_id").distinct().select("input_id", naming.overlay_maps(base, over).alias("m"))
    return laid.select("input_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


_SIDECAR = "SELECT 'v/' || media_id || '.json' AS config_json, '{\"info_id\":' || info_id || ',\"original_filename\":\"v/' || media_id || '.mp4\"}' AS body FROM "


@query(_SIDECAR + _latest_sql("video_info", "info_id", media_id="media_id") + " WHERE media_id IS NOT NULL")
def meta_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar_documents(_latest(read_table(spark, sf_dir, "video_info"), "info_id", original_filename=F.concat(F.lit("v/"), "media_id", F.lit(".mp4"))))


# ---------------------------------------------------------------- ledgers

_TASK_ROWS = _latest_sql("video_inputs", "input_id", tasks="tasks")
_LONG = (
    "(SELECT input_id, k.pos, k.task, CASE k.task "
    + " ".join(f"WHEN '{t}' THEN tasks.{t}" for t in _TASKS)
    + f" END AS flag FROM {_TASK_ROWS} CROSS JOIN (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TASKS))
    + ") AS k(pos, task) WHERE tasks IS NOT NULL)"
)
_STATE = "CASE WHEN flag THEN 'PENDING' WHEN NOT flag THEN 'DISABLED' ELSE 'SKIPPED' END"
_DONE = "task = 'perform_download' AND input_id % 2 = 0"


def _ledgers(spark: SparkSession, sf_dir: str, with_nulls: bool = True) -> DataFrame:
    tasks = F.to_json("tasks", {"ignoreNullFields": str(not with_nulls).lower()})
    inputs = _latest(read_table(spark, sf_dir, "video_inputs"), "input_id", t=tasks)
    return inputs.select("input_id", ledger.ledger_of(F.col("t")).alias("ledger"))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.when(F.col("input_id") % 2 == 0, F.concat(F.lit("media/"), "input_id", F.lit(".mp4")))
    return _ledgers(spark, sf_dir).withColumn("ledger", ledger.with_output(F.col("ledger"), "perform_download", output))


@query(f"SELECT input_id, pos, task, {_STATE} AS state FROM {_LONG}")
def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entries(_ledgers(spark, sf_dir), "ledger").drop("output")


@query(f"SELECT task, {_STATE} AS state, count(*) AS n FROM {_LONG} GROUP BY 1, 2")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entries(_ledgers(spark, sf_dir), "ledger").groupBy("task", "state").agg(F.count("*").alias("n"))


@query(f"SELECT input_id, coalesce(tasks.make_clips, false) AS clips_due FROM {_TASK_ROWS}")
def ledger_should_perform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledgers(spark, sf_dir).select("input_id", F.coalesce(ledger.should_perform(F.col("ledger"), "make_clips"), F.lit(False)).alias("clips_due"))


@query(
    f"SELECT input_id, task, CASE WHEN flag IS NULL THEN CASE WHEN task IN ('perform_download', 'apply_watermark') THEN 'PENDING' ELSE 'DISABLED' END ELSE {_STATE} END AS state FROM {_LONG}"
)
def ledger_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = ledger.default_ledger({t: i < 2 for i, t in enumerate(_TASKS)})
    filled = _ledgers(spark, sf_dir, with_nulls=False).withColumn("ledger", ledger.with_defaults(F.col("ledger"), defaults))
    return ledger.entries(filled, "ledger").select("input_id", "task", "state")


@query(
    f"SELECT input_id, pos, task, CASE WHEN {_DONE} THEN 'DONE' ELSE {_STATE} END AS state, CASE WHEN {_DONE} THEN 'media/' || input_id || '.mp4' END AS output FROM {_LONG}"
)
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entries(_upserted(spark, sf_dir), "ledger")


@query(
    "SELECT input_id, CASE WHEN tasks.perform_download AND input_id % 2 = 1 THEN 'perform_download' WHEN tasks.apply_watermark THEN 'apply_watermark' "
    f"WHEN tasks.generate_captions THEN 'generate_captions' WHEN tasks.post_process THEN 'post_process' END AS next_task FROM {_TASK_ROWS}"
)
def ledger_next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).select("input_id", ledger.next_task(F.col("ledger")).alias("next_task"))


_SCRIPT = "CASE task WHEN 'perform_download' THEN 'download' WHEN 'apply_watermark' THEN 'watermark' WHEN 'generate_captions' THEN 'captions' WHEN 'post_process' THEN 'screenshots' END"


@query(
    f"SELECT input_id, pos, task, {_SCRIPT} AS script, CASE task WHEN 'perform_download' THEN 'u/' || input_id ELSE 'f/' || input_id END AS input, "
    f"CASE WHEN {_SCRIPT} IS NULL THEN 'NO_SCRIPT' WHEN {_DONE} THEN 'DONE' WHEN flag THEN 'RUN' ELSE 'SKIP' END AS action FROM {_LONG}"
)
def ledger_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _upserted(spark, sf_dir).withColumns({"url": F.concat(F.lit("u/"), "input_id"), "file": F.concat(F.lit("f/"), "input_id")})
    return ledger.dispatch_plan(rows, "ledger", "url", "file").drop("url", "file")


@query("SELECT url, min('meta/' || input_id || '.json') AS path FROM video_inputs WHERE url IS NOT NULL GROUP BY url")
def ledger_find_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "video_inputs").select(F.concat(F.lit("meta/"), "input_id", F.lit(".json")).alias("path"), "url")
    return ledger.first_by_url(docs).select("url", "path")


@query(f"SELECT input_id, url FROM {_latest_sql('video_inputs', 'input_id', url='url')} WHERE url IS NULL OR url NOT IN (SELECT url FROM {_latest_sql('video_inputs', 'input_id', url='url')} WHERE input_id % 3 = 0 AND url IS NOT NULL)")
def ledger_new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _latest(read_table(spark, sf_dir, "video_inputs"), "input_id", url=F.col("url"))
    return ledger.unknown_only(inputs, inputs.filter("input_id % 3 = 0"))


_OUTPUT_OF = "coalesce(nullif(article_url, ''), nullif(asr_model, ''), media_id)"


@query(f"SELECT * FROM {_latest_sql('transcribe_runs', 'run_id', output=_OUTPUT_OF)}")
def ledger_task_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.task_output(F.col("article_url"), F.col("asr_model"), F.col("media_id"))
    return _latest(read_table(spark, sf_dir, "transcribe_runs"), "run_id", output=out)


@query(
    "SELECT DISTINCT 'docs/' || input_id || '/a.json' AS json_path, CASE WHEN input_id % 2 = 0 THEN 'docs/' || input_id || '/w.mp4' ELSE '/abs/w' || input_id || '.mp4' END AS source_path, "
    f"'docs/' || input_id || '/distro/vault/' || CASE WHEN input_id % 2 = 0 THEN 'w.mp4' ELSE 'w' || input_id || '.mp4' END AS target_path FROM {_TASK_ROWS} WHERE tasks IS NOT NULL"
)
def ledger_vault_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("input_id") % 2 == 0, "w.mp4").otherwise(F.concat(F.lit("/abs/w"), "input_id", F.lit(".mp4")))
    docs = _ledgers(spark, sf_dir).withColumn("path", F.concat(F.lit("docs/"), "input_id", F.lit("/a.json")))
    return ledger.vault_moves(docs.withColumn("ledger", ledger.with_output(F.col("ledger"), "add_watermark", made)), "ledger", "path")


_UPLOADER_TEXT = "CASE WHEN json_valid(info_dict) AND json_type(info_dict, '$.uploader') = 'VARCHAR' THEN json_extract_string(info_dict, '$.uploader') END"


@query(f"SELECT * FROM {_latest_sql('video_info', 'info_id', output=_UPLOADER_TEXT)}")
def ledger_existing_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(read_table(spark, sf_dir, "video_info"), "info_id", output=ledger.existing_output(F.try_parse_json("info_dict"), "uploader"))


_CHAIN = _latest_sql("video_info", "info_id", uploader="uploader", video_date="video_date", ext="ext")
_NAMED = (
    "replace(replace(coalesce(nullif(" + _strip_sql("uploader") + ", ''), 'unknown_uploader'), ' ', '_'), '/', '_') || '_' || "
    "coalesce(nullif(" + _strip_sql("video_date") + ", ''), 'unknown_date') || '.' || coalesce(ext, 'mp4')"
)
_SECONDS = (
    "CASE WHEN regexp_full_match(video_date, '[0-9]{1,12}') THEN CAST(video_date AS BIGINT) WHEN regexp_full_match(video_date, '[0-9]{1,9}:[0-9]{1,9}:[0-9]{1,9}') "
    "THEN CAST(split_part(video_date, ':', 1) AS BIGINT) * 3600 + CAST(split_part(video_date, ':', 2) AS BIGINT) * 60 + CAST(split_part(video_date, ':', 3) AS BIGINT) "
    "WHEN regexp_full_match(video_date, '[0-9]{1,9}:[0-9]{1,9}') THEN CAST(split_part(video_date, ':', 1) AS BIGINT) * 60 + CAST(split_part(video_date, ':', 2) AS BIGINT) END"
)


@query(
    f"SELECT info_id, uploader, video_date, ext, {_NAMED} AS original_filename, regexp_replace({_NAMED}, '\\.[^./]*$', '') || '_wm.mp4' AS watermarked, {_SECONDS} AS date_seconds, "
    f"CASE WHEN {_SECONDS} IS NULL THEN 'date_seconds' ELSE '' END AS errors FROM {_CHAIN}"
)
def ledger_merge_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The download chain as columns: name, watermarked file, seconds; what a step can't give is listed in ``errors``."""
    info = _latest(read_table(spark, sf_dir, "video_info"), "info_id", **{c: F.col(c) for c in ("uploader", "video_date", "ext")})
    steps = [
        ("original_filename", lambda: naming.original_filename(F.col("uploader"), F.col("video_date"), F.col("ext"))),
        ("watermarked", lambda: clips.watermark_target(F.col("original_filename"))),
        ("date_seconds", lambda: naming.seconds_of(F.col("video_date"))),
    ]
    return ledger.merge_forward(info, steps).withColumn("errors", F.array_join("errors", ","))


# ---------------------------------------------------------------- pages and texts

_PARAGRAPHS = (
    r"list_filter(list_transform(regexp_extract_all(raw_html, '<p(?:\s[^>]*)?>(.*?)</p\s*>', 1, 'is'), lambda p: "
    + _strip_sql(r"replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')".replace('\\"', '"'))
    + "), lambda p: p <> '')"
)
_ARTICLE = f"coalesce(array_to_string({_PARAGRAPHS}, chr(10) || chr(10)), '')"


def _articles_sql(name: str, made: str) -> str:
    return f"SELECT * FROM {_latest_sql(f'(SELECT *, {_ARTICLE} AS a FROM page_captures WHERE raw_html IS NOT NULL)', 'page_id', **{name: made})}"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "page_captures").filter("raw_html is not null").select("page_id", "ingested_at", "raw_html")


@query(_articles_sql("article", "a"))
def html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(_pages(spark, sf_dir), "page_id", article=html.article_text(F.col("raw_html")))


@query(_articles_sql("article", "a"))
def html_article_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(_pages(spark, sf_dir), "page_id", article=html.article_text_native(F.col("raw_html")))


@query(_articles_sql("preview", "CASE WHEN length(a) > 1500 THEN left(a, 1500) || '...' ELSE a END"))
def html_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(_pages(spark, sf_dir), "page_id", preview=text.preview(html.article_text_native(F.col("raw_html"))))


@query()
def html_editorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(_pages(spark, sf_dir), "page_id", e=html.editorial_text(F.col("raw_html"))).select("page_id", "e.plain", "e.marked")


@query(
    f"SELECT doc_id, i - 1 AS sent_idx, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_strip_sql('text')}, "
    f"'([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip_sql('s')}), lambda s: s <> '') AS parts FROM documents WHERE text IS NOT NULL))"
)
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return docs.select("doc_id", F.col("i").cast("bigint").alias("sent_idx"), "sentence")


_LANGUAGES = ("spanish", "english", "portuguese")
_CONTENTS = _latest_sql("posts", "post_id", **{x: f"content.{x}" for x in _LANGUAGES})


@query(" UNION ALL ".join(f"SELECT post_id, '{x}' AS lang, {x} AS text FROM {_CONTENTS} WHERE {x} IS NOT NULL" for x in _LANGUAGES))
def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _latest(read_table(spark, sf_dir, "posts"), "post_id", **{x: F.col(f"content.{x}") for x in _LANGUAGES})
    return transcript.unpivot_languages(posts.select("post_id", F.struct(*_LANGUAGES).alias("content")), "content", list(_LANGUAGES), ["post_id"])


@query()
def text_source_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's transcript against the article of the same run."""
    runs = read_table(spark, sf_dir, "transcribe_runs").groupBy("run_id").agg(F.max(F.struct("ingested_at", "full_transcript", "plain_text")).alias("r"))
    both = runs.filter("r.full_transcript is not null and r.plain_text is not null")
    return both.select("run_id", transcript.compare_texts(F.col("r.full_transcript"), F.col("r.plain_text")).alias("ratio"))


@query()
def text_language_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two texts of one post, by language."""
    return transcript.pairwise_similarity(text_languages(spark, sf_dir), "lang", "text", "post_id")


# ---------------------------------------------------------------- transcripts

# segments carry no time of delivery: of several deliveries of a segment the greatest counts
_SEGMENTS = "(SELECT media_id, seg_idx, start_s, end_s, text FROM asr_segments QUALIFY row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY start_s DESC NULLS LAST, end_s DESC NULLS LAST, text DESC NULLS LAST) = 1)"
_CLEAN = f"(SELECT * FROM (SELECT media_id, seg_idx, start_s, end_s, {_strip_sql('text')} AS t FROM {_SEGMENTS}) WHERE t <> '')"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.max(F.struct("start_s", "end_s", "text")).alias("s")
    return read_table(spark, sf_dir, "asr_segments").groupBy("media_id", "seg_idx").agg(one).select("media_id", "seg_idx", "s.*")


@query(f"SELECT media_id, string_agg(t, ' ' ORDER BY seg_idx, t) AS full_text FROM {_CLEAN} GROUP BY media_id")
def transcript_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.segment_text(_segments(spark, sf_dir))


_MINUTES = f"(SELECT media_id, CAST(floor(start_s / 60) * 60 AS BIGINT) AS chunk_start, string_agg(t, ' ' ORDER BY seg_idx, t) AS chunk_text FROM {_CLEAN} WHERE start_s IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT media_id, chunk_start, chunk_text FROM {_MINUTES}")
def transcript_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.minute_transcript(_segments(spark, sf_dir))


@query(
    f"SELECT media_id, string_agg('[' || chunk_start || '-' || (chunk_start + 60) || ' sec]' || chr(10) || chunk_text || chr(10), chr(10) ORDER BY chunk_start) AS transcript FROM {_MINUTES} GROUP BY media_id"
)
def transcript_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = transcript.minute_transcript(_segments(spark, sf_dir)).withColumn("chunk_end", F.col("chunk_start") + 60)
    return transcript.stitched(chunks)


_GRID = "(SELECT info_id, d, unnest(generate_series(0, d - 1, 60)) AS chunk_start FROM (SELECT info_id, CAST(trunc(duration) AS BIGINT) AS d FROM " + _latest_sql("video_info", "info_id", duration="duration") + " WHERE duration >= 1))"


@query(f"SELECT info_id, chunk_start, least(chunk_start + 60, d) AS chunk_end, chunk_start || '-' || least(chunk_start + 60, d) || 's' AS label FROM {_GRID}")
def transcript_chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _latest(read_table(spark, sf_dir, "video_info"), "info_id", duration=F.col("duration"))
    chunks = transcript.chunk_grid(info, "duration").drop("duration")
    return chunks.withColumn("label", transcript.chunk_label(F.col("chunk_start"), F.col("chunk_end")))


@query(
    f"SELECT info_id, chunk_start, CASE WHEN chunk_start % 120 = 0 THEN 'held' WHEN info_id % 3 = 0 THEN '[ERROR: No transcript]' WHEN info_id % 3 = 1 THEN '[Unintelligible]' ELSE 'new' END AS chunk_text, "
    f"CASE WHEN chunk_start % 120 = 0 THEN 'CACHED' WHEN info_id % 3 = 0 THEN 'FAILED' WHEN info_id % 3 = 1 THEN 'UNINTELLIGIBLE' ELSE 'DONE' END AS status FROM {_GRID}"
)
def transcript_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _latest(read_table(spark, sf_dir, "video_info"), "info_id", duration=F.col("duration"))
    chunks = transcript.chunk_grid(info, "duration").select("info_id", "chunk_start")
    cache = chunks.filter("chunk_start % 120 = 0").withColumn("chunk_text", F.lit("held"))
    recognise = F.when(F.col("info_id") % 3 == 1, "").when(F.col("info_id") % 3 == 2, "new")
    return transcript.reuse_transcripts(chunks, cache, ["info_id", "chunk_start"], recognise)


# each sentence uses up segments from where the one before it stopped
_SENTENCES = (
    f"WITH RECURSIVE g AS (SELECT media_id, list(start_s ORDER BY seg_idx) AS starts, list(end_s ORDER BY seg_idx) AS ends, list(length(t) + 1 ORDER BY seg_idx) AS sizes, string_agg(t, ' ' ORDER BY seg_idx) AS whole "
    f"FROM (SELECT media_id, seg_idx, start_s, end_s, {_strip_sql('text')} AS t FROM {_SEGMENTS}) WHERE t IS NOT NULL GROUP BY media_id), "
    f"c AS (SELECT media_id, starts, ends, list_transform(range(0, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i]), 0)) AS cum, "
    f"list_filter(list_transform(string_split(regexp_replace({_strip_sql('whole')}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip_sql('s')}), lambda s: s <> '') AS parts FROM g), "
    "r AS (SELECT media_id, 0 AS k, CAST(0 AS BIGINT) AS at_, CAST(0 AS BIGINT) AS next_ FROM c UNION ALL "
    "SELECT c.media_id, r.k + 1, r.next_, least(len(c.ends), r.next_ + 1 + len(list_filter(c.cum[r.next_ + 2:], lambda x: x - c.cum[r.next_ + 1] < length(c.parts[r.k + 1])))) FROM r JOIN c USING (media_id) WHERE r.k < len(c.parts)), "
    "u AS (SELECT media_id, k - 1 AS sent_idx, parts[k] AS sentence, list_filter(starts[at_ + 1:next_], lambda x: x IS NOT NULL)[1] AS s, CASE WHEN next_ > at_ THEN ends[next_] END AS e FROM r JOIN c USING (media_id) WHERE k > 0) "
    "SELECT media_id, CAST(sent_idx AS INT) AS sent_idx, sentence, CAST(printf('%.2f', nullif(s, 0)) AS DOUBLE) AS start_s, CAST(printf('%.2f', nullif(e, 0)) AS DOUBLE) AS end_s FROM u"
)


@query(_SENTENCES)
def transcript_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.timed_sentences(_segments(spark, sf_dir))


def _clock_sql(x: str, mark: str) -> str:
    whole = f"CAST(trunc({x}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {whole} // 3600, ({whole} // 60) % 60, {whole} % 60, CAST(trunc(({x} - {whole}) * 1000) AS BIGINT))"


_TIMED = f"(SELECT * FROM {_SEGMENTS} WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND text IS NOT NULL)"
_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS k FROM {_TIMED})"


@query(
    f"SELECT media_id, string_agg(k || chr(10) || {_clock_sql('start_s', ',')} || ' --> ' || {_clock_sql('end_s', ',')} || chr(10) || {_strip_sql('text')} || chr(10) || chr(10), '' ORDER BY seg_idx) AS subtitles FROM {_NUMBERED} GROUP BY media_id"
)
def transcript_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.subtitles(_segments(spark, sf_dir), "srt")


@query(
    f"SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock_sql('start_s', '.')} || ' --> ' || {_clock_sql('end_s', '.')} || chr(10) || {_strip_sql('text')} || chr(10) || chr(10), '' ORDER BY seg_idx) AS subtitles FROM {_NUMBERED} GROUP BY media_id"
)
def transcript_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.subtitles(_segments(spark, sf_dir), "vtt")


_CAPTION = "CASE WHEN seg_idx % 4 = 0 THEN '' WHEN text = '[Unintelligible]' THEN NULL ELSE text END"


@query(f"SELECT media_id, seg_idx, coalesce(nullif({_CAPTION}, ''), CASE WHEN seg_idx % 3 = 0 THEN 'clip' END, '(No transcription)') AS caption FROM {_SEGMENTS}")
def transcript_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).withColumns({"recognised": F.expr(_CAPTION), "own": F.expr("CASE WHEN seg_idx % 3 = 0 THEN 'clip' END")})
    return rows.select("media_id", "seg_idx", transcript.caption_text(F.col("recognised"), F.col("own")).alias("caption"))


@query(
    f"SELECT media_id, seg_idx, CASE WHEN seg_idx % 7 = 0 THEN 'fixed' ELSE coalesce(text, '') END AS caption FROM {_SEGMENTS}"
)
def transcript_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("media_id", "seg_idx", F.coalesce("text", F.lit("")).alias("caption"))
    given = rows.filter("seg_idx % 7 = 0 or seg_idx % 5 = 0").select("media_id", "seg_idx", F.expr("if(seg_idx % 7 = 0, 'fixed', '')").alias("caption"))
    confirmed = transcript.confirmed(rows, given.distinct(), ["media_id", "seg_idx"])
    return confirmed.withColumn("caption", F.coalesce("caption", F.lit("")))


@query(
    f"SELECT media_id, seg_idx, CASE WHEN seg_idx % 5 = 0 THEN 'said' WHEN seg_idx % 2 = 0 AND text <> '' THEN text ELSE 'heard' END AS transcript FROM {_SEGMENTS}"
)
def transcript_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).withColumns({"keep": F.col("seg_idx") % 2 == 0, "heard": F.lit("heard"), "said": F.expr("if(seg_idx % 5 = 0, 'said', '')")})
    return transcript.clip_transcripts(rows, "keep", "text", "heard", "said").select("media_id", "seg_idx", "transcript")


# ---------------------------------------------------------------- clips

_CLIP_ROWS = f"(SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, text) AS clip_no FROM (SELECT * FROM {_SEGMENTS} WHERE start_s IS NOT NULL AND end_s IS NOT NULL))"
_OUTPUT = "'out/' || media_id || '/clip_' || clip_no || '.mp4'"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _segments(spark, sf_dir).filter("start_s is not null and end_s is not null")
    numbered = clips.number_clips(timed, "media_id", ["seg_idx", "text"])
    return numbered.withColumns({"source": F.concat(F.lit("in/"), "media_id", F.lit(".webm")), "folder": F.concat(F.lit("out/"), "media_id")})


_DRAWN = "CASE WHEN text <> '' THEN '-vf drawtext=text=''' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(39), chr(39) || chr(92) || chr(39) || chr(39)), ':', chr(92) || ':') || ''':x=10:y=10:fontsize=24:fontcolor=yellow ' ELSE '' END"


@query(
    f"SELECT media_id, clip_no, {_OUTPUT} AS output, 'ffmpeg -i in/' || media_id || '.webm -ss ' || CAST(start_s AS VARCHAR) || ' -to ' || CAST(end_s AS VARCHAR) || "
    f"' -c:v libvpx -c:a libvorbis -strict experimental ' || {_DRAWN} || {_OUTPUT} AS command FROM {_CLIP_ROWS}"
)
def clip_ffmpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.ffmpeg_plan(_clips(spark, sf_dir)).select("media_id", "clip_no", "output", F.array_join("argv", " ").alias("command"))


@query(
    f"SELECT media_id, clip_no, 'gst-launch-1.0 filesrc location=in/' || media_id || '.webm ! decodebin ! x264enc ! mp4mux ! filesink location=' || {_OUTPUT} AS command FROM {_CLIP_ROWS}"
)
def clip_gstreamer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.gstreamer_plan(_clips(spark, sf_dir)).select("media_id", "clip_no", F.array_join("argv", " ").alias("command"))


@query(
    f"SELECT media_id, clip_no, 'out/' || media_id || '/clip_' || (clip_no % 3) || '.mp4' AS output, row_number() OVER (PARTITION BY media_id, clip_no % 3 ORDER BY clip_no DESC) = 1 AS written FROM {_CLIP_ROWS}"
)
def clip_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _clips(spark, sf_dir).withColumn("name", F.concat(F.lit("clip_"), F.col("clip_no") % 3))
    return clips.named_clips(named, "name", "clip_no").select("media_id", "clip_no", "output", "written")


@query(f"SELECT media_id, string_agg({_OUTPUT}, ' ' ORDER BY clip_no) AS parts FROM {_CLIP_ROWS} GROUP BY media_id")
def clip_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = clips.ffmpeg_plan(_clips(spark, sf_dir))
    return clips.stitch_plan(plan, "media_id", "clip_no").select("media_id", F.array_join("parts", " ").alias("parts"))


@query(
    "SELECT media_id, clip_no, 'ffmpeg -i in/' || media_id || '.webm -ss ' || CAST(start_s AS VARCHAR) || CASE WHEN clip_no % 2 = 0 THEN ' -to ' || CAST(end_s AS VARCHAR) ELSE '' END || "
    f"' -vn in/' || media_id || '.wav' AS command FROM {_CLIP_ROWS}"
)
def clip_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _clips(spark, sf_dir).withColumn("end_s", F.when(F.col("clip_no") % 2 == 0, F.col("end_s")))
    return clips.audio_plan(some).select("media_id", "clip_no", F.array_join("argv", " ").alias("command"))


@query(f"SELECT info_id, regexp_replace(filename, '\\.[^./]*$', '') || '_wm.mp4' AS target FROM {_FILES}")
def clip_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("info_id", clips.watermark_target(F.col("filename")).alias("target"))


@query(
    f"SELECT media_id, clip_no, CASE WHEN clip_no % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM {_CLIP_ROWS}"
)
def clip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).select("media_id", "clip_no", F.concat_ws("/", "media_id", "clip_no").alias("name"), F.lit("old").alias("origin"))
    fresh = rows.filter("clip_no % 4 = 0").withColumn("origin", F.lit("new"))
    return clips.merge_clip_lists(rows, fresh).drop("name")


@query(
    "SELECT media_id, '{' || string_agg('\"clip_' || clip_no || '\":[{\"start\":' || CAST(start_s AS VARCHAR) || ',\"text\":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',\"end\":' || CAST(end_s AS VARCHAR) || '}]', ',' ORDER BY clip_no) || '}' AS clips "
    f"FROM {_CLIP_ROWS} GROUP BY media_id"
)
def clip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _segments(spark, sf_dir).filter("start_s is not null and end_s is not null")
    return clips.clip_lists(timed, "media_id", ["seg_idx", "text"])


_SAID = "CASE WHEN clip_no % 3 = 0 THEN 'said' WHEN clip_no % 3 = 1 THEN '' END"


@query(
    "SELECT media_id, clip_no, 'out/' || media_id || '/clips/c' || clip_no || '.mp4' AS output, "
    "'ffmpeg -i in/' || media_id || '.webm -ss ' || CAST(start_s AS VARCHAR) || ' -to ' || CAST(end_s AS VARCHAR) || ' -vn out/' || media_id || '/clips/c' || clip_no || '.wav' AS audio_command, "
    "'ffmpeg -i in/' || media_id || '.webm -ss ' || CAST(start_s AS VARCHAR) || ' -to ' || CAST(end_s AS VARCHAR) || ' -c:v libx264 -c:a aac out/' || media_id || '/clips/c' || clip_no || '.mp4' AS command, "
    f"CASE WHEN clip_no % 3 = 0 THEN 'said' ELSE text END AS text, coalesce({_SAID}, '') AS paragraph FROM {_CLIP_ROWS}"
)
def clip_captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _clips(spark, sf_dir).withColumns({"name": F.concat(F.lit("c"), "clip_no"), "said": F.expr(_SAID)})
    plan = clips.captioned_plan(named, "said")
    return plan.select("media_id", "clip_no", "output", F.array_join("audio_argv", " ").alias("audio_command"), F.array_join("argv", " ").alias("command"), "text", "paragraph")


# ---------------------------------------------------------------- notes

# Note names from C upwards, and the lengths, as the operators must have them.
_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
_BEATS = (("whole", 4.0), ("half", 2.0), ("quarter", 1.0), ("eighth", 0.5), ("sixteenth", 0.25))
_PITCH = "CASE event_id % 15 " + " ".join(f"WHEN {i} THEN '{n}' || (event_id % 8)" for i, n in enumerate(_NAMES)) + " WHEN 12 THEN 'rest' WHEN 13 THEN 'Bb3' END"
_LENGTH = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_BEATS)) + " WHEN 5 THEN 'odd' END"
_NOTES = f"(SELECT event_id, user_id AS song, {_PITCH} AS pitch, {_LENGTH} AS duration, 60 + event_id % 3 * 30 AS tempo_bpm FROM events)"
_HZ = (
    "CASE WHEN pitch = 'rest' THEN 0.0 ELSE 440.0 * power(2.0, (CASE regexp_extract(pitch, '^([A-G]#?)[0-9]$', 1) "
    + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_NAMES))
    + " END + (TRY_CAST(regexp_extract(pitch, '^[A-G]#?([0-9])$', 1) AS INT) + 1) * 12 - 69) / 12.0) END"
)
_BEAT = "CASE coalesce(duration, 'quarter') " + " ".join(f"WHEN '{n}' THEN {b}" for n, b in _BEATS) + " ELSE 1.0 END"
_RATE = 44100
_N = f"CAST(trunc({_RATE} * 60.0 / tempo_bpm * {_BEAT}) AS BIGINT)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr("event_id as pos", "user_id as song", f"{_PITCH} as pitch", f"{_LENGTH} as duration", "cast(60 + event_id % 3 * 30 as int) as tempo_bpm")


@query(f"SELECT event_id AS pos, round({_HZ}, 6) AS hz FROM {_NOTES}")
def note_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("pos", F.round(notes.frequency(F.col("pitch")), 6).alias("hz"))


@query(f"SELECT event_id AS pos, CAST({_BEAT} AS DOUBLE) AS beats, {_N} AS n_samples FROM {_NOTES}")
def note_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("pos", notes.beats(F.col("duration")).alias("beats"), notes.sample_count(F.col("duration"), F.col("tempo_bpm"), _RATE).alias("n_samples"))


_SAMPLES = (
    f"(SELECT song, pos, i, CAST(trunc(16383 * sin(2.0 * pi() * hz * i / {_RATE})) AS INT) AS sample FROM (SELECT song, event_id AS pos, CAST(coalesce({_HZ}, 0) AS DOUBLE) AS hz, unnest(range(0, {_N})) AS i FROM {_NOTES}))"
)


@query(f"SELECT song, pos, count(*) AS n, max(abs(sample)) AS peak FROM {_SAMPLES} GROUP BY song, pos")
def note_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_pieces(_notes(spark, sf_dir), _RATE).select("song", "pos", "n", "peak")


@query(
    f"SELECT song, count(*) AS n, max(abs(CAST(trunc(sample * 32767 / greatest(peak, 1)) AS INT))) AS peak FROM (SELECT *, max(abs(sample)) OVER (PARTITION BY song) AS peak FROM {_SAMPLES}) GROUP BY song"
)
def note_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.normalised_pieces(_notes(spark, sf_dir), _RATE).groupBy("song").agg(F.sum("n").alias("n"), F.max("peak").alias("peak"))


@query(f"SELECT song, CAST(44 + 2 * sum({_N}) AS BIGINT) AS n_bytes FROM {_NOTES} GROUP BY song")
def note_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files of all songs: their sizes."""
    return notes.wave_pieces(_notes(spark, sf_dir), _RATE).groupBy("song").agg(F.sum(F.length("piece")).alias("n_bytes"))


@query("SELECT event_id AS song, 0 AS pos, 'A4' AS pitch, CAST(NULL AS VARCHAR) AS duration, 100 + event_id % 2 AS tempo_bpm FROM events UNION ALL SELECT event_id, 1, 'rest', 'half', 100 + event_id % 2 FROM events")
def note_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'{\"tempo_bpm\":' || (100 + event_id % 2) || ',\"notes\":[{\"pitch\":\"A4\"},{\"pitch\":\"rest\",\"duration\":\"half\"}]}'"
    songs = read_table(spark, sf_dir, "events").selectExpr("event_id", f"{body} as body")
    return notes.notes_from_json(songs, "body", "event_id")


# ---------------------------------------------------------------- streams as tables


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.event_counts(read_table(spark, sf_dir, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM "
    "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s"
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.sessions(read_table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
