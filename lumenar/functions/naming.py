"""Metadata selection, file names, time values and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenar.functions.text import strip
from lumenar.session import cut_lineage

# Kept metadata fields and the source keys they are read from, in order.
METADATA_FIELDS = {
    "video_title": ("title",), "video_date": ("upload_date",), "uploader": ("uploader", "uploader_id"), "file_path": ("file_path",),
    "duration": ("duration",), "width": ("width",), "height": ("height",), "ext": ("ext",), "resolution": ("resolution",), "fps": ("fps",),
    "channels": ("channels",), "filesize": ("filesize",), "tbr": ("tbr",), "protocol": ("protocol",), "vcodec": ("vcodec",), "vbr": ("vbr",),
    "acodec": ("acodec",), "abr": ("abr",), "asr": ("asr",),
}

# Video and audio codec by extension, and the default.
CODECS = {".webm": ("libvpx", "libvorbis"), ".mp4": ("libx264", "aac"), ".ogv": ("libtheora", "libvorbis"), ".mkv": ("libx264", "aac")}
DEFAULT_CODECS = ("libx264", "aac")


def masked_metadata(df: DataFrame, json_col: str) -> DataFrame:
    """Add the whitelisted fields of a JSON object as text columns.

    The first *present* key counts even if its value is null. Text that isn't a JSON object gives
    nulls. Fields that exist already in ``df`` raise ValueError.
    """
    clash = set(METADATA_FIELDS) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    doc, keys = "__lumenar_doc", "__lumenar_keys"
    work = df.withColumn(doc, F.try_parse_json(F.col(json_col))).withColumn(keys, F.json_object_keys(F.when(F.col(doc).isNotNull(), F.col(json_col))))
    added = {}
    for name, sources in METADATA_FIELDS.items():
        out = F.lit(None).cast("string")
        for key in reversed(sources):
            out = F.when(F.array_contains(keys, key), F.get_json_object(F.col(json_col), f"$.{key}")).otherwise(out)
        added[name] = F.translate(out, " ", "_") if name == "video_title" else out
    return work.select(*[F.col(c) for c in df.columns], *[v.alias(k) for k, v in added.items()])


def original_filename(uploader: Column, date: Column, ext: Column) -> Column:
    """``uploader_date.ext`` with defaults for what is missing; blanks and slashes of the uploader become ``_``."""
    who = F.coalesce(F.nullif(strip(uploader), F.lit("")), F.lit("unknown_uploader"))
    when = F.coalesce(F.nullif(strip(date), F.lit("")), F.lit("unknown_date"))
    return F.concat(F.translate(who, " /", "__"), F.lit("_"), when, F.lit("."), F.coalesce(ext, F.lit("mp4")))


def _numbered(name: Column, number: Column) -> Column:
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    return F.when(number == 0, name).otherwise(F.concat(stem, F.lit("_"), number, ext))


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name", existing: DataFrame | None = None) -> DataFrame:
    """Add ``out``: ``name`` for the first row that asks for it, then ``stem_1.ext``, ``stem_2.ext``, ….

    A numbered name that another row asks for literally, or that is in ``existing`` (a column of the
    same name), is skipped: names never collide. A null name stays null. Rows are spread by ranges of name and
    order, written once, and numbered within their range; ranges then add up, so a name asked for by a third of
    all rows is numbered by many tasks. Rows of one name and equal order are numbered in any order.
    """
    place, taken, limit = "__lumenar_place", "__lumenar_taken", "__lumenar_n"
    held, part = "__lumenar_held", "__lumenar_part"
    given = df.withColumn(held, F.lit(False))
    if existing is not None:
        given = given.unionByName(existing.select(name).distinct().withColumn(held, F.lit(True)), allowMissingColumns=True)
    ranged = cut_lineage(given.repartitionByRange(F.col(name), F.desc(held), *[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(name, part).agg(F.count("*").alias(limit))
    before = F.coalesce(F.sum(limit).over(Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(name).alias("__lumenar_of"), F.col(part).alias("__lumenar_in"), before.alias("__lumenar_before"))
    local = ranged.withColumn(place, F.row_number().over(Window.partitionBy(name, part).orderBy(F.desc(held), *order)) - 1)
    placed = local.join(starts, F.col(name).eqNullSafe(F.col("__lumenar_of")) & (F.col(part) == F.col("__lumenar_in")))
    ranked = placed.withColumn(place, F.col(place) + F.col("__lumenar_before")).filter(~F.col(held))
    counts = sizes.groupBy(name).agg(F.sum(limit).alias(limit))
    stem = F.regexp_extract(name, r"^(.*)_(\d+)(\.[^./]*)?$", 1)
    literal = (
        counts.filter(F.col(name).rlike(r"_[1-9]\d{0,8}(\.[^./]*)?$"))
        .select(F.concat(stem, F.regexp_extract(name, r"^(.*)_(\d+)(\.[^./]*)?$", 3)).alias(name), F.regexp_extract(name, r"^(.*)_(\d+)(\.[^./]*)?$", 2).cast("int").alias("k"))
        .groupBy(name)
        .agg(F.sort_array(F.collect_set("k")).alias(taken))
    )
    shifted = F.when(F.col(place) == 0, 0).otherwise(F.aggregate(F.coalesce(taken, F.array().cast("array<int>")), F.col(place), lambda acc, k: F.when(k <= acc, acc + 1).otherwise(acc)))
    joined = ranked.join(literal, name, "left").withColumn(out, _numbered(F.col(name), shifted))
    return joined.select(*df.columns, out)


def codec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CODECS.items()], "ext string, video_codec string, audio_codec string")


def with_codecs(df: DataFrame, ext: str) -> DataFrame:
    """Add ``video_codec`` and ``audio_codec`` by the extension (with its dot, case-sensitive)."""
    pick = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in CODECS.items() for x in (k, v[i])])[F.col(ext)], F.lit(DEFAULT_CODECS[i]))
    return df.withColumns({"video_codec": pick(0), "audio_codec": pick(1)})


def seconds_of(value: Column, strict: bool = False) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``; other text gives null, or an error where ``strict``."""
    part = lambda i: F.split(value, ":")[i].cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not a time: "), value)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return (
        F.when(value.rlike(r"^\d{1,12}$"), part(0))
        .when(value.rlike(r"^\d{1,9}:\d{1,9}:\d{1,9}$"), part(0) * 3600 + part(1) * 60 + part(2))
        .when(value.rlike(r"^\d{1,9}:\d{1,9}$"), part(0) * 60 + part(1))
        .when(value.isNotNull(), bad)
    )


def required_fields_ok(url: Column, title: Column, date: Column, flags: list[Column]) -> Column:
    """All fields present, the address http(s), every flag a boolean; never null."""
    ok = url.rlike(r"^https?://") & title.isNotNull() & date.isNotNull()
    for flag in flags:
        ok = ok & flag.isNotNull()
    return F.coalesce(ok, F.lit(False))


def overlay(base: dict, platform: str) -> dict:
    """Settings with those of the platform laid over them, one level deep."""
    out = {k: v for k, v in base.items()}
    extra = base.get(platform)
    return out | extra if isinstance(extra, dict) else out


def overlay_maps(base: Column, over: Column) -> Column:
    """``base`` with the entries of ``over`` in place of its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def output_directory(base: Column, stem: Column, at: Column, sub: Column | None = None) -> Column:
    """``base/stem_YYYYMMDD_HHMMSS`` and, with ``sub``, ``/sub_HHMMSS`` below."""
    top = F.concat(base, F.lit("/"), stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    return top if sub is None else F.concat(top, F.lit("/"), sub, F.lit("_"), F.date_format(at, "HHmmss"))
