"""Clip plans as data: argument lists for an external encoder, run by a connector and not by the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions.naming import with_codecs


def escaped_drawtext(text: Column) -> Column:
    """A text safe inside the quoted value of a drawtext filter."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("'\\''")), F.lit(":"), F.lit("\\:"))


def number_clips(clips: DataFrame, media: str, order: list[str]) -> DataFrame:
    """Add ``clip_no`` from 1 in order within each medium."""
    from pyspark.sql import Window

    return clips.withColumn("clip_no", F.row_number().over(Window.partitionBy(media).orderBy(*order)))


def clip_lists(clips: DataFrame, media: str, order: list[str]) -> DataFrame:
    """``media, clips``: JSON text of each medium's clips by name ``clip_1``, ``clip_2``, …, each a list of one clip.

    Names run in order within a medium; a missing end is left out, a missing text is ''. A clip document is one value.
    """
    entry = F.array(F.struct(F.col("start_s").alias("start"), F.coalesce("text", F.lit("")).alias("text"), F.col("end_s").alias("end")))
    named = number_clips(clips, media, order).select(media, "clip_no", F.concat(F.lit("clip_"), "clip_no").alias("name"), entry.alias("entry"))
    ordered = F.sort_array(F.collect_list(F.struct("clip_no", "name", "entry")))
    return named.groupBy(media).agg(F.to_json(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["name"], x.entry)))).alias("clips"))


def captioned_plan(clips: DataFrame, recognised: str, name: str = "name", source: str = "source", folder: str = "folder") -> DataFrame:
    """Add ``output, audio_argv, argv, text, paragraph`` to clips by name that get what was said in them as captions.

    The audio is cut out for a recogniser; a non-empty ``recognised`` replaces the clip's text; the clip is
    encoded as it is, and ``paragraph`` (what was recognised, '' for none) goes to the captioning.
    """
    output = F.concat(F.col(folder), F.lit("/clips/"), F.col(name), F.lit(".mp4"))
    cut = F.array(F.lit("ffmpeg"), F.lit("-i"), F.col(source), F.lit("-ss"), F.col("start_s").cast("string"), F.lit("-to"), F.col("end_s").cast("string"))
    wav = F.concat(F.col(folder), F.lit("/clips/"), F.col(name), F.lit(".wav"))
    said = F.coalesce(recognised, F.lit(""))
    return clips.withColumns({
        "output": output, "audio_argv": F.concat(cut, F.array(F.lit("-vn"), wav)), "argv": F.concat(cut, F.array(F.lit("-c:v"), F.lit("libx264"), F.lit("-c:a"), F.lit("aac"), output)),
        "text": F.when(said != "", said).otherwise(F.col("text")), "paragraph": said,
    })


def _extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def ffmpeg_plan(clips: DataFrame, source: str = "source", folder: str = "folder") -> DataFrame:
    """Add ``output`` and ``argv`` to clips with ``clip_no, start_s, end_s, text``.

    Codecs follow the source's extension; a drawtext filter is added where there is a text.
    """
    ext = "__lumenar_ext"
    work = with_codecs(clips.withColumn(ext, _extension(F.col(source))), ext)
    output = F.concat(F.col(folder), F.lit("/clip_"), F.col("clip_no"), F.lit(".mp4"))
    lit = F.lit
    head = F.array(
        lit("ffmpeg"), lit("-i"), F.col(source), lit("-ss"), F.col("start_s").cast("string"), lit("-to"), F.col("end_s").cast("string"),
        lit("-c:v"), F.col("video_codec"), lit("-c:a"), F.col("audio_codec"), lit("-strict"), lit("experimental"),
    )
    # fixed values: place, size and colour of the text
    drawn = F.concat(lit("drawtext=text='"), escaped_drawtext(F.col("text")), lit("':x=10:y=10:fontsize=24:fontcolor=yellow"))
    middle = F.when(F.coalesce(F.col("text") != "", lit(False)), F.array(lit("-vf"), drawn)).otherwise(F.array().cast("array<string>"))
    return work.select(*clips.columns, output.alias("output"), F.concat(head, middle, F.array(output)).alias("argv"))


def gstreamer_plan(clips: DataFrame, source: str = "source", folder: str = "folder") -> DataFrame:
    """Add ``output`` and ``argv`` of a pipeline that re-encodes the whole source: it does not trim."""
    output = F.concat(F.col(folder), F.lit("/clip_"), F.col("clip_no"), F.lit(".mp4"))
    lit = F.lit
    argv = F.array(
        lit("gst-launch-1.0"), lit("filesrc"), F.concat(lit("location="), F.col(source)), lit("!"), lit("decodebin"), lit("!"), lit("x264enc"),
        lit("!"), lit("mp4mux"), lit("!"), lit("filesink"), F.concat(lit("location="), output),
    )
    return clips.select("*", output.alias("output"), argv.alias("argv"))


def named_clips(clips: DataFrame, name: str = "name", order: str = "pos", folder: str = "folder") -> DataFrame:
    """Plan for clips by name: of several entries under one name the last writes the file."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy(folder, name).orderBy(F.desc(order)))
    return clips.withColumn("output", F.concat(F.col(folder), F.lit("/"), F.col(name), F.lit(".mp4"))).withColumn("written", last == 1)


def stitch_plan(clips: DataFrame, media: str, order: str, output: str = "output") -> DataFrame:
    """``media, parts``: a medium's clip files in order."""
    return clips.groupBy(media).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(output).alias("f")))), lambda x: x.f).alias("parts"))


def watermark_target(path: Column) -> Column:
    """``stem_wm.mp4`` beside the file; null for a missing path."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_wm.mp4"))


def audio_plan(clips: DataFrame, source: str = "source") -> DataFrame:
    """Add ``argv`` that cuts the audio out; without an end it runs to the end of the source."""
    stem = F.regexp_replace(F.col(source), r"\.[^./]*$", "")
    to = F.when(F.col("end_s").isNotNull(), F.array(F.lit("-to"), F.col("end_s").cast("string"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("ffmpeg"), F.lit("-i"), F.col(source), F.lit("-ss"), F.col("start_s").cast("string"))
    return clips.withColumn("argv", F.concat(head, to, F.array(F.lit("-vn"), F.concat(stem, F.lit(".wav")))))


def merge_clip_lists(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Clip lists by name, the new list in place of an old one of the same name."""
    return old.join(new.select(name).distinct(), name, "left_anti").select(*old.columns).unionByName(new)
