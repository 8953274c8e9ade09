"""Time series of transcripts: chunk grids, stitching, alignment of sentences to segments, subtitles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions.text import clock, first_filled, strip
from lumenar.sources.connectors import Connector, apply_connector

CHUNK_SECONDS = 60
UNINTELLIGIBLE = "[Unintelligible]"
NO_TRANSCRIPT = "[ERROR: No transcript]"


def chunk_grid(df: DataFrame, duration: str, step: int = CHUNK_SECONDS) -> DataFrame:
    """One row per started step of the whole seconds of ``duration``: ``chunk_start, chunk_end``.

    A fraction of a second at the end is dropped; zero, negative and null durations give no rows.
    """
    whole = F.col(duration).cast("bigint")
    begins = F.when(whole > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(whole - 1, F.lit(0)), F.lit(step).cast("bigint")))
    return df.withColumn("chunk_start", F.explode(begins)).withColumn("chunk_end", F.least(F.col("chunk_start") + step, whole))


def chunk_label(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit("-"), end, F.lit("s"))


def minute_of(start: Column, step: int = CHUNK_SECONDS) -> Column:
    """Start of the step a second falls into."""
    return (F.floor(start / step) * step).cast("bigint")


def segment_text(segments: DataFrame, media: str = "media_id", order: str = "seg_idx", text: str = "text") -> DataFrame:
    """``media, full_text``: stripped texts of a medium in order, joined by a blank; null and empty texts are left out.

    Texts are first joined in runs of neighbours, so that what meets in one task for a medium is
    few long strings; a medium's transcript is one value and must fit in memory.
    """
    clean = segments.select(media, F.col(order).alias("o"), strip(F.col(text)).alias("t")).filter("t <> ''")
    runs = clean.groupBy(media, F.floor(F.col("o") / 256).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x.t), " ").alias("t"))
    return runs.groupBy(media).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "t"))), lambda x: x.t), " ").alias("full_text"))


def minute_transcript(segments: DataFrame, media: str = "media_id", order: str = "seg_idx", start: str = "start_s", text: str = "text", step: int = CHUNK_SECONDS) -> DataFrame:
    """``media, chunk_start, chunk_text``: a medium's texts by the step they start in; segments without a start are left out."""
    clean = segments.filter(F.col(start).isNotNull()).select(media, minute_of(F.col(start), step).alias("chunk_start"), F.col(order).alias("o"), strip(F.col(text)).alias("t")).filter("t <> ''")
    return clean.groupBy(media, "chunk_start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x.t), " ").alias("chunk_text"))


def stitched(chunks: DataFrame, media: str = "media_id", start: str = "chunk_start", end: str = "chunk_end", text: str = "chunk_text") -> DataFrame:
    """``media, transcript``: ``[s-e sec]``, the text and an empty line per chunk, in order of time."""
    block = F.concat(F.lit("["), F.col(start), F.lit("-"), F.col(end), F.lit(" sec]\n"), F.coalesce(F.col(text), F.lit(NO_TRANSCRIPT)), F.lit("\n"))
    return chunks.select(media, F.col(start).alias("s"), block.alias("b")).groupBy(media).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "b"))), lambda x: x.b), "\n").alias("transcript"))


def reuse_transcripts(chunks: DataFrame, cache: DataFrame, keys: list[str], recognise: Column, text: str = "chunk_text") -> DataFrame:
    """Chunks with the cached text, or what ``recognise`` gives where there is none; failures are marked.

    ``cache`` has ``keys`` and ``text``. ``status`` is CACHED, DONE, UNINTELLIGIBLE (an empty result)
    or FAILED (null).
    """
    held = cache.select(*keys, F.col(text).alias("__lumenar_held")).dropDuplicates(keys)
    joined = chunks.join(held, keys, "left").withColumn("__lumenar_new", F.when(F.col("__lumenar_held").isNull(), recognise))
    new = F.col("__lumenar_new")
    status = F.when(F.col("__lumenar_held").isNotNull(), "CACHED").when(new.isNull(), "FAILED").when(new == "", "UNINTELLIGIBLE").otherwise("DONE")
    value = F.when(status == "UNINTELLIGIBLE", UNINTELLIGIBLE).otherwise(F.coalesce("__lumenar_held", new, F.lit(NO_TRANSCRIPT)))
    return joined.select(*chunks.columns, value.alias(text), status.alias("status"))


def recognised_chunks(media: DataFrame, path: str, duration: str, make: Callable[[], Connector], cache: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """Each medium's chunks with what a recogniser makes of them: ``chunk_start, chunk_end, chunk_text, status``.

    The recogniser is called with ``path#start-end``, up to ``attempts`` times, and only for chunks
    that ``cache`` (``path, chunk_start, chunk_text``) doesn't hold.
    """
    chunks = chunk_grid(media, duration)
    keys = [path, "chunk_start"]
    missing = chunks if cache is None else chunks.join(cache.select(*keys), keys, "left_anti")
    given = F.concat(F.col(path), F.lit("#"), F.col("chunk_start"), F.lit("-"), F.col("chunk_end"))
    called = apply_connector(missing.withColumn("__lumenar_given", given), "__lumenar_given", "__lumenar_new", make, attempts)
    new = F.col("__lumenar_new")
    text = F.when(new == "", UNINTELLIGIBLE).otherwise(F.coalesce(new, F.lit(NO_TRANSCRIPT)))
    status = F.when(new.isNull(), "FAILED").when(new == "", "UNINTELLIGIBLE").otherwise("DONE")
    made = called.select(*chunks.columns, text.alias("chunk_text"), status.alias("status"))
    if cache is None:
        return made
    held = chunks.join(cache.select(*keys, "chunk_text").dropDuplicates(keys), keys).select(*chunks.columns, "chunk_text", F.lit("CACHED").alias("status"))
    return made.unionByName(held)


def align_to_segments(sentences: list[str], segments: list[tuple[float | None, float | None, str]]) -> list[tuple[str, float | None, float | None]]:
    """Each sentence with the first start that is not null, and the last end, of the segments it uses up.

    One cursor runs through the segments; a sentence takes whole segments, empty ones too, until
    their stripped texts, a blank after each, are as long as itself. Times are rounded to hundredths;
    a time of 0 or none is null, as for sentences left over when the segments are used up.
    """
    at, out = 0, []
    clean = lambda x: round(x, 2) if x else None
    for sentence in sentences:
        first, have = at, 0
        while at < len(segments) and have < len(sentence):
            have += len(segments[at][2].strip()) + 1
            at += 1
        used = segments[first:at]
        out.append((sentence, clean(next((s for s, *_ in used if s is not None), None)), clean(used[-1][1]) if used else None))
    return out


def timed_sentences(segments: DataFrame, media: str = "media_id", order: str = "seg_idx", start: str = "start_s", end: str = "end_s", text: str = "text") -> DataFrame:
    """``media, sent_idx, sentence, start_s, end_s`` of a medium's joined text.

    The cursor depends on all earlier sentences, so one medium is one row: its segments, with null
    texts left out and repeated rows once. Empty segments are used up like others.
    """
    clean = segments.select(media, F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), strip(F.col(text)).alias("t")).filter("t is not null")
    one = clean.groupBy(media, "o").agg(F.min(F.struct("s", "e", "t")).alias("x"))
    grouped = one.groupBy(media).agg(F.sort_array(F.collect_list(F.struct("o", "x"))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        cut = re.compile(r"(?<=[.!?])\s+")
        for batch in batches:
            rows: list[tuple] = []
            for mid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(p["x"]["s"], p["x"]["e"], p["x"]["t"]) for p in parts]
                pieces = [s for s in (p.strip() for p in cut.split(" ".join(t for *_, t in found))) if s]
                rows += [(mid, i, *x) for i, x in enumerate(align_to_segments(pieces, found))]
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[media, "sent_idx", "sentence", "start_s", "end_s"])

    kind = segments.schema[media].dataType.simpleString()
    return grouped.mapInArrow(run, f"`{media}` {kind}, sent_idx int, sentence string, start_s double, end_s double")


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    """A numbered cue with an empty line after it; ``number`` starts at 1."""
    return F.concat(number, F.lit("\n"), clock(start, ","), F.lit(" --> "), clock(end, ","), F.lit("\n"), strip(text), F.lit("\n\n"))


def vtt_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(clock(start, "."), F.lit(" --> "), clock(end, "."), F.lit("\n"), strip(text), F.lit("\n\n"))


def subtitles(segments: DataFrame, form: str = "srt", media: str = "media_id", order: str = "seg_idx", start: str = "start_s", end: str = "end_s", text: str = "text") -> DataFrame:
    """``media, subtitles``: the whole SRT or VTT file of each medium; segments without times or text are left out."""
    rows = segments.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(text).isNotNull()).dropDuplicates([media, order])
    packed = rows.groupBy(media).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("t")))).alias("x"))
    if form == "srt":
        cues = F.transform("x", lambda x, i: srt_cue(i + 1, x.s, x.e, x.t))
        return packed.select(media, F.array_join(cues, "").alias("subtitles"))
    cues = F.transform("x", lambda x: vtt_cue(x.s, x.e, x.t))
    return packed.select(media, F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "")).alias("subtitles"))


def caption_text(recognised: Column, clip_text: Column) -> Column:
    """What was recognised, else the clip's own text (even an empty one), else a note."""
    return F.coalesce(F.nullif(recognised, F.lit("")), clip_text, F.lit("(No transcription)"))


def confirmed(captions: DataFrame, overrides: DataFrame, keys: list[str], text: str = "caption") -> DataFrame:
    """Captions with the non-empty override of the same keys in their place; ``overrides`` has ``keys`` and ``text``."""
    given = overrides.groupBy(*keys).agg(F.max(text).alias("__lumenar_given"))
    joined = captions.join(given, keys, "left")
    return joined.withColumn(text, first_filled(F.col("__lumenar_given"), F.col(text))).select(*captions.columns)


def clip_transcripts(clips: DataFrame, keep: str, text: str, recognised: str, override: str) -> DataFrame:
    """Add ``transcript``: the kept text, else what was recognised, each overridden by a non-empty override."""
    kept = F.when(F.col(keep) & (F.col(text) != ""), F.col(text)).otherwise(F.coalesce(recognised, F.lit("")))
    return clips.withColumn("transcript", first_filled(F.col(override), kept))


def compare_texts(left: Column, right: Column) -> Column:
    """Ratio of matching stretches of two texts, 0 to 1, by the longest common blocks; order matters.

    Null if a text is null. The cost grows with the product of the lengths.
    """

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return run(left, right)


def pairwise_similarity(texts: DataFrame, key: str, text: str, block: str) -> DataFrame:
    """``key_a, key_b, ratio`` of every two texts of one block, key_a < key_b.

    The block is what keeps this from all pairs of a table: it must be a key of few rows, as the
    sources of one item.
    """
    a = texts.select(block, F.col(key).alias("key_a"), F.col(text).alias("__lumenar_a"))
    b = texts.select(block, F.col(key).alias("key_b"), F.col(text).alias("__lumenar_b"))
    pairs = a.join(b, block).filter("key_a < key_b")
    return pairs.select(block, "key_a", "key_b", compare_texts(F.col("__lumenar_a"), F.col("__lumenar_b")).alias("ratio"))


def unpivot_languages(df: DataFrame, content: str, languages: list[str], keys: list[str]) -> DataFrame:
    """``keys, lang, text`` for each text a record has in a language."""
    pairs = ", ".join(f"'{lang}', {content}.{lang}" for lang in languages)
    return df.selectExpr(*keys, f"stack({len(languages)}, {pairs}) as (lang, text)").filter("text is not null")
