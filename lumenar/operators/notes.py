"""Notes to sound: frequencies, lengths, samples, peak-normalised PCM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 44100
DEFAULT_TEMPO = 120
PEAK = 32767
LEVEL = 16383
# Semitone of each note name, and beats of each length.
SEMITONES = {"C": 0, "C#": 1, "D": 2, "D#": 3, "E": 4, "F": 5, "F#": 6, "G": 7, "G#": 8, "A": 9, "A#": 10, "B": 11}
BEATS = {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "sixteenth": 0.25}
#: Waves up to this many samples are kept in a worker, by frequency (there are 120 of them).
KEPT = 1 << 18
BATCH_BYTES = 8 << 20


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def frequency(note: Column) -> Column:
    """Hertz of a note as ``A4`` or ``C#5``; a rest is 0, any other text null (flats aren't known)."""
    semitone = F.try_element_at(_table(SEMITONES), F.regexp_extract(note, r"^([A-G]#?)\d$", 1))
    octave = F.regexp_extract(note, r"^[A-G]#?(\d)$", 1).try_cast("int")
    steps = semitone + (octave + 1) * 12 - 69
    return F.when(F.lower(note) == "rest", F.lit(0.0)).otherwise(F.lit(440.0) * F.pow(F.lit(2.0), steps / 12))


def beats(length: Column) -> Column:
    """Beats of a named length; a missing one is a quarter, an unknown one lasts one beat."""
    return F.coalesce(F.try_element_at(_table(BEATS), F.coalesce(length, F.lit("quarter"))), F.lit(1.0))


def sample_count(length: Column, tempo: Column, rate: int = RATE) -> Column:
    tempo = F.coalesce(tempo, F.lit(DEFAULT_TEMPO))
    return (F.lit(rate) * F.lit(60.0) / tempo * beats(length)).cast("bigint")


def _sized(notes: DataFrame, rate: int) -> DataFrame:
    sized = notes.select("song", "pos", F.coalesce(frequency(F.col("pitch")), F.lit(0.0)).alias("hz"), sample_count(F.col("duration"), F.col("tempo_bpm"), rate).alias("n"))
    return sized.filter("n > 0")


def note_samples(notes: DataFrame, rate: int = RATE) -> DataFrame:
    """``song, pos, i, sample`` of notes with ``song, pos, pitch, duration, tempo_bpm``; the phase starts anew with each note.

    Unknown pitches give silence of their length.
    """
    spread = _sized(notes, rate).select("song", "pos", "hz", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    wave = (F.lit(LEVEL) * F.sin(F.lit(2.0) * F.pi() * F.col("hz") * F.col("i") / F.lit(rate))).cast("int")
    return spread.select("song", "pos", "i", wave.alias("sample"))


def normalised(samples: DataFrame) -> DataFrame:
    """Samples scaled so that the song's peak is full scale; a silent song stays silent.

    The peak is a partial aggregate joined back, so a long song is not gathered in one task.
    """
    peak = samples.groupBy("song").agg(F.max(F.abs("sample")).alias("peak"))
    scaled = (F.col("sample") * F.lit(PEAK) / F.greatest("peak", F.lit(1))).cast("int")
    return samples.join(peak, "song").select("song", "pos", "i", scaled.cast("smallint").alias("sample"))


def _wave(hz: float, n: int, rate: int):
    import numpy as np

    return (LEVEL * np.sin(2.0 * np.pi * hz * np.arange(n) / rate)).astype("<i2")


@lru_cache(maxsize=128)
def _kept_wave(hz: float, rate: int):
    return _wave(hz, KEPT, rate)


def _piece_batches(rate: int, scale: bool, with_pcm: bool):
    """Batches of ``song, pos, hz, n[, peak]`` to pieces; a batch given on holds few bytes, however many notes came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            hz, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            top = batch.column(4).to_pylist() if scale else None
            start, size, peaks, pcm = 0, 0, [], []
            for k in range(batch.num_rows):
                samples = _kept_wave(hz[k], rate)[: n[k]] if n[k] <= KEPT else _wave(hz[k], n[k], rate)
                if scale:
                    samples = (samples.astype(np.int32) * PEAK / max(top[k], 1)).astype("<i2")
                peaks.append(int(max(samples.max(), -int(samples.min()))))
                if with_pcm:
                    pcm.append(samples.tobytes())
                    size += 2 * n[k]
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, k + 1 - start)
                    columns = [part.column(0), part.column(1), part.column(3), pa.array(peaks, pa.int32())]
                    names = ["song", "pos", "n", "peak"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(pcm, pa.binary())] * with_pcm, names=names + ["pcm"] * with_pcm)
                    start, size, peaks, pcm = k + 1, 0, [], []

    return run


def _pieces(sized: DataFrame, rate: int, scale: bool, with_pcm: bool) -> DataFrame:
    song, pos = (sized.schema[c].dataType.simpleString() for c in ("song", "pos"))
    kind = f"song {song}, pos {pos}, n bigint, peak int" + ", pcm binary" * with_pcm
    return sized.mapInArrow(_piece_batches(rate, scale, with_pcm), kind)


def note_pieces(notes: DataFrame, rate: int = RATE) -> DataFrame:
    """``song, pos, n, peak, pcm``: the samples of ``note_samples``, a note a row, as 16-bit PCM."""
    return _pieces(_sized(notes, rate), rate, scale=False, with_pcm=True)


def normalised_pieces(notes: DataFrame, rate: int = RATE) -> DataFrame:
    """The samples of ``normalised``, a note a row, as ``note_pieces`` gives them.

    Only the notes' peaks are grouped and joined, never their samples, so neither a long song
    nor a high rate makes a large group.
    """
    sized = _sized(notes, rate)
    peaks = _pieces(sized, rate, scale=False, with_pcm=False).groupBy(F.col("song").alias("of")).agg(F.max("peak").alias("top"))
    return _pieces(sized.join(peaks, F.col("song").eqNullSafe(F.col("of"))).drop("of"), rate, scale=True, with_pcm=True)


def _header(n: Column, rate: int) -> Column:
    """Head of a mono 16-bit WAV of ``n`` samples; sizes that don't fit 32 bits are all ones, as in streams."""

    def little(value: Column, size: int) -> Column:
        text = F.lpad(F.hex(F.least(value.cast("bigint"), F.lit(2 ** (8 * size) - 1))), 2 * size, "0")
        return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]))

    fixed = b"WAVEfmt " + b"".join(v.to_bytes(k, "little") for v, k in ((16, 4), (1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2))) + b"data"
    return F.concat(F.lit(b"RIFF"), little(n * 2 + 36, 4), F.lit(fixed), little(n * 2, 4))


def wave_pieces(notes: DataFrame, rate: int = RATE) -> DataFrame:
    """``song, pos, piece``: mono 16-bit WAV of each song in pieces, the head under no ``pos`` and then a piece a note.

    The pieces of a song in the order of ``pos``, nulls first, are its file; a song may be longer than one value can be.
    """
    pos = F.lit(None).cast(notes.schema["pos"].dataType)
    heads = _sized(notes, rate).groupBy("song").agg(_header(F.sum("n"), rate).alias("piece")).select("song", pos.alias("pos"), "piece")
    return heads.unionByName(normalised_pieces(notes, rate).select("song", "pos", F.col("pcm").alias("piece")))


def wave_files(samples: DataFrame, rate: int = RATE) -> DataFrame:
    """``song, wav``: mono 16-bit WAV of each song, of normalised samples.

    Samples are gathered by note, then notes by song. One value holds a whole file, so at most 2 GB; see ``wave_pieces``.
    """
    import pandas as pd

    def render(group: pd.DataFrame) -> pd.DataFrame:
        pcm = group.sort_values("i")["sample"].to_numpy("<i2").tobytes()
        return pd.DataFrame({"song": [group["song"].iloc[0]], "pos": [group["pos"].iloc[0]], "n": [len(group)], "pcm": [pcm]})

    song, pos = (samples.schema[c].dataType.simpleString() for c in ("song", "pos"))
    pieces = samples.groupBy("song", "pos").applyInPandas(render, f"song {song}, pos {pos}, n bigint, pcm binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "pcm"))), lambda x: x.pcm)
    joined = F.aggregate(ordered, F.unhex(F.lit("")), lambda whole, x: F.concat(whole, x))
    return pieces.groupBy("song").agg(F.concat(_header(F.sum("n"), rate), joined).alias("wav"))


def notes_from_json(df: DataFrame, json_col: str, song: str) -> DataFrame:
    """``song, pos, pitch, duration, tempo_bpm`` of note lists; missing notes are none, a missing tempo 120."""
    kind = "struct<tempo_bpm:int,notes:array<struct<pitch:string,duration:string>>>"
    parsed = df.select(F.col(song).alias("song"), F.from_json(json_col, kind).alias("x"))
    spread = parsed.select("song", F.coalesce("x.tempo_bpm", F.lit(DEFAULT_TEMPO)).alias("tempo_bpm"), F.posexplode("x.notes").alias("pos", "note"))
    return spread.select("song", "pos", "note.pitch", "note.duration", "tempo_bpm")

