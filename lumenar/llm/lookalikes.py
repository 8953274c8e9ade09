"""Text that looks the same, in one consistent form.

A transducer is compiled once from rules (widths, styled letters, composed accents, spaces,
invisible characters), a short table of look-alike letters, and the letters of all other scripts
that the public confusables data name for a single ASCII letter. Spark brings these data along in
its library for international text; the driver reads them once and sends them with the operator. The transducer reads grapheme clusters, the
longest match first, and writes each one's canonical form, so a text takes one pass; clusters that
are canonical already are skipped over by the compiled pattern. The mapping is checked for
conflicts: no output may itself be mapped to something else.

Kept apart, as a reader sees them: case, accents, digits, words, line breaks, the number of
ordinary blanks, punctuation of different shape, joined emoji. Defined results: null stays null, an
empty text stays empty, and the canonical form of a canonical form is itself.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin one, and that one; these go before the public data.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Latin letters of other alphabets, and Armenian
    "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    # hyphens
    "‐": "-", "‑": "-",
}
#: Compatibility decompositions that only change width, style or breaking.
_PLAIN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")
_JOINED = "[☀-➿\U0001f000-\U0001faff]️?‍(?=[☀-➿\U0001f000-\U0001faff])"
#: Flags of regions are drawn from tag characters, which are invisible elsewhere.
_FLAG = "\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f"


_DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def read_confusables(data: bytes) -> dict[str, str]:
    """Each character and what it may be taken for, from the library's binary form.

    After a head as long as its first two bytes say come numbers of 32 bits: a magic number, a version, the size, then
    place and count of the keys, of the values and of the text the longer values are parts of. A key is a code point
    with the length of its value less one in its highest byte; a value is a single unit or a place in the text.
    """
    order = ">" if data[8] else "<"
    body = data[struct.unpack(f"{order}H", data[:2])[0] :]
    magic, keys_at, n_keys, values_at, n_values, text_at, n_text = struct.unpack(f"{order}I8x6I", body[:36])
    if magic != 0x3845FDEF:
        raise ValueError("not a table of confusables")
    keys = struct.unpack_from(f"{order}{n_keys}I", body, keys_at)
    values = struct.unpack_from(f"{order}{n_values}H", body, values_at)
    text = body[text_at : text_at + 2 * n_text].decode("utf-16-be" if data[8] else "utf-16-le", "surrogatepass")
    return {chr(k & 0xFFFFFF): chr(v) if k >> 24 == 0 else text[v : v + (k >> 24) + 1] for k, v in zip(keys, values)}


@lru_cache(maxsize=1)
def look_alike_table() -> tuple[tuple[str, str], ...]:
    """Letters and the ASCII letter each looks like: ``LOOKALIKES``, then the public data where Spark's library is found.

    Of the data, letters (and single signs drawn as letters) outside Latin-1 count that are not written from right to left and not composed. They take I and l
    for one letter; capitals among them become I.
    """
    table = dict(LOOKALIKES)
    folders = [Path(pyspark.__file__).parent / "jars", *[Path(h) / "jars" for h in [os.environ.get("SPARK_HOME")] if h]]
    library = next((jar for folder in folders for jar in sorted(folder.glob("icu4j-*.jar"))), None)
    if library is not None:
        with zipfile.ZipFile(library) as archive:
            found = read_confusables(archive.read(_DATA))
        for char, other in found.items():
            kind = unicodedata.category(char)
            if other.isascii() and other.isalpha() and len(other) == 1 and char > "\xff" and (kind[0] == "L" or kind == "So"):
                if not unicodedata.decomposition(char) and unicodedata.bidirectional(char) not in ("R", "AL"):
                    table.setdefault(char, "I" if other == "l" and kind == "Lu" else other)
    return tuple(sorted(table.items()))


def _invisible(char: str) -> bool:
    return (unicodedata.category(char) == "Cf" and char not in "؀؁؂؃۝܏") or "︀" <= char <= "️" or char == "͏" or "\U000e0100" <= char <= "\U000e01ef"


class Transducer:
    """Pattern of clusters that may change, and the precomputed outputs; conflicts raise ValueError."""

    def __init__(self, table: tuple[tuple[str, str], ...]) -> None:
        self.table = dict(table)
        self.outputs: dict[str, str] = {}
        changed, following = [], []
        for code in chain(range(128, 0x20000), range(0xE0000, 0xE01F0)):
            char = chr(code)
            category = unicodedata.category(char)
            if category in ("Cn", "Cs", "Co") or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4:
                continue
            if category == "Mn" or _invisible(char):
                following.append(code)
                continue
            out = self.cluster(char)
            if out != char:
                changed.append(code)
                self.outputs[char] = out
        for char, out in self.outputs.items():
            if self.cluster(out) != out:
                raise ValueError(f"conflict: {char!r} gives {out!r}, which gives {self.cluster(out)!r}")
        marks = _ranges(following)
        self.pattern = re.compile(f"({_FLAG}|{_JOINED})|[\\s\\S][{marks}]+|[{marks}{_ranges(changed)}]")
        # a stretch in which clusters may change, but for the character before it that its first marks belong to
        self.strange = re.compile(f"[{_ranges([c for c in changed if c < 256] + [0xAD])}\u0100-\U0010ffff]+")
        self.stretches: dict[str, str] = {}

    def _plain(self, char: str) -> str:
        """One character's canonical form, accents aside."""
        if unicodedata.category(char) == "Zs":
            return " "
        if char in self.table:
            return self.table[char]
        tag, _, rest = unicodedata.decomposition(char).partition(" ")
        if tag in _PLAIN_TAGS:
            whole = unicodedata.normalize("NFKC", char)
            if len(whole) == 1 and unicodedata.category(char)[0] in "LNPS" or "ﬀ" <= char <= "ﬆ":
                return "".join(self.table.get(c, c) for c in whole)
        return char

    def cluster(self, cluster: str) -> str:
        """Canonical form of a base character with what follows it."""
        decomposed = unicodedata.normalize("NFD", "".join([c for c in cluster if not _invisible(c)]))
        return unicodedata.normalize("NFC", "".join([self._plain(c) for c in decomposed]))

    def _replace(self, found: re.Match) -> str:
        if found[1]:
            return found[0]
        out = self.outputs.get(found[0])
        if out is None:
            out = self.cluster(found[0])
            if len(self.outputs) < 1_000_000:
                self.outputs[found[0]] = out
        return out

    def __call__(self, text: str | None) -> str | None:
        """The one form of all texts that look like ``text``."""
        if text is None or text.isascii():
            return text
        parts, done = [], 0
        for found in self.strange.finditer(text):
            start, end = found.span()
            start = max(done, start - 1)
            parts.append(text[done:start])
            stretch = text[start:end]
            out = self.stretches.get(stretch)
            if out is None:
                if len(self.stretches) >= 200_000:
                    self.stretches.clear()
                out = self.stretches[stretch] = self.pattern.sub(self._replace, stretch)
            parts.append(out)
            done = end
        parts.append(text[done:])
        return "".join(parts)


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    for code, following in zip(codes, [*codes[1:], None]):
        start = code if start is None else start
        if following != code + 1:
            out.append(f"\\U{start:08x}-\\U{code:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def transducer(table: tuple[tuple[str, str], ...]) -> Transducer:
    """The compiled transducer, once per process and table."""
    return Transducer(table)


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``, by the table of this machine."""
    return transducer(look_alike_table())(text)


def canonical_cluster(cluster: str) -> str:
    return transducer(look_alike_table()).cluster(cluster)


def canonical_column(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """Add each text column's canonical form under ``name + suffix`` (ValueError where that exists)."""
    clash = {c + suffix for c in columns} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    table = look_alike_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = transducer(table)
        for batch in batches:
            added = [pa.array([canonical(t) for t in batch.column(c).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[c + suffix for c in columns]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c + suffix, T.StringType()) for c in columns]]))


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _digest_batches(table: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = transducer(table)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            read = [None if t is None or not t.strip() else _digest(canonical(t)) for t in texts]
            raw = [None if t is None else _digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(read, pa.binary()), pa.array(raw, pa.binary())], names=["id", "version", "lang", "reading", "raw"])

    return run


def _spelled(texts: DataFrame) -> DataFrame:
    """``id, lang, reading, raw`` digests of the latest texts whose reading has two spellings or more."""
    digests = texts.select("id", "version", "lang", "text").mapInArrow(_digest_batches(look_alike_table()), f"id bigint, version {texts.schema['version'].dataType.simpleString()}, lang string, reading binary, raw binary")
    latest = digests.groupBy("id", "lang").agg(F.max(F.struct("version", "reading", "raw")).alias("last")).select("id", "lang", "last.reading", "last.raw").filter("id is not null and reading is not null")
    mixed = latest.groupBy("lang", "reading").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("lang", "reading")
    return latest.join(mixed, ["lang", "reading"], "left_semi")


def same_reading_classes(texts: DataFrame) -> DataFrame:
    """``id, lang, reading, spelling``: texts of readings with more than one spelling, a row each; equal digests are equal texts."""
    return _spelled(texts).select("id", "lang", "reading", F.col("raw").alias("spelling"))


def same_reading_pairs(texts: DataFrame) -> DataFrame:
    """``id_a, id_b, lang``: id_a < id_b whose texts read the same but differ in code points.

    ``texts`` has ``id, version, lang, text``; the row with the greatest version counts, blank and
    null texts pair with none. Only digests are shuffled. A reading enters the join only if it has
    two spellings or more, so groups of exact copies produce nothing.
    """
    spelled = _spelled(texts)
    left = spelled.withColumnsRenamed({"id": "id_a", "raw": "raw_a"})
    right = spelled.withColumnsRenamed({"id": "id_b", "raw": "raw_b"})
    return left.join(right, ["lang", "reading"]).filter("id_a < id_b and raw_a <> raw_b").select("id_a", "id_b", "lang")

