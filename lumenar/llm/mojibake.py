"""Garbled text from a wrong character encoding: find it and restore the original.

Every distinct corpus word with a letter outside ASCII is run through all encoding chains
(written in one encoding, read in another, once or twice). The garbled forms are hash-joined with
the corpus' own words; a word that is the garbled form of a better attested word is a hit, and the
original is put in its place. Words no clean text holds are still restored where each of their
sequences outside ASCII is the garbled form of an attested sequence (only for UTF-8 read as a
single-byte encoding, where such a sequence has at least two characters).

How well a word is attested is the number of distinct texts that hold it, so that copies of one
garbled text can't outvote its original; rows decide only where the texts leave it open.

All encodings here keep ASCII, so garbling never crosses an ASCII character: words are cut there.

Defined results: null and empty texts are never hits and are returned as they are; repeated rows
are judged one by one; a word that is as frequent garbled as clean, in texts and in rows, is left alone unless it was
UTF-8, which only reads one way; U+FFFD is restored to the best attested word that fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.session import cut_lineage

SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2")
#: Every single-byte encoding read as every other and as UTF-8; UTF-8 read as each, once, and again as each.
CHAINS = (
    *((a, b) for a in SINGLE_BYTE for b in (*SINGLE_BYTE, "utf-8") if a != b),
    *(("utf-8", a) for a in SINGLE_BYTE),
    *(("utf-8", a, "utf-8", b) for a in SINGLE_BYTE for b in SINGLE_BYTE),
)
#: A re-read single-byte form is believed where the original is this many times as frequent.
MIN_RATIO = 2.0

_HIGH = r"\x{80}-\x{10FFFF}"
WORD = rf"[0-9A-Za-z{_HIGH}]*[{_HIGH}][0-9A-Za-z{_HIGH}]*"
RUN = rf"[{_HIGH}]+"


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[list[str], dict[str, int]]:
    """Character of each byte (undefined bytes keep their number, as browsers do) and the reverse."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in enumerate(chars)}


def read_as(data: bytes, codec: str) -> str:
    chars = _tables(codec)[0]
    return "".join([chars[b] for b in data])


def write_in(text: str, codec: str) -> bytes | None:
    table = _tables(codec)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` written and read by turns as the chain says; None where it can't be written so.

    Single bytes that happen to be valid UTF-8 are a repair and not a garbling, so reading them as UTF-8 must fail somewhere.
    """
    for written, read in zip(chain[::2], chain[1::2]):
        try:
            data = text.encode("utf-8") if written == "utf-8" else write_in(text, written)
        except UnicodeEncodeError:
            return None
        if data is None:
            return None
        text = data.decode("utf-8", "replace") if read == "utf-8" else read_as(data, read)
        if read == "utf-8" and "\ufffd" not in text:
            return None
    return text


@lru_cache(maxsize=8)
def _signs(alphabet: str) -> frozenset[str]:
    return frozenset(alphabet)


@lru_cache(maxsize=100_000)
def _sign_forms(sign: str, alphabet: str | None) -> dict[int, str]:
    """Form of one character by number of chain, where its signs are in the alphabet (if one is given)."""
    forms = {k: garble(sign, chain) for k, chain in enumerate(CHAINS) if k not in _REREAD}
    return {k: f for k, f in forms.items() if f is not None and (alphabet is None or all(c < "\x80" or c in _signs(alphabet) for c in f))}


@lru_cache(maxsize=100_000)
def _run_forms(run: str, alphabet: str | None) -> dict[int, str]:
    """The same of a sequence outside ASCII; all chains but those read as UTF-8 go character by character."""
    first, *rest = [_sign_forms(c, alphabet) for c in run]
    for more in rest:
        first = {k: f + more[k] for k, f in first.items() if k in more}
    if alphabet is None or "\ufffd" in _signs(alphabet):
        again = {k: garble(run, CHAINS[k]) for k in _REREAD}
        first = first | {k: f for k, f in again.items() if f is not None and (alphabet is None or all(c < "\x80" or c in _signs(alphabet) for c in f))}
    return first


_REREAD = frozenset(k for k, chain in enumerate(CHAINS) if chain[1] == "utf-8")
_ONE_WAY = frozenset(k for k, chain in enumerate(CHAINS) if chain[0] == "utf-8")
_PIECES = re.compile("([\x80-\U0010ffff]+)")


def garbled_forms(word: str, alphabet: str | None = None) -> dict[str, bool]:
    """All garbled forms of a word; True where the chain starts from UTF-8, so that it reads back one way only.

    All chains keep ASCII, so a word's form is put together from those of its sequences outside ASCII.
    """
    pieces = _PIECES.split(word)
    runs = [_run_forms(r, alphabet) for r in pieces[1::2]]
    out: dict[str, bool] = {}
    if not runs:
        return out
    for k, first in runs[0].items():
        if len(runs) == 1:
            form = f"{pieces[0]}{first}{pieces[2]}"
        elif all(k in r for r in runs):
            form = "".join([r if i % 2 == 0 else runs[i // 2][k] for i, r in enumerate(pieces)])
        else:
            continue
        if k in _ONE_WAY:
            out[form] = True
        else:
            out.setdefault(form, False)
    out.pop(word, None)
    return out


def _cases(word: str) -> set[str]:
    return {word, word.upper(), word[:1].upper() + word[1:]}


def _form_batches(utf8_only: bool, alphabet: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, bool, float, float]] = []
            for word, n, texts in zip(*[c.to_pylist() for c in batch.columns]):
                for variant in {word} if utf8_only else _cases(word):
                    weight, rows_of = (float(texts), float(n)) if variant == word else (0.5, 0.5)
                    for form, one_way in garbled_forms(variant, alphabet).items():
                        if one_way and len(form) > 1 or not utf8_only:
                            rows.append((form, variant, one_way, weight, rows_of))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64()))],
                names=["form", "original", "one_way", "weight", "rows"],
            )

    return run


def _best_originals(words: DataFrame, utf8_only: bool, alphabet: str) -> DataFrame:
    """``form, original`` for every corpus word (or sequence) that is a garbled form of a better attested one."""
    forms = words.select("word", "n", "n_texts").mapInArrow(_form_batches(utf8_only, alphabet), "form string, original string, one_way boolean, weight double, rows double")
    seen = words.select(F.col("word").alias("form"), F.col("n").alias("n_form"), F.col("n_texts").alias("texts_form"))
    attested = (F.col("weight") > F.col("texts_form")) | (F.col("rows") > F.col("n_form"))
    by_texts, against = F.col("weight") >= MIN_RATIO * F.col("texts_form"), F.col("texts_form") >= MIN_RATIO * F.col("weight")
    fits = F.when(F.col("one_way"), F.lit(True) if not utf8_only else attested).otherwise(by_texts | (~against & (F.col("rows") >= MIN_RATIO * F.col("n_form"))))
    sure = (F.col("one_way") & (F.col("weight") >= 1)).alias("sure")
    best = F.max(F.struct(sure, "weight", "rows", "one_way", F.col("original").rlike(r"\p{L}").alias("letters"), "original")).alias("best")
    # the forms are many times the words they come from, which Spark can't see: they must not be broadcast
    return forms.join(seen.hint("shuffle_hash"), "form").filter(fits).groupBy("form").agg(best).select("form", F.col("best.original").alias("original"))


def corpus_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """``word, n, n_texts``: in how many rows, and in how many distinct texts, each word with a character outside ASCII occurs."""
    column = F.col(f"`{text}`")
    words = F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(WORD), F.lit(0)))).alias("word")
    by_text = documents.select(F.xxhash64(column).alias("of"), words).groupBy("word", "of").agg(F.count("*").alias("n"))
    return by_text.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


def garbled_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """``word, original`` for the garbled words of the corpus."""
    words = cut_lineage(corpus_words(documents, text))
    # a form with a sign that no word has can't be a word: at most one row per sign of Unicode
    signs = words.select(F.explode(F.split(F.regexp_replace("word", "[\\x00-\\x7f]+", ""), "")).alias("sign")).distinct().collect()
    alphabet = "".join(sorted(r.sign for r in signs))
    by_word = _best_originals(words, utf8_only=False, alphabet=alphabet).withColumnRenamed("form", "word")
    runs = words.select(F.explode(F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).alias("word"), "n", "n_texts").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))
    by_run = _best_originals(runs, utf8_only=True, alphabet=alphabet)
    # put the pieces of each word together again, with the restored sequences in place
    pieces = words.join(by_word, "word", "left_anti").select("word", F.posexplode(F.regexp_extract_all("word", F.lit(rf"[{_HIGH}]+|[0-9A-Za-z]+"), F.lit(0))).alias("at", "form"))
    mended = (
        pieces.join(by_run, "form", "left")
        .groupBy("word")
        .agg(
            F.count("original").alias("hits"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("original", "form").alias("piece")))), lambda x: x.piece), "").alias("original"),
        )
        .filter("hits > 0")
        .select("word", "original")
    )
    return by_word.unionByName(mended)


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fixes array<struct<word, original>>``: one row per hit.

    A single sign may stand for itself, so a text needs a garbled word of two characters or more.
    """
    bad = cut_lineage(garbled_words(documents, text))
    words = documents.select(F.col(f"`{key}`").alias(key), F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)))).alias("word"))
    return words.join(bad, "word").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("word", "original"))).alias("fixes")).filter(F.exists("fixes", lambda f: F.length(f.word) > 1))


def _mend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][0-9A-Za-z\x80-\U0010ffff]*")
    for batch in batches:
        texts = []
        for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            table = {f["word"]: f["original"] for f in fixes}
            texts.append(word.sub(lambda m: table.get(m[0], m[0]), text))  # noqa: B023
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3)], names=["key", "restored", "n_words"])


def restore_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, restored, n_words`` of every hit: its text with the garbled words replaced."""
    hits = garbled_documents(documents, key, text)
    source = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(hits.withColumnRenamed(key, "key"), "key")
    kind = documents.schema[key].dataType.simpleString()
    out = source.select("key", "text", "fixes", F.size("fixes").alias("n_words")).mapInArrow(_mend_batches, f"key {kind}, restored string, n_words int")
    return out.withColumnRenamed("key", key)
