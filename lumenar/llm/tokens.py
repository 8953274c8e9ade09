"""Encoding of a text column with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. For a piece, the last token of each
prefix's encoding is unique: among the vocabulary entries that end there (an automaton lists them)
it is the one compatible with the last token of what comes before it. Two tokens are compatible if
undoing their merges step by step never shows a merge that would have come first. One pass stores
the last token of every prefix; following them back gives the ids. The cost is linear in the
piece, however long it is.

Defined results: null and empty texts give an empty list; text that spells a special token is
ordinary text; every row gives one row.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids in each worker; a full store starts anew.
MEMO_PIECES = 300_000
MEMO_LENGTH = 48


class Vocabulary:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(PATTERN).findall
        size = max(self.rank.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[str, array] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None and a < rank and b < rank and self.compatible(a, b):
                    self.merged[(a, b)] = rank
                    self.left[rank], self.right[rank] = a, b
                    break
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives just these two tokens."""
        bound = 1 << 60
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and whole < bound:
                return False
            # undo the later of the two merges; a single byte can't be undone
            split_left = self.right[a] != a and (a > b or self.left[b] == b)
            if split_left:
                bound, a = a, self.right[a]
            elif self.left[b] != b:
                bound, b = b + 1, self.left[b]
            else:
                return True

    def encode_piece(self, piece: str) -> array:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        if whole is not None:
            return array("i", (whole,))
        size = len(data)
        last = array("i", bytes(4 * (size + 1)))
        width = array("i", bytes(4 * (size + 1)))
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if width[end]:
                continue
            start = end - length
            if start == 0 or width[start] and compatible(last[start], token):
                last[end], width[end] = token, length
        out = array("i")
        at = size
        while at:
            out.append(last[at])
            at -= width[at]
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        out = array("i")
        memo, extend = self.memo, out.extend
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            extend(ids)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _shipped(spark: SparkSession, path: str) -> str:
    """Name under which every worker gets the driver's vocabulary file; it is sent once."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", path: str = DEFAULT_VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, if None) with ``out``, the ids of the text column."""
    return _encoded(df, text, out, path, keep, count=False)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = DEFAULT_VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """As ``encode_column``, with the number of ids only."""
    return _encoded(df, text, out, path, keep, count=True)


def _encoded(df: DataFrame, text: str, out: str, path: str, keep: list[str] | None, count: bool) -> DataFrame:
    kept = [c for c in df.columns if c != text] if keep is None else keep
    if out in kept:
        raise ValueError(f"column exists already: {out}")
    slot = "__lumenar_text"
    source = df.select(*[df[c] for c in kept], df[text].alias(slot))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.LongType() if count else T.ArrayType(T.IntegerType(), False), False)])

    name = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(SparkFiles.get(name))
        for batch in batches:
            encoded = [words.encode(t) if t else () for t in batch.column(slot).to_pylist()]
            sizes = np.array([len(e) for e in encoded], np.int64)
            if count:
                column = pa.array(sizes)
            else:
                flat = np.concatenate([np.frombuffer(e, np.int32) for e in encoded if len(e)] or [np.zeros(0, np.int32)])
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], names=[*kept, out])

    return source.mapInArrow(run, schema)
