"""Sentences of bilingual documents paired with their translations.

Word translation tables are estimated by distributed expectation-maximisation: each partition adds
up the expected counts of its sentence pairs under the current tables, and the counts are summed,
normalised and pruned as a DataFrame. The first sentence pairs come from words both languages write
alike (names, numbers) and from relative position; the last step counts the pairs that the tables
themselves link. Words written alike in both sentences of a pair explain each other and take no
part in the counts.

Sentences are then linked competitively: the best pair anywhere in the document is accepted first,
whatever its position, and uses up the words that explain each other; what is left of a sentence
may still link to others, so that merges come out as several links and omissions as none.

Documents are worked on many at a time, in flat arrays: words that explain each other are found by
an inverted index of each document's words, never as a matrix of all words against all. Pairs that
are the best of both their sentences don't depend on each other, so they are accepted together.

Tables and word weights of up to ``BROADCAST_ROWS`` rows are broadcast, in pieces that the executors
pack, so that the driver holds one piece at a time. Larger ones are joined: each document then
carries the rows of its own words.

Defined results: a document without one of its texts gives nothing; repeated sentences link in
order of position; sentences without words link to none; of several deliveries the latest counts.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.llm.lookalikes import canonical, look_alike_table, transducer
from lumenar.session import cut_lineage

#: Words in fewer documents than this aren't in the tables; they match by spelling.
MIN_DOCUMENTS = 4
#: Translations below this probability are pruned, so that a word keeps 50 at most in either direction.
MIN_PROBABILITY = 0.02
#: In the first step, where a pair has only its share of a sentence, pairs that keep together (twice their
#: common pairs over all of both) are kept too.
MIN_TOGETHER = 0.3
#: EM steps on the first sentence pairs, and on the pairs the tables then link.
FIRST_STEPS, LINKED_STEPS = 3, 1
#: Rows of tables and weights up to which they are broadcast (some 24 bytes each), and rows of a piece of them.
BROADCAST_ROWS = 3_000_000
PIECE = 250_000
NULL_WEIGHT = 0.02
LINK_SCORE = 0.37
USED_MATCH = 0.25
STRENGTH = 2.2  # a phrase of two words that stand for two others has 0.25 * 0.25 for each, a full match
MIN_STRENGTH = 0.1  # of a word pair that may count in a link
MERGED = 1.5  # times the expected length from which a sentence is taken to hold another one too
MOST_ALIKE = 30.0  # weight of words written alike that outweighs any distance
LONE_RARE = 0.3  # weight of a rare word without a counterpart
#: Cells (words times sentences, or documents times vocabulary) held at once; larger documents go in pieces.
CELLS = 2_000_000
BLOCK = 256  # documents worked on together
HELD = 4_000_000  # word pairs counted before they are added up

NO_LANG = "\0"  # stands for a missing language

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d{3})*")


def sentences(text: str | None) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text.strip())) if s] if text else []


def _fold(word: str) -> str:
    word = word.casefold()
    if word.isascii():
        return word.replace(",", "").replace(".", "") if word[:1].isdigit() else word
    return "".join([c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)])


def words(sentence: str, canonical: Callable[[str], str] = canonical) -> list[str]:
    """Words of a sentence: look-alikes made one, case and accents dropped, digit groups closed."""
    return [_fold(w) for w in _WORD.findall(canonical(sentence))]


class _Chunks(dict):
    """Number of each stretch between blanks; per stretch its words' codes, and whether a sentence ends with it.

    A code is the hash of a folded word; its last bit says whether the word may match by spelling.
    """

    def __init__(self, canonical: Callable[[str], str]) -> None:
        self.canonical = canonical
        self.codes, self.sizes, self.ends = array("q"), array("q"), array("b")

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        found = words(chunk, self.canonical)
        self.codes.extend([_hash(w) & ~1 | (len(w) >= 4 or w.isdigit()) for w in found])
        self.sizes.append(len(found))
        self.ends.append(chunk[-1] in ".!?")
        return number


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_TOKENISED = "uid bigint, id bigint, lang string, " + ", ".join(f"{x}_sentences array<int>, {x}_words array<bigint>, {x}_counts array<int>" for x in "st")


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _words_of(texts: list[str], chunks: _Chunks) -> list[pa.ListArray]:
    """Per text: the number of distinct words of each sentence, and these words' codes and counts, sentence by sentence."""
    split = [t.split() for t in texts]
    n_chunks = np.array([len(x) for x in split], np.int64)
    chunk = np.fromiter(map(chunks.__getitem__, chain.from_iterable(split)), np.int64, int(n_chunks.sum()))
    codes, sizes, ends = np.array(chunks.codes, np.int64), np.array(chunks.sizes, np.int64), np.array(chunks.ends, bool)
    # a sentence ends with its mark, or with the text
    end = ends[chunk]
    end[(np.cumsum(n_chunks) - 1)[n_chunks > 0]] = True
    sentence = np.cumsum(end) - end
    of_text = np.repeat(np.arange(len(texts)), n_chunks)
    n_sentences = np.bincount(of_text, end, len(texts)).astype(np.int64)
    size = sizes[chunk]
    code = codes[_runs((np.cumsum(sizes) - sizes)[chunk], size)]
    word, distinct = pd.factorize(code)
    width = max(1, distinct.size)
    key, count = np.unique(np.repeat(sentence, size) * width + word, return_counts=True)
    in_sentence = np.bincount(key // width, minlength=int(end.sum()))
    per_text = np.bincount(of_text[end], in_sentence, len(texts)).astype(np.int64)
    return [_lists(in_sentence, n_sentences, pa.int32()), _lists(distinct[key % width], per_text, pa.int64()), _lists(count, per_text, pa.int32())]


def _tokenise(canonical: Callable[[], Callable[[str], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(canonical())
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                if len(chunks) > 500_000:
                    chunks = _Chunks(canonical())
                batch = whole.slice(at, 2000)
                columns = [*(batch.column(i) for i in range(3)), *[x for i in (3, 4) for x in _words_of(batch.column(i).to_pylist(), chunks)]]
                yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    return run


_COLUMNS = ["uid", "id", "lang", *[f"{x}_{n}" for x in "st" for n in ("sentences", "words", "counts")]]


# ---------------------------------------------------------------- tables


@dataclass
class Lexicon:
    """Word weights of either side and association of word pairs, sorted by their codes."""

    source: np.ndarray  # codes
    source_weight: np.ndarray
    target: np.ndarray  # keys: codes of a language's words
    target_weight: np.ndarray
    rare_weight: float
    pair_source: np.ndarray
    pair_target: np.ndarray
    forward: np.ndarray  # p(target | source)
    backward: np.ndarray  # p(source | target)

    def of(self, source: np.ndarray, target: np.ndarray) -> Lexicon:
        """What concerns some source words and target keys."""
        at, ok = _look_up(self.source, np.sort(source))
        of_s = at[ok]
        target = np.sort(target)
        at, ok = _look_up(self.target, target)
        of_t = at[ok]
        low, high = np.searchsorted(self.pair_source, np.sort(source)), np.searchsorted(self.pair_source, np.sort(source), "right")
        entry = _runs(low, high - low)
        entry = entry[_look_up(target, self.pair_target[entry])[1]]
        return Lexicon(
            self.source[of_s], self.source_weight[of_s], self.target[of_t], self.target_weight[of_t], self.rare_weight,
            self.pair_source[entry], self.pair_target[entry], self.forward[entry], self.backward[entry],
        )


@dataclass
class Pieces:
    """A lexicon broadcast in pieces, each with some of its rows."""

    shared: list[Broadcast]
    rare_weight: float

    def of(self, source: np.ndarray, target: np.ndarray) -> Lexicon:
        parts = [x.value.of(source, target) for x in self.shared]
        join = lambda name, kind=np.int64: np.concatenate([np.zeros(0, kind), *(getattr(x, name) for x in parts)])
        codes, keys, pair_source, pair_target = join("source"), join("target"), join("pair_source"), join("pair_target")
        by_s, by_t, by = np.argsort(codes), np.argsort(keys), np.lexsort((pair_target, pair_source))
        return Lexicon(
            codes[by_s], join("source_weight", float)[by_s], keys[by_t], join("target_weight", float)[by_t], self.rare_weight,
            pair_source[by], pair_target[by], join("forward", np.float32)[by], join("backward", np.float32)[by],
        )


def _lang_hash(lang: str) -> int:
    return _hash(f"language {lang}") & ~1


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(start - (ends - size), size)


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted keys, and whether it is there."""
    if not keys.size:
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


class _Index:
    """Places of sorted keys by hash; keys that meet in one slot are searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(10, min(22, int(keys.size).bit_length() + 3)))
        slot = self._slot(keys)
        self.place = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.place[slot] = np.arange(keys.size)
        self.place[slot[self.place[slot] != np.arange(keys.size)]] = -2

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, wanted: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each wanted key that is there, and ``of`` of these."""
        place = self.place[self._slot(wanted)]
        some = np.flatnonzero(place != -1)
        place, key = place[some], wanted[some]
        shared = np.flatnonzero(place == -2)
        place[shared] = np.minimum(np.searchsorted(self.keys, key[shared]), self.keys.size - 1)
        right = self.keys[place] == key
        return place[right], of[some[right]]


class _Side:
    """One side of a batch: its words (distinct within their sentence), sentence by sentence, document by document."""

    def __init__(self, batch: pa.RecordBatch, side: str) -> None:
        sizes, word, count = (batch.column(f"{side}_{n}") for n in ("sentences", "words", "counts"))
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        self.n_sentences = np.asarray(sizes.value_lengths(), np.int64)
        self.size = flat(sizes).astype(np.int64)
        self.code = flat(word).astype(np.int64)
        self.count = flat(count).astype(np.int64)
        self.first_sentence = np.concatenate([[0], np.cumsum(self.n_sentences)])
        self.first_word = np.concatenate([[0], np.cumsum(self.size)])  # of each sentence
        self.sentence = np.repeat(np.arange(self.size.size), self.size)
        self.doc = np.repeat(np.arange(self.n_sentences.size), np.asarray(word.value_lengths(), np.int64))
        self.doc_of_sentence = np.repeat(np.arange(self.n_sentences.size), self.n_sentences)
        self.length = np.bincount(self.sentence, self.count, self.size.size)  # words of each sentence


class Batch:
    """Documents of an Arrow batch with the part of the tables that concerns their words."""

    def __init__(self, batch: pa.RecordBatch, lex: Lexicon | Pieces) -> None:
        self.s, self.t = _Side(batch, "s"), _Side(batch, "t")
        langs, names = pd.factorize(np.array([NO_LANG if x is None else x for x in batch.column("lang").to_pylist()], object))
        self.lang, self.lang_names = langs.astype(np.int64), list(names)
        hashes = np.array([_lang_hash(x) for x in names], np.int64)
        codes, self.code = pd.factorize(np.concatenate([self.s.code, self.t.code]))
        n_langs, n_codes = max(1, len(names)), self.code.size
        self.n_langs, self.width = n_langs, max(1, n_codes * n_langs)
        # a target word is known by its code and language
        self.s_id = codes[: self.s.code.size].astype(np.int64)
        self.t_code = codes[self.s.code.size :].astype(np.int64)
        self.t_id = self.t_code * n_langs + self.lang[self.t.doc]
        self.target_key = (self.code[:, None] ^ hashes[None, :]).ravel() if len(names) else self.code
        lex = lex.of(self.code, self.target_key)
        at, self.s_known = _look_up(lex.source, self.code)
        self.s_weight = np.where(self.s_known, lex.source_weight[at] if lex.source.size else 0.0, lex.rare_weight)
        at, self.t_known = _look_up(lex.target, self.target_key)
        self.t_weight = np.where(self.t_known, lex.target_weight[at] if lex.target.size else 0.0, lex.rare_weight)
        self.alike = (self.code & 1).astype(bool)
        # rows of the tables by source word
        low, high = np.searchsorted(lex.pair_source, self.code), np.searchsorted(lex.pair_source, self.code, "right")
        entry, row = _runs(low, high - low), np.repeat(np.arange(n_codes), high - low)
        order = np.argsort(self.target_key)
        at, ok = _look_up(self.target_key[order], lex.pair_target[entry])
        row, column, entry = row[ok], order[at[ok]] if order.size else at[ok], entry[ok]
        self.table_key = row * self.width + column
        order = np.argsort(self.table_key)
        self.table_key, self.table_forward = self.table_key[order], lex.forward[entry[order]].astype(float)
        self.table = _Index(self.table_key)
        strength = np.minimum(1.0, STRENGTH * np.sqrt(lex.forward[entry[order]].astype(float) * lex.backward[entry[order]]))
        strong = strength >= MIN_STRENGTH
        key = self.table_key[strong]
        self.column, self.strength = key % self.width, strength[strong]
        self.row_start = np.searchsorted(key // self.width, np.arange(n_codes + 1))

    def blocks(self) -> Iterator[tuple[int, int, int, int]]:
        """First and last document, and target sentences, of parts that are worked on at once."""
        s_words, t_words = np.bincount(self.s.doc, minlength=self.lang.size), np.bincount(self.t.doc, minlength=self.lang.size)
        cost = s_words * self.t.n_sentences + t_words * self.s.n_sentences
        most = max(1, min(BLOCK, CELLS // self.width))
        d = 0
        while d < self.lang.size:
            if cost[d] > CELLS:  # one document, some target sentences at a time
                first, last = self.t.first_sentence[d], self.t.first_sentence[d + 1]
                share = np.cumsum(s_words[d] + self.t.size[first:last] * self.s.n_sentences[d]) // CELLS
                cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), last - first]
                yield from ((d, d + 1, int(first + a), int(first + b)) for a, b in zip(cuts, cuts[1:]) if b > a)
                d += 1
                continue
            end = d + 1
            total = cost[d]
            while end < self.lang.size and end - d < most and total + cost[end] <= CELLS:
                total += cost[end]
                end += 1
            yield d, end, int(self.t.first_sentence[d]), int(self.t.first_sentence[end])
            d = end


class Block:
    """Word pairs that may explain each other in some documents of a batch, by an inverted index of their words."""

    def __init__(self, batch: Batch, docs: tuple[int, int], targets: tuple[int, int], place: np.ndarray, tables: bool) -> None:
        s, t, self.batch, self.docs = batch.s, batch.t, batch, docs
        d0, d1 = docs
        self.s_from, self.s_to = s.first_word[s.first_sentence[d0]], s.first_word[s.first_sentence[d1]]
        self.t_from, self.t_to = t.first_word[targets[0]], t.first_word[targets[1]]
        source, target = slice(self.s_from, self.s_to), slice(self.t_from, self.t_to)
        s_doc, t_doc = s.doc[source] - d0, t.doc[target] - d0
        s_order, s_key, s_start, s_count = _by_key(s_doc * batch.code.size + batch.s_id[source])
        t_order, t_key, t_start, t_count = _by_key(t_doc * batch.width + batch.t_id[target])
        place[t_key] = np.arange(t_key.size)
        doc, code = s_key // max(1, batch.code.size), s_key % max(1, batch.code.size)
        same = doc * batch.width + code * batch.n_langs + batch.lang[d0 + doc]
        twin = place[same]
        alike = (twin >= 0) & batch.alike[code]
        left, right, strength = [np.flatnonzero(alike)], [twin[alike]], [np.ones(int(alike.sum()))]
        if tables:
            size = batch.row_start[code + 1] - batch.row_start[code]
            entry, of = _runs(batch.row_start[code], size), np.repeat(np.arange(code.size), size)
            key = doc[of] * batch.width + batch.column[entry]
            there = place[key]
            ok = (there >= 0) & ~((key == same[of]) & batch.alike[code[of]])
            left.append(of[ok])
            right.append(there[ok])
            strength.append(batch.strength[entry[ok]])
        place[t_key] = -1
        left, right, strength = np.concatenate(left), np.concatenate(right), np.concatenate(strength)
        # from words of the document to words of its sentences
        across = t_count[right]
        total = s_count[left] * across
        of = np.repeat(np.arange(left.size), total)
        nth = _runs(np.zeros(left.size, np.int64), total)
        self.source = s_order[s_start[left[of]] + nth // across[of]]
        self.target = t_order[t_start[right[of]] + nth % across[of]]
        self.strength = strength[of]
        # a rare word written in one text only says little
        s_twin, t_twin = np.zeros(s_doc.size, bool), np.zeros(t_doc.size, bool)
        s_twin[s_order] = np.repeat(alike, s_count)
        t_alike = np.zeros(t_key.size, bool)
        t_alike[twin[alike]] = True
        t_twin[t_order] = np.repeat(t_alike, t_count)
        s_id, t_id = batch.s_id[source], batch.t_id[target]
        self.s_weight = batch.s_weight[s_id] * np.where(batch.s_known[s_id] | s_twin, 1.0, LONE_RARE)
        self.t_weight = batch.t_weight[t_id] * np.where(batch.t_known[t_id] | t_twin, 1.0, LONE_RARE)
        self.s_count, self.t_count = s.count[source], t.count[target]
        # sentences of the block, and their places within the document
        self.s0, self.t0 = s.first_sentence[d0], targets[0]
        self.s_sentence, self.t_sentence = s.sentence[source] - self.s0, t.sentence[target] - self.t0
        self.n_s, self.n_t = int(s.first_sentence[d1] - self.s0), targets[1] - targets[0]
        first_t = np.maximum(t.first_sentence[d0:d1], targets[0])
        self.m = np.minimum(t.first_sentence[d0 + 1 : d1 + 1], targets[1]) - first_t  # target sentences here
        self.n = s.n_sentences[d0:d1]
        self.s_local, self.t_local = self.s_sentence - (s.first_sentence[d0:d1] - self.s0)[s_doc], self.t_sentence - (first_t - targets[0])[t_doc]
        self.s_doc, self.t_doc, self.first_t = s_doc, t_doc, first_t
        self.cells = np.concatenate([[0], np.cumsum(self.n * self.m)])  # sentence pairs of each document

    def cell(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Number of the sentence pair of a source and a target word: by document, target sentence, source sentence."""
        doc = self.s_doc[source]
        return self.cells[doc] + self.t_local[target] * self.n[doc] + self.s_local[source]

    def pair_of(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, and places within the document of both sentences."""
        doc = np.searchsorted(self.cells, cell, "right") - 1
        inside = cell - self.cells[doc]
        n = np.maximum(self.n[doc], 1)
        return doc, inside % n, inside // n + (self.first_t - self.batch.t.first_sentence[self.docs[0] : self.docs[1]])[doc]

    def first_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each target sentence the source sentence with most words written alike, then nearest in place."""
        doc, i, j = self.pair_of(np.arange(self.cells[-1]))
        n, m = self.n[doc], self.batch.t.n_sentences[self.docs[0] + doc]
        score = -4.0 * np.abs((i + 0.5) / n - (j + 0.5) / m) * np.minimum(n, m)
        alike = np.bincount(self.cell(self.source, self.target), (self.s_weight * self.s_count)[self.source], score.size)
        score += np.minimum(alike, MOST_ALIKE)
        if not score.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.flatnonzero(i == 0)
        most = np.repeat(np.maximum.reduceat(score, start), np.diff(np.append(start, score.size)))
        best = np.flatnonzero(score == most)
        target = np.cumsum(i == 0)[best]
        best = best[np.concatenate([[True], target[1:] != target[:-1]])]
        return self._sentences(doc[best], i[best], j[best])

    def _sentences(self, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence numbers within the batch."""
        return self.batch.s.first_sentence[self.docs[0] + doc] + i, self.batch.t.first_sentence[self.docs[0] + doc] + j

    def candidates(self) -> Candidates:
        """Sentence pairs that reach the least score while no word is used, with the word pairs between them."""
        # best match of each source word in each target sentence, and of each target word in each source sentence
        s_start = np.cumsum(self.m[self.s_doc]) - self.m[self.s_doc]
        t_start = np.cumsum(self.n[self.t_doc]) - self.n[self.t_doc]
        rows, columns = np.zeros(int(self.m[self.s_doc].sum())), np.zeros(int(self.n[self.t_doc].sum()))
        np.maximum.at(rows, s_start[self.source] + self.t_local[self.target], self.strength)
        np.maximum.at(columns, t_start[self.target] + self.s_local[self.source], self.strength)
        s_full, t_full = self.s_weight * self.s_count, self.t_weight * self.t_count
        size = int(self.cells[-1])
        of, j = np.repeat(np.arange(self.s_doc.size), self.m[self.s_doc]), _runs(np.zeros(self.s_doc.size, np.int64), self.m[self.s_doc])
        doc = self.s_doc[of]
        covered_s = np.bincount(self.cells[doc] + j * self.n[doc] + self.s_local[of], rows * s_full[of], size)
        of, i = np.repeat(np.arange(self.t_doc.size), self.n[self.t_doc]), _runs(np.zeros(self.t_doc.size, np.int64), self.n[self.t_doc])
        doc = self.t_doc[of]
        covered_t = np.bincount(self.cells[doc] + self.t_local[of] * self.n[doc] + i, columns * t_full[of], size)
        s_all, t_all = np.bincount(self.s_sentence, s_full, self.n_s), np.bincount(self.t_sentence, t_full, self.n_t)
        some = np.flatnonzero((covered_s > 0) & (covered_t > 0))
        doc, i, j = self.pair_of(some)
        source, target = self._sentences(doc, i, j)
        score = _score(covered_s[some] / np.maximum(s_all[source - self.s0], 1e-9), covered_t[some] / np.maximum(t_all[target - self.t0], 1e-9))
        kept = score >= LINK_SCORE
        number = np.full(size, -1, np.int64)
        number[some[kept]] = np.arange(int(kept.sum()))
        pair = number[self.cell(self.source, self.target)]
        inside = pair >= 0
        return Candidates(source[kept], target[kept], score[kept], pair[inside], self.source[inside] + self.s_from, self.target[inside] + self.t_from, self.strength[inside], s_all, t_all, self)


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, the distinct keys, and where each starts and how often it occurs."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if key.size else np.zeros(0, np.int64)
    return order, ordered[start], start, np.diff(np.append(start, key.size))


def _score(cover_s: np.ndarray, cover_t: np.ndarray) -> np.ndarray:
    return 0.7 * np.maximum(cover_s, cover_t) + 0.3 * np.minimum(cover_s, cover_t)


@dataclass
class Candidates:
    """Sentence pairs (numbers within the batch), their scores, and word pairs (numbers within the batch) between them."""

    source: np.ndarray
    target: np.ndarray
    score: np.ndarray
    pair: np.ndarray
    s_word: np.ndarray
    t_word: np.ndarray
    strength: np.ndarray
    s_all: np.ndarray  # weight of the block's source sentences
    t_all: np.ndarray
    block: Block


def links(batch: Batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Accepted links of all documents: source and target sentence (numbers within the batch) and score."""
    place = np.full(min(BLOCK, max(1, CELLS // batch.width)) * batch.width, -1, np.int64)
    held: list[Candidates] = []
    for d0, d1, t0, t1 in batch.blocks():
        if held and held[0].block.docs != (d0, d1):
            yield _settle(batch, held)
            held = []
        block = Block(batch, (d0, d1), (t0, t1), place, True)
        held.append(block.candidates())
    if held:
        yield _settle(batch, held)


def _settle(batch: Batch, parts: list[Candidates]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Competitive linking of one block (or the pieces of one document).

    Using up words only lowers scores, so a pair that is the best of all open pairs of both its
    sentences is accepted before any of them, whatever happens elsewhere. Such pairs are accepted
    together; then the pairs that share a sentence with them are scored anew.
    """
    s, t, blocks = batch.s, batch.t, [p.block for p in parts]
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    offset = np.cumsum([0, *(p.source.size for p in parts)])
    source, target, score, strength = join("source"), join("target"), join("score"), join("strength")
    pair = np.concatenate([p.pair + o for p, o in zip(parts, offset)])
    s0, t0, sw0, tw0 = blocks[0].s0, blocks[0].t0, blocks[0].s_from, blocks[0].t_from
    s_word, t_word = join("s_word") - sw0, join("t_word") - tw0
    s_left, t_left = s.count[sw0 : blocks[0].s_to].astype(float), t.count[tw0 : blocks[-1].t_to].astype(float)
    s_weight, t_weight = blocks[0].s_weight, np.concatenate([b.t_weight for b in blocks])
    s_all, t_all = parts[0].s_all, np.concatenate([p.t_all for p in parts])
    s_words, t_words = s.length[s0 : s0 + s_all.size], t.length[t0 : t0 + t_all.size]
    doc0, doc1 = blocks[0].docs
    n_docs = doc1 - doc0
    s_doc, t_doc = s.doc_of_sentence[s0 : s0 + s_all.size] - doc0, t.doc_of_sentence[t0 : t0 + t_all.size] - doc0
    ratio = np.bincount(t_doc, t_words, n_docs) / np.maximum(np.bincount(s_doc, s_words, n_docs), 1)
    i, j = source - s0, target - t0
    doc = s_doc[i]
    nth_s, nth_t = source - s.first_sentence[doc0 + doc], target - t.first_sentence[doc0 + doc]
    apart = 1e-3 * np.abs((nth_s + 0.5) / s.n_sentences[doc0 + doc] - (nth_t + 0.5) / t.n_sentences[doc0 + doc])
    expected = s_words[i] * ratio[doc]
    merged_t = t_words[j] > MERGED * expected
    merged_s = ~merged_t & (expected > MERGED * t_words[j])
    # slots: each word of a pair, with the best match it has there
    s_slots, s_slot = np.unique(pair * max(1, s_left.size) + s_word, return_inverse=True)
    t_slots, t_slot = np.unique(pair * max(1, t_left.size) + t_word, return_inverse=True)
    ss_pair, ss_word = s_slots // max(1, s_left.size), s_slots % max(1, s_left.size)
    ts_pair, ts_word = t_slots // max(1, t_left.size), t_slots % max(1, t_left.size)
    s_best, t_best = np.zeros(ss_pair.size), np.zeros(ts_pair.size)
    np.maximum.at(s_best, s_slot, strength)
    np.maximum.at(t_best, t_slot, strength)
    open_ = np.ones(source.size, bool)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while open_.any():
        live = np.flatnonzero(open_)
        order = live[np.lexsort((j[live], i[live], apart[live] - score[live]))]
        rank = np.arange(order.size)
        s_first, t_first = np.full(s_all.size, order.size), np.full(t_all.size, order.size)
        np.minimum.at(s_first, i[order], rank)
        np.minimum.at(t_first, j[order], rank)
        taken = order[(s_first[i[order]] == rank) & (t_first[j[order]] == rank)]
        got.append((source[taken], target[taken], score[taken]))
        open_[taken] = False
        accepted = np.zeros(source.size, bool)
        accepted[taken] = True
        for best, of, word, left, halved in ((s_best, ss_pair, ss_word, s_left, merged_s), (t_best, ts_pair, ts_word, t_left, merged_t)):
            used = accepted[of] & (best >= USED_MATCH)
            left[word[used]] = np.where(halved[of[used]], left[word[used]] // 2, 0.0)
        s_touched, t_touched = np.zeros(s_all.size, bool), np.zeros(t_all.size, bool)
        s_touched[i[taken]] = True
        t_touched[j[taken]] = True
        anew = open_ & (s_touched[i] | t_touched[j])
        if not anew.any():
            continue
        entry = np.flatnonzero(anew[pair])
        value = strength[entry] * (s_left[s_word[entry]] > 0) * (t_left[t_word[entry]] > 0)
        s_again, t_again = anew[ss_pair], anew[ts_pair]
        s_best[s_again], t_best[t_again] = 0.0, 0.0
        np.maximum.at(s_best, s_slot[entry], value)
        np.maximum.at(t_best, t_slot[entry], value)
        covered_s = np.bincount(ss_pair[s_again], (s_best * s_weight[ss_word] * s_left[ss_word])[s_again], source.size)
        covered_t = np.bincount(ts_pair[t_again], (t_best * t_weight[ts_word] * t_left[ts_word])[t_again], source.size)
        fresh = np.flatnonzero(anew)
        score[fresh] = _score(covered_s[fresh] / np.maximum(s_all[i[fresh]], 1e-9), covered_t[fresh] / np.maximum(t_all[j[fresh]], 1e-9))
        open_[fresh[score[fresh] < LINK_SCORE]] = False
    return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in range(3))


# ---------------------------------------------------------------- expectation-maximisation


def _pairs(batch: Batch, linked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if linked:
        yield from (x[:2] for x in links(batch))
        return
    place = np.full(min(BLOCK, max(1, CELLS // batch.width)) * batch.width, -1, np.int64)
    for d0, d1, t0, t1 in batch.blocks():
        yield Block(batch, (d0, d1), (t0, t1), place, False).first_pairs()


def _cells(batch: Batch, source: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Word pairs of sentence pairs: key, target word's number, source words against it; and how many target words there are.

    Words outside the vocabulary, and words written alike in both sentences, are left out.
    """
    s, t = batch.s, batch.t
    done = 0
    cost = np.cumsum(s.size[source] * t.size[target])
    while done < source.size:
        until = max(done + 1, int(np.searchsorted(cost, (cost[done - 1] if done else 0) + CELLS, "right")))
        i, j = source[done:until], target[done:until]
        done = until
        s_word, s_of = _runs(s.first_word[i], s.size[i]), np.repeat(np.arange(i.size), s.size[i])
        t_word, t_of = _runs(t.first_word[j], t.size[j]), np.repeat(np.arange(j.size), t.size[j])
        s_key, t_key = s_of * batch.code.size + batch.s_id[s_word], t_of * batch.code.size + batch.t_code[t_word]
        s_spelt, t_spelt = batch.alike[batch.s_id[s_word]], batch.alike[batch.t_code[t_word]]
        twins = np.intersect1d(s_key[s_spelt], t_key[t_spelt], assume_unique=True)
        s_ok = batch.s_known[batch.s_id[s_word]] & ~_look_up(twins, s_key)[1]
        t_ok = batch.t_known[batch.t_id[t_word]] & ~_look_up(twins, t_key)[1]
        s_id, s_of, t_id, t_of = batch.s_id[s_word[s_ok]], s_of[s_ok], batch.t_id[t_word[t_ok]], t_of[t_ok]
        n = np.bincount(s_of, minlength=i.size)
        start = np.cumsum(n) - n
        width = n[t_of]
        at = np.repeat(np.arange(t_of.size), width)
        yield s_id[_runs(start[t_of], width)] * batch.width + t_id[at], at, width, t_of.size


def _uniform(batch: Batch, linked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word pairs, their expected counts where all source words are alike, and how many sentence pairs hold them."""
    found: list[tuple] = []
    held: list[np.ndarray] = []
    sizes = np.zeros(0, np.int64)

    def add_up() -> None:
        packed = np.sort(np.concatenate(held))
        start = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        count = np.diff(np.append(start, packed.size)).astype(float)
        key, share = packed[start] // 4096, 1.0 / (packed[start] % 4096 + NULL_WEIGHT)
        found.append((key, count * share, count))
        held.clear()

    for source, target in _pairs(batch, linked):
        for key, at, width, _ in _cells(batch, source, target):
            sizes = np.minimum(width, 4095)  # a share of a longer sentence is next to nothing
            if key.size and batch.code.size * batch.width < 1 << 50:
                held.append(key * 4096 + sizes[at])
            elif key.size:
                found.append((key, 1.0 / (sizes[at] + NULL_WEIGHT), np.ones(key.size)))
            if sum(x.size for x in held) > HELD:
                add_up()
    if held:
        add_up()
    return _merge(found)


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    key, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([p[1] for p in parts]), key.size), np.bincount(place, np.concatenate([p[2] for p in parts]), key.size)


def _by_tables(batch: Batch, linked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same under the tables; only pairs in them have any."""
    sums = np.zeros(batch.table_key.size)
    for source, target in _pairs(batch, linked):
        for key, at, _, n in _cells(batch, source, target):
            place, at = batch.table.find(key, at)
            weight = batch.table_forward[place]
            share = weight / (np.bincount(at, weight, n) + NULL_WEIGHT)[at]
            sums += np.bincount(place, share, sums.size)
    kept = sums > 0
    return batch.table_key[kept], sums[kept], sums[kept]


_COUNTS = "lang string, s bigint, t bigint, n double, c double"


def _count_batches(lexicon_of: Callable[[pa.RecordBatch], Lexicon | Pieces], first: bool, linked: bool):
    """Expected counts of a partition's word pairs, added up over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_number: dict[int, int] = {}
        t_number: dict[tuple, int] = {}
        parts: list[tuple] = []

        def rows() -> Iterator[pa.RecordBatch]:
            key, n, c = _merge(parts)
            parts.clear()
            s_code = np.fromiter(s_number, np.int64, len(s_number))
            t_lang, t_code = pa.array([x[0] for x in t_number], pa.string()), np.array([x[1] for x in t_number], np.int64)
            for at in range(0, key.size, 200_000):
                s, t = np.divmod(key[at : at + 200_000], 1 << 31)
                lang = pa.DictionaryArray.from_arrays(pa.array(np.arange(len(t_lang)), pa.int32()), t_lang).dictionary.take(pa.array(t)) if len(t_lang) else t_lang
                yield pa.RecordBatch.from_arrays([lang, pa.array(s_code[s]), pa.array(t_code[t]), pa.array(n[at : at + 200_000]), pa.array(c[at : at + 200_000])], names=["lang", "s", "t", "n", "c"])

        for record in batches:
            batch = Batch(record, lexicon_of(record))
            key, n, c = _uniform(batch, linked) if first else _by_tables(batch, linked)
            s, t = np.divmod(key, batch.width)
            s_here, s = np.unique(s, return_inverse=True)
            t_here, t = np.unique(t, return_inverse=True)
            s_id = np.array([s_number.setdefault(x, len(s_number)) for x in batch.code[s_here].tolist()], np.int64)
            names = [batch.lang_names[x] for x in (t_here % batch.n_langs).tolist()]
            t_id = np.array([t_number.setdefault(x, len(t_number)) for x in zip(names, batch.code[t_here // batch.n_langs].tolist())], np.int64)
            if key.size:
                parts.append((s_id[s] * (1 << 31) + t_id[t], n, c))
            if sum(p[0].size for p in parts) > HELD:
                merged = _merge(parts)
                parts[:] = [merged]
                if merged[0].size > HELD:
                    yield from rows()
                    s_number.clear()
                    t_number.clear()
        yield from rows()

    return run


def _maximise(counts: DataFrame, first: bool) -> DataFrame:
    """``lang, s, t, forward, backward`` of the pairs that are kept, written once."""
    summed = counts.groupBy("lang", "s", "t").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).persist()
    by_s, by_t = summed.groupBy("lang", "s").agg(F.sum("n").alias("n_s")), summed.groupBy("lang", "t").agg(F.sum("n").alias("n_t"))
    forward, backward = F.col("n") / F.col("n_s"), F.col("n") / F.col("n_t")
    reaches = lambda x, least: F.round(x, 9) >= least  # noqa: E731  (the order of a sum must not decide)
    kept = reaches(F.greatest(forward, backward), MIN_PROBABILITY)
    if first:
        kept = kept | reaches(2 * F.col("c") / (F.col("n_s") + F.col("n_t")), MIN_TOGETHER)
    joined = summed.join(by_s, ["lang", "s"]).join(by_t, ["lang", "t"])
    table = cut_lineage(joined.filter(kept).select("lang", "s", "t", forward.alias("forward"), backward.alias("backward")))
    summed.unpersist()
    return table


def _weights(docs: DataFrame) -> tuple[DataFrame, float]:
    """``side, lang, code, weight`` of words in enough documents (source words without a language), and a rare word's weight."""
    found = lambda side, c: docs.select(F.lit(side).alias("side"), (F.coalesce("lang", F.lit(NO_LANG)) if side else F.lit(NO_LANG)).alias("lang"), F.explode(F.array_distinct(c)).alias("code"))
    n, langs = docs.agg(F.count("*"), F.count_distinct(F.coalesce("lang", F.lit(NO_LANG)))).first()
    log_n = float(np.log(max(n, 2) + 1.0))
    rare = max(0.1, log_n - float(np.log(MIN_DOCUMENTS)))
    counted = found(0, "s_words").unionByName(found(1, "t_words")).groupBy("side", "lang", "code").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCUMENTS)
    weight = F.lit(log_n) - F.when(F.col("side") == 1, float(np.log(max(1, langs)))).otherwise(0.0) - F.log("n")
    return cut_lineage(counted.select("side", "lang", "code", F.least(F.greatest(weight, F.lit(0.05)), F.lit(rare)).alias("weight"))), rare


_NO_TABLE = "lang string, s bigint, t bigint, forward double, backward double"


def _lexicon(weights: pd.DataFrame, table: pd.DataFrame, rare: float) -> Lexicon:
    hashes: dict = {}
    keys = lambda lang, code: code.to_numpy(np.int64) ^ np.array([hashes.setdefault(x, _lang_hash(x)) for x in lang], np.int64)
    source, target = weights[weights.side == 0].sort_values("code"), weights[weights.side == 1]
    key = keys(target.lang, target.code)
    order = np.argsort(key)
    pair_target = keys(table.lang, table.t)
    by = np.lexsort((pair_target, table.s.to_numpy(np.int64)))
    return Lexicon(
        source.code.to_numpy(np.int64), source.weight.to_numpy(float), key[order], target.weight.to_numpy(float)[order], rare,
        table.s.to_numpy(np.int64)[by], pair_target[by], table.forward.to_numpy(np.float32)[by], table.backward.to_numpy(np.float32)[by],
    )


_NO_ROWS = {
    "weights": pd.DataFrame({"side": np.zeros(0, np.int32), "lang": np.zeros(0, object), "code": np.zeros(0, np.int64), "weight": np.zeros(0)}),
    "table": pd.DataFrame({"lang": np.zeros(0, object), "s": np.zeros(0, np.int64), "t": np.zeros(0, np.int64), "forward": np.zeros(0), "backward": np.zeros(0)}),
}


def _pieces(rows: DataFrame, n: int, name: str, rare: float) -> Iterator[Lexicon]:
    """The ``n`` rows of the weights or the table, packed by the executors and fetched one piece after another."""
    most = PIECE

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        given = _NO_ROWS | {name: pa.Table.from_batches(held).to_pandas()}
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_lexicon(**given, rare=rare), pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = most
        for batch in batches:
            while batch.num_rows >= room:
                yield pack([*held, batch.slice(0, room)])
                batch, held, room = batch.slice(room), [], most
            if batch.num_rows:
                held.append(batch)
                room -= batch.num_rows
        if held:
            yield pack(held)

    if n:
        parts = rows.coalesce(1) if n <= most else rows.repartition(-(-n // most))
        for row in parts.mapInArrow(run, "piece binary").toLocalIterator():
            yield pickle.loads(row.piece)


def _with_tables(docs: DataFrame, weights: DataFrame, table: DataFrame | None, rare: float) -> tuple[DataFrame, Callable[[pa.RecordBatch], Lexicon | Pieces], Callable[[], None]]:
    """The documents, how to get a batch's tables, and what to release after use."""
    table = docs.sparkSession.createDataFrame([], _NO_TABLE) if table is None else table
    n_weights, n_pairs = weights.count(), table.count()
    if n_weights + n_pairs <= BROADCAST_ROWS:
        shared = [docs.sparkSession.sparkContext.broadcast(x) for x in chain(_pieces(weights, n_weights, "weights", rare), _pieces(table, n_pairs, "table", rare))]

        def release() -> None:
            for x in shared:
                x.destroy()

        return docs, lambda _: Pieces(shared, rare), release
    # each document gets the rows of its own words
    lang = F.coalesce("lang", F.lit(NO_LANG)).alias("lang")
    words = docs.select("uid", lang, F.explode(F.array_distinct("s_words")).alias("s")).distinct()
    others = docs.select("uid", lang, F.explode(F.array_distinct("t_words")).alias("t")).distinct()
    of_s = words.drop("lang").join(weights.filter("side = 0").withColumnRenamed("code", "s"), "s").select("uid", F.struct("side", "lang", F.col("s").alias("code"), "weight").alias("w"))
    of_t = others.join(weights.filter("side = 1").withColumnRenamed("code", "t"), ["lang", "t"]).select("uid", F.struct("side", "lang", F.col("t").alias("code"), "weight").alias("w"))
    mine = of_s.unionByName(of_t).groupBy("uid").agg(F.collect_list("w").alias("own_weights"))
    pairs = words.join(table, ["lang", "s"]).join(others, ["uid", "lang", "t"])
    tables = pairs.select("uid", F.struct("lang", "s", "t", "forward", "backward").alias("e")).groupBy("uid").agg(F.collect_list("e").alias("own_pairs"))
    joined = docs.join(mine, "uid", "left").join(tables, "uid", "left")

    def own(batch: pa.RecordBatch) -> Lexicon:
        rows = [pd.DataFrame(batch.column(c).flatten().to_pylist(), columns=n).drop_duplicates() for c, n in (("own_weights", ["side", "lang", "code", "weight"]), ("own_pairs", ["lang", "s", "t", "forward", "backward"]))]
        return _lexicon(*rows, rare)

    return joined, own, lambda: None


@dataclass
class Trained:
    """Word weights and translation tables as DataFrames."""

    weights: DataFrame
    rare_weight: float
    table: DataFrame | None = None


def tokenise_documents(texts: DataFrame) -> DataFrame:
    """``texts`` has ``id, lang, source, target``: the two texts of a document and the target's language."""
    both = texts.filter("id is not null and source is not null and target is not null").select(F.xxhash64("id", "lang", "source", "target").alias("uid"), "id", "lang", "source", "target")
    table = look_alike_table()
    return cut_lineage(both.mapInArrow(_tokenise(lambda: transducer(table)), _TOKENISED))


def train_lexicon(docs: DataFrame) -> Trained:
    """Translation tables of all documents of ``tokenise_documents``."""
    weights, rare = _weights(docs)
    trained = Trained(weights, rare)
    for step in range(FIRST_STEPS + LINKED_STEPS):
        given, lexicon_of, release = _with_tables(docs, weights, trained.table, rare)
        counts = given.mapInArrow(_count_batches(lexicon_of, step == 0, step >= FIRST_STEPS), _COUNTS)
        trained.table = _maximise(counts, step == 0)
        release()
    return trained


def _link_batches(lexicon_of: Callable[[pa.RecordBatch], Lexicon | Pieces]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            batch = Batch(record, lexicon_of(record))
            for source, target, score in links(batch):
                source, target = source.astype(np.int64), target.astype(np.int64)
                doc = batch.s.doc_of_sentence[source]
                which = pa.array(doc)
                columns = [record.column("id").take(which), record.column("lang").take(which), pa.array(source - batch.s.first_sentence[doc]), pa.array(target - batch.t.first_sentence[doc]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "source_idx", "target_idx", "score"])

    return run


def link_sentences(docs: DataFrame, trained: Trained) -> DataFrame:
    """``id, lang, source_idx, target_idx, score`` of every accepted link."""
    given, lexicon_of, _ = _with_tables(docs, trained.weights, trained.table, trained.rare_weight)
    return given.mapInArrow(_link_batches(lexicon_of), "id bigint, lang string, source_idx bigint, target_idx bigint, score double")


def align_sentences(texts: DataFrame) -> DataFrame:
    """Links of all documents in ``texts`` (``id, lang, source, target``), with tables trained on them."""
    docs = tokenise_documents(texts)
    return link_sentences(docs, train_lexicon(docs))
