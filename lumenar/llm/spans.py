"""Long verbatim spans shared between records.

First every run of several consecutive sentences, as many as reach the least length, is hashed
(128 bits) and the runs are joined globally: equal runs in two records are a shared span.

A shared span may also be cut anywhere and hold no run of whole sentences, so an exact pass looks
for what the runs leave open. From every sentence start the text to either side is hashed, cut at
half the least span length: a shared span of at least that length around a sentence start holds the
whole half on one side or the other, so no span is missed, even if its own first and last
sentences are cut. Where a stretch has no sentence start for nearly the least length, every word
start in it serves, and without words every position; both texts of a span then have the same
starts inside it, as starts depend only on the characters around them. Only halves that occur in
two records are followed up, with the text around them, and the common text to both sides is
measured exactly. Where only pairs of records are wanted, those that the runs have joined are not
followed up again.

Groups of many equal halves are not paired member by member: equal surroundings are one class, and
classes are matched by the hash of each exact least-length window. How much of a record is shared
follows from its classes; members are paired only for the list of pairs, once per set of records.

Defined results: null and short texts share nothing; fields of one record aren't compared with
each other; of several deliveries the latest counts; repeated texts under several keys are pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.session import cut_lineage

#: Groups of more equal halves than this are matched by classes.
HOT = 64
#: Sentences of a run, at least.
SEVERAL = 2
RUN = 2  # the side of an anchor that is a run

_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+|\n\s*")
_WORD_START = re.compile(r"\s+")


def starts(text: str, least: int) -> list[int]:
    """Positions whose surroundings are hashed."""
    found = [0, *[m.end() for m in _SENTENCE_END.finditer(text)], len(text)]
    out: list[int] = []
    far = least - 12  # room for the characters that make a start
    for a, b in zip(found, found[1:]):
        out.append(a)
        if b - a > far:
            words = [a, *[m.end() for m in _WORD_START.finditer(text, a, b)], b]
            for c, d in zip(words, words[1:]):
                if c > a:
                    out.append(c)
                if d - c > far:
                    out.extend(range(c + 1, d))
    return out


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def runs(text: str, least: int) -> list[tuple[int, int]]:
    """From each sentence start the shortest run of several sentences that reaches the least length."""
    at = [0, *[m.end() for m in _SENTENCE_END.finditer(text)], len(text)]
    ends = [0, *[a + len(text[a:b].rstrip()) for a, b in zip(at, at[1:])]]  # of the sentences before each place, without blanks
    out, k = [], 0
    for i, start in enumerate(at[:-1]):
        k = max(k, i + SEVERAL)
        while k < len(at) and ends[k] - start < least:
            k += 1
        if k >= len(at):
            break
        out.append((start, ends[k]))
    return out


_ANCHOR = "key bigint, check bigint, rid bigint, field int, at int, side int, size int"


def _anchor_batches(half: int, n_fields: int):
    """Hashed runs of sentences, and hashed halves of the least length to both sides of every start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, checks, recs, fields, places, sides, sizes = columns = [], [], [], [], [], [], []
            for f in range(n_fields):
                for rid, text in zip(ids, batch.column(1 + f).to_pylist()):
                    if not text or len(text) < 2 * half:
                        continue
                    found = len(keys)
                    for a, b in runs(text, 2 * half):
                        whole = xxhash.xxh3_128_intdigest(text[a:b].encode("utf-8", "surrogatepass"))
                        keys.append((whole >> 64) - (1 << 63))
                        checks.append((whole & (1 << 64) - 1) - (1 << 63))
                        places.append(a)
                        sizes.append(b - a)
                    sides += [RUN] * (len(keys) - found)
                    for at in starts(text, 2 * half):
                        if at >= half:
                            keys.append(_hash(text[at - half : at], 0))
                            places.append(at)
                            sides.append(0)
                        if at + half <= len(text):
                            keys.append(_hash(text[at : at + half], 1))
                            places.append(at)
                            sides.append(1)
                    recs += [rid] * (len(keys) - found)
                    fields += [f] * (len(keys) - found)
                    checks += [0] * (len(keys) - len(checks))
                    sizes += [0] * (len(keys) - len(sizes))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "check", "rid", "field", "at", "side", "size"])

    return run


_WINDOW = "key bigint, side int, n bigint, rid bigint, field int, at int, left string, right string"


def _window_batches(least: int, n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = [batch.column(2 + f).to_pylist() for f in range(n_fields)]
            for k, (rid, anchors) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for a in anchors:
                    text, at = texts[a["field"]][k], a["at"]
                    rows.append((a["key"], a["side"], a["n"], rid, a["field"], at, text[max(0, at - least) : at], text[at : at + least]))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "side", "n", "rid", "field", "at", "left", "right"])

    return run


def _same(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = np.frombuffer(a[:n].encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b[:n].encode("utf-32-le", "surrogatepass"), np.uint32)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if differ.size else n


def _measure_batches(least: int):
    """Adds the common lengths ``l`` and ``r``; keeps the pairs whose sum reaches the least length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, left, right = [], [], []
            columns = (batch.column(n).to_pylist() for n in ("left_a", "right_a", "left_b", "right_b"))
            for k, (la, ra, lb, rb) in enumerate(zip(*columns)):
                r = _same(ra, rb)
                size = _same(la[::-1], lb[::-1])
                if r + size >= least:
                    keep.append(k)
                    left.append(size)
                    right.append(r)
            rest = [n for n in batch.schema.names if n not in ("left_a", "right_a", "left_b", "right_b")]
            taken = batch.select(rest).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=[*rest, "l", "r"])

    return run


def _class_batches(least: int):
    """Hash of every exact least-length window around the start that holds the hashed half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs, classes = [], []
            for key, side, cls, left, right in zip(*(batch.column(n).to_pylist() for n in ("key", "side", "cls", "left", "right"))):
                half = least // 2
                for i in range(half + 1) if side else range(half, least + 1):
                    if len(left) >= i and len(right) >= least - i:
                        subs.append(_hash(f"{key} {i} {left[len(left) - i :]}{right[: least - i]}", 2))
                        classes.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(subs, pa.int64()), pa.array(classes, pa.struct([("key", pa.int64()), ("check", pa.int64())]))], names=["sub", "cls"])

    return run


def _two(df: DataFrame, on: list[str], rename: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_a" for c in rename}).join(df.withColumnsRenamed({c: f"{c}_b" for c in rename}), on)


@dataclass
class Shared:
    """Shared stretches: of single pairs of places, and of classes of places with equal text around them.

    ``spans`` has ``rid_a, field_a, from_a, to_a, rid_b, field_b, from_b, to_b`` with rid_a < rid_b.
    ``links`` has ``cls_a, cls_b, l, r``: the places of both classes (or of one, if they are the same) share
    ``l`` characters before and ``r`` behind. ``members`` has ``cls, rid, field, at``. None stands for no rows.
    """

    spans: DataFrame | None
    links: DataFrame | None
    members: DataFrame | None

    def cache(self) -> Shared:
        return Shared(*[None if part is None else part.cache() for part in (self.spans, self.links, self.members)])

    def unpersist(self) -> None:
        for part in (self.spans, self.links, self.members):
            if part is not None:
                part.unpersist()


@dataclass
class Anchors:
    """What is hashed of the records, written once."""

    texts: DataFrame
    anchors: DataFrame
    n_fields: int
    least: int


def hash_records(records: DataFrame, key: str, fields: list[str], least: int = 200) -> Anchors:
    """``records`` holds each key once. Fields are numbered in the order of ``fields``."""
    half = (least + 1) // 2
    texts = records.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("rid"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    return Anchors(texts, cut_lineage(texts.mapInArrow(_anchor_batches(half, len(fields)), _ANCHOR)), len(fields), least)


def repeated_runs(hashed: Anchors) -> Shared:
    """Runs of several whole sentences that occur in more than one record."""
    found = hashed.anchors.filter(F.col("side") == RUN)
    common = found.groupBy("key", "check").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).filter("x <> y")
    cls = F.struct("key", "check").alias("cls")
    members = cut_lineage(found.join(common.select("key", "check"), ["key", "check"]).select(cls, "rid", "field", "at", "size"))
    links = members.groupBy("cls").agg(F.max("size").alias("r")).select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(0).alias("l"), "r")
    return Shared(None, links, members.drop("size"))


def exact_spans(hashed: Anchors, known: DataFrame | None = None) -> Shared:
    """Every shared stretch of the least length around a start, whole sentences or not.

    ``known`` (``rid_a, rid_b``) are pairs of records of which nothing more is wanted. A long span is reported in
    overlapping stretches of up to twice the least length around each start; their union is the span.
    """
    least, names = hashed.least, [f"t{i}" for i in range(hashed.n_fields)]
    anchors = hashed.anchors.filter(F.col("side") != RUN).select("key", "rid", "field", "at", "side")
    common = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("x"), F.max("rid").alias("y")).filter("x <> y").select("key", "n")
    shared = anchors.join(common, "key")
    if known is not None:
        shared = cut_lineage(shared)
        cold = shared.filter(F.col("n") <= HOT)
        rids = cold.select("key", "rid").distinct()
        open_ = _two(rids, ["key"], ["rid"]).filter("rid_a < rid_b").join(known, ["rid_a", "rid_b"], "left_anti")
        wanted = open_.select("key", F.explode(F.array("rid_a", "rid_b")).alias("rid")).distinct()
        shared = cold.join(wanted, ["key", "rid"]).unionByName(shared.filter(F.col("n") > HOT))
    per_record = shared.groupBy("rid").agg(F.collect_list(F.struct("key", "side", "n", "field", "at")).alias("anchors"))
    windows = cut_lineage(per_record.join(hashed.texts, "rid").select("rid", "anchors", *names).mapInArrow(_window_batches(least, hashed.n_fields), _WINDOW))

    ends = ["rid", "field", "at", "left", "right"]
    cold = _two(windows.filter(F.col("n") <= HOT).select("key", *ends), ["key"], ends).filter("rid_a < rid_b").drop("key")
    if known is not None:
        cold = cold.join(known, ["rid_a", "rid_b"], "left_anti")
    place = "rid_a bigint, field_a int, at_a int, rid_b bigint, field_b int, at_b int, l int, r int"
    order = ["rid_a", "field_a", "at_a", "rid_b", "field_b", "at_b", "left_a", "right_a", "left_b", "right_b"]
    found = cold.select(*order).mapInArrow(_measure_batches(least), place)
    spans = found.select(
        "rid_a", "field_a", (F.col("at_a") - F.col("l")).alias("from_a"), (F.col("at_a") + F.col("r")).alias("to_a"),
        "rid_b", "field_b", (F.col("at_b") - F.col("l")).alias("from_b"), (F.col("at_b") + F.col("r")).alias("to_b"),
    )

    hot = windows.filter(F.col("n") > HOT)
    if hot.isEmpty():  # then there are no classes, and no need to plan for them
        return Shared(spans, None, None)
    # a class is named by 128 bits of what its members have in common
    hot = hot.withColumn("cls", F.struct(F.xxhash64("key", "left", "right").alias("key"), F.xxhash64(F.lit(7), "right", "left", "key").alias("check")))
    classes = hot.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("key", "side", "left", "right")], F.min("rid").alias("x"), F.max("rid").alias("y"))
    subs = classes.select("key", "side", "cls", "left", "right").mapInArrow(_class_batches(least), "sub bigint, cls struct<key:bigint,check:bigint>")
    lively = subs.groupBy("sub").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("sub")
    between = _two(subs.join(lively, "sub", "left_semi"), ["sub"], ["cls"]).filter("cls_a < cls_b").select("cls_a", "cls_b").distinct()
    within = classes.filter("x <> y").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    sides = classes.select("cls", "left", "right")
    links = (
        between.unionByName(within)
        .join(sides.withColumnsRenamed({"cls": "cls_a", "left": "left_a", "right": "right_a"}), "cls_a")
        .join(sides.withColumnsRenamed({"cls": "cls_b", "left": "left_b", "right": "right_b"}), "cls_b")
        .select("cls_a", "cls_b", "left_a", "right_a", "left_b", "right_b")
        .mapInArrow(_measure_batches(least), "cls_a struct<key:bigint,check:bigint>, cls_b struct<key:bigint,check:bigint>, l int, r int")
    )
    return Shared(spans, links, hot.select("cls", "rid", "field", "at"))


def shared_spans(records: DataFrame, key: str, fields: list[str], least: int = 200) -> Shared:
    """All shared stretches of the records."""
    return exact_spans(hash_records(records, key, fields, least))


def span_pairs(shared: Shared) -> DataFrame:
    """Distinct ``rid_a, rid_b`` (rid_a < rid_b) of records that share a stretch.

    Many classes hold the same records (one for each sentence of a copied text), so classes are
    paired once per set of records: equal count, sum and xor of hashes stand for an equal set.
    """
    if shared.links is None:
        return shared.spans.select("rid_a", "rid_b").distinct()
    rids = shared.members.select("cls", "rid").distinct()
    hashed = F.xxhash64("rid").cast("decimal(20,0)")
    sets = rids.groupBy("cls").agg(F.struct(F.count("*").alias("n"), F.sum(hashed).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("xor")).alias("set"))
    least = sets.groupBy("set").agg(F.min("cls").alias("one"))
    named = sets.join(least, "set").select("cls", "one")
    links = shared.links.select("cls_a", "cls_b").join(named.withColumnsRenamed({"cls": "cls_a", "one": "one_a"}), "cls_a").join(named.withColumnsRenamed({"cls": "cls_b", "one": "one_b"}), "cls_b")
    links = links.select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b")).distinct()
    both = links.join(rids.withColumnsRenamed({"cls": "a", "rid": "rid_a"}), "a").join(rids.withColumnsRenamed({"cls": "b", "rid": "rid_b"}), "b")
    # a class with itself: each pair once; two classes: either may have the smaller record
    ordered = both.filter("rid_a < rid_b or (rid_a > rid_b and a <> b)").select(F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b"))
    return (ordered if shared.spans is None else shared.spans.select("rid_a", "rid_b").unionByName(ordered)).distinct()


def record_pairs(records: DataFrame, key: str, fields: list[str], least: int = 200) -> DataFrame:
    """Distinct ``rid_a, rid_b``: by repeated runs of sentences, then exactly for the pairs these leave open."""
    hashed = hash_records(records, key, fields, least)
    by_runs = cut_lineage(span_pairs(repeated_runs(hashed)))
    return by_runs.unionByName(span_pairs(exact_spans(hashed, by_runs))).distinct()


def _union(intervals: str) -> str:
    """SQL: sorted ``intervals`` merged into disjoint ones."""
    merge = (
        "case when size(acc) > 0 and element_at(acc, -1).to >= x.from then "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', element_at(acc, -1).from, 'to', greatest(element_at(acc, -1).to, x.to)))) "
        "else concat(acc, array(x)) end"
    )
    return f"aggregate(array_sort({intervals}), cast(array() as array<struct<from:int,to:int>>), (acc, x) -> {merge})"


def covered(shared: Shared, later_only: bool = False) -> DataFrame:
    """``rid, field, spans array<struct<from, to>>``: what each field shares, as disjoint stretches.

    ``later_only`` keeps the first record of a shared stretch out. Classes are not expanded to pairs:
    what the places of a class share, and with which first record, holds for each of them.
    """
    parts = []
    if (spans := shared.spans) is not None:
        for end in "b" if later_only else "ab":
            parts.append(spans.select(*[F.col(f"{c}_{end}").alias(c) for c in ("rid", "field", "from", "to")]))
    if shared.links is not None:
        ends = shared.members.groupBy("cls").agg(F.min("rid").alias("first"), F.max("rid").alias("last"))
        links = shared.links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other"), "l", "r")
        links = links.unionByName(shared.links.filter("cls_a <> cls_b").select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other"), "l", "r"))
        reach = links.join(ends.withColumnRenamed("cls", "other"), "other").groupBy("cls", "l", "r").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        places = shared.members.join(reach, "cls").filter("first < rid" if later_only else "first <> rid or last <> rid")
        parts.append(places.select("rid", "field", (F.col("at") - F.col("l")).alias("from"), (F.col("at") + F.col("r")).alias("to")))
    sides = reduce(DataFrame.unionByName, parts)
    return sides.groupBy("rid", "field").agg(F.collect_set(F.struct("from", "to")).alias("spans")).withColumn("spans", F.expr(_union("spans")))


def shared_report(records: DataFrame, spans: Shared, key: str, fields: list[str]) -> DataFrame:
    """``key, n_chars, shared_chars, shared_share`` for every record, shared or not."""
    length = sum((F.coalesce(F.length(f), F.lit(0)) for f in fields[1:]), F.coalesce(F.length(fields[0]), F.lit(0)))
    sizes = records.select(F.col(key), length.cast("bigint").alias("n_chars"))
    chars = F.expr("aggregate(spans, 0L, (acc, x) -> acc + (x.to - x.from))")
    shared = covered(spans).select("rid", chars.alias("c")).groupBy("rid").agg(F.sum("c").alias("shared_chars")).withColumnRenamed("rid", key)
    return sizes.join(shared, key, "left").na.fill(0, ["shared_chars"]).withColumn("shared_share", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))


def _remove_batches(n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in range(n_fields):
                texts = []
                for text, spans in zip(batch.column(2 + f).to_pylist(), batch.column(1).to_pylist()):
                    mine = sorted((s["from"], s["to"]) for x in spans or () if x["field"] == f for s in x["spans"])
                    texts.append(text if not text or not mine else _without(text, mine))
                out.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["rid", *batch.schema.names[2:]])

    return run


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without sentences that lie wholly inside a span."""
    ends = [0, *[m.end() for m in _SENTENCE_END.finditer(text)]]
    kept = []
    for a, b in zip(ends, [*ends[1:], len(text)]):
        body = a + len(text[a:b].rstrip())
        if not any(x <= a and body <= y for x, y in spans):
            kept.append(text[a:b])
    return "".join(kept)


def without_repeats(records: DataFrame, spans: Shared, key: str, fields: list[str]) -> DataFrame:
    """``key`` and ``fields`` with the sentences removed that a record before shares (kept in the first)."""
    later = covered(spans, later_only=True).groupBy("rid").agg(F.collect_list(F.struct("field", "spans")).alias("spans"))
    kind = records.schema[key].dataType.simpleString()
    source = records.join(later.withColumnRenamed("rid", key), key, "left").select(F.col(key).alias("rid"), "spans", *fields)
    out = source.mapInArrow(_remove_batches(len(fields)), f"rid {kind}, " + ", ".join(f"`{f}` string" for f in fields))
    return out.withColumnRenamed("rid", key)
