"""Deeply nested JSON records to linked flat rows, by vectorised structural indexing.

A batch of texts is laid end to end in one byte buffer. Bitmaps of quotes, brackets and
delimiters are built with numpy, strings are masked out by the parity of unescaped quotes,
nesting depth is a prefix sum of bracket signs, and one sort by (depth, position) links every
token to the bracket that encloses it. No text is walked byte by byte in Python.

Defined results: null, empty, cut-off or otherwise invalid JSON gives no nodes; an empty object
is a node with no fields; a top-level array gives nodes ``[0]``, ``[1]``, …; a repeated key keeps
both occurrences in the count and the last in ``fields``; an object kept as a JSON string counts
as that object, at any depth; a top-level scalar gives nothing. NaN and Infinity are not JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes indexed at once; a longer single text is indexed alone.
CHUNK_BYTES = 1 << 20

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR, START = range(9)
_KINDS = np.full(256, 255, np.uint8)
for _char, _kind in zip(b"{}[]:,", range(6)):
    _KINDS[_char] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = re.compile(rb"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\Z")

NODE_TYPE = T.ArrayType(
    T.StructType([
        T.StructField("node_path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("n_fields", T.IntegerType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ])
)

#: (record, node path, parent path or None at the top, fields that aren't null, scalar fields)
Node = tuple[int, str, "str | None", int, "dict[str, str | None]"]


class StructuralIndex:
    """Tokens of several texts: ``kind``, ``start``, ``stop``, ``rec``, ``parent`` and ``order`` in it."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.texts = texts
        lengths = np.array([len(t) for t in texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.valid = lengths > 0
        self.buffer = b"".join(texts)
        byte = np.frombuffer(self.buffer, np.uint8)
        record = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        if byte.size == 0:
            self.kind = self.start = self.stop = self.rec = self.parent = self.order = np.zeros(0, np.int64)
            return
        quotes, starts_escape = self._quotes(byte)
        inside = self._inside(byte.size, quotes, record)
        self._check_strings(byte, inside, starts_escape, record)
        self._tokens(byte, quotes, inside, record)
        self._link()
        self._check_grammar()

    def _quotes(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of unescaped quotes, and of backslashes that begin an escape."""
        slash = np.flatnonzero(byte == 92)
        quote = np.flatnonzero(byte == 34)
        if slash.size == 0:
            return quote, slash
        begins = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        run = np.repeat(slash[begins], np.diff(np.append(begins, slash.size)))
        escaping = slash[(slash - run) % 2 == 0]
        return quote[~np.isin(quote - 1, escaping, assume_unique=True)], escaping

    def _inside(self, size: int, quotes: np.ndarray, record: np.ndarray) -> np.ndarray:
        """Bitmap of bytes from an opening quote up to before its closing one; parity starts anew in each text."""
        flips = np.zeros(size, np.int8)
        flips[quotes] = 1
        total = np.cumsum(flips, dtype=np.int32)
        before = np.concatenate([[0], total])[self.base]
        ends = np.append(self.base[1:], size)
        self.valid &= (np.concatenate([[0], total])[ends] - before) % 2 == 0
        return ((total - before[record]) & 1).astype(bool)

    def _check_strings(self, byte: np.ndarray, inside: np.ndarray, escaping: np.ndarray, record: np.ndarray) -> None:
        self.valid[record[inside & (byte < 32)]] = False
        if escaping.size:
            after = np.append(byte, np.zeros(6, np.uint8))
            self.valid[record[escaping[~_ESCAPES[after[escaping + 1]]]]] = False
            unicode = escaping[after[escaping + 1] == ord("u")]
            for k in range(2, 6):
                self.valid[record[unicode[~_HEX[after[unicode + k]]]]] = False

    def _tokens(self, byte: np.ndarray, quotes: np.ndarray, inside: np.ndarray, record: np.ndarray) -> None:
        kinds = _KINDS[byte]
        closing = np.zeros(byte.size, bool)
        closing[quotes] = True
        quiet = inside | closing
        marks = np.flatnonzero((kinds != 255) & ~quiet)
        opened = quotes[inside[quotes]]
        closed = quotes[~inside[quotes]]
        good = self.valid[record[opened]]
        opened, closed = opened[good], closed[self.valid[record[closed]]]
        plain = (kinds == 255) & ~quiet & ~_SPACE[byte]
        same = np.concatenate([[False], plain[:-1] & (record[1:] == record[:-1])])
        begins = np.flatnonzero(plain & ~same)
        following = np.concatenate([plain[1:] & (record[1:] == record[:-1]), [False]])
        ends = np.flatnonzero(plain & ~following) + 1
        start = np.concatenate([marks, opened, begins])
        stop = np.concatenate([marks + 1, closed + 1, ends])
        kind = np.concatenate([kinds[marks], np.full(opened.size, STRING, np.uint8), np.full(begins.size, SCALAR, np.uint8)])
        order = np.argsort(start, kind="stable")
        self.start, self.stop, self.kind = start[order], stop[order], kind[order].astype(np.int64)
        self.rec = record[self.start].astype(np.int64)
        self._keep_valid()
        verdict: dict[bytes, bool] = {}
        for i in np.flatnonzero(self.kind == SCALAR):
            text = self.buffer[self.start[i] : self.stop[i]]
            ok = verdict.get(text)
            if ok is None:
                ok = verdict[text] = _SCALAR.match(text) is not None
            if not ok:
                self.valid[self.rec[i]] = False
        self._keep_valid()

    def _keep_valid(self) -> None:
        keep = self.valid[self.rec]
        self.start, self.stop, self.kind, self.rec = self.start[keep], self.stop[keep], self.kind[keep], self.rec[keep]

    def _depth(self) -> np.ndarray:
        opens = (self.kind == OPEN_OBJ) | (self.kind == OPEN_ARR)
        closes = (self.kind == CLOSE_OBJ) | (self.kind == CLOSE_ARR)
        total = np.cumsum(opens.astype(np.int64) - closes)
        first = np.concatenate([[True], self.rec[1:] != self.rec[:-1]])
        floor = np.concatenate([[0], total])[np.flatnonzero(first)]
        after = total - np.repeat(floor, np.diff(np.append(np.flatnonzero(first), self.rec.size)))
        self.last_of_rec = np.concatenate([self.rec[1:] != self.rec[:-1], [True]])
        self.valid[self.rec[after < 0]] = False
        self.valid[self.rec[self.last_of_rec & (after != 0)]] = False
        return after - opens

    def _link(self) -> None:
        """Parent token (-1 at the top) and number of earlier commas in it, of every token."""
        if self.kind.size:
            self._depth()
            self._keep_valid()
        self.parent = np.full(self.kind.size, -1, np.int64)
        self.order = np.zeros(self.kind.size, np.int64)
        seen = np.zeros(len(self.texts), bool)
        seen[self.rec] = True
        self.valid &= seen
        if not self.kind.size:
            return
        level = self._depth()
        token = np.arange(self.kind.size)
        opens = token[(self.kind == OPEN_OBJ) | (self.kind == OPEN_ARR)]
        # each opening bracket stands once among its siblings and once before its children
        who = np.concatenate([opens, token])
        key = np.concatenate([level[opens] + 1, level])
        heads = np.concatenate([np.ones(opens.size, bool), np.zeros(token.size, bool)])
        closes = (self.kind == CLOSE_OBJ) | (self.kind == CLOSE_ARR)
        key[opens.size :][closes] += 1  # a closing bracket belongs to what it closes
        order = np.lexsort((~heads, who, key))
        who, key, heads = who[order], key[order], heads[order]
        at = np.maximum.accumulate(np.where(heads | (key == 0), np.arange(who.size), 0))
        parent = np.where(key == 0, -1, who[at])
        commas = np.cumsum((self.kind[who] == COMMA) & ~heads)
        member = ~heads
        self.parent[who[member]] = parent[member]
        self.order[who[member]] = (commas - commas[at])[member] - ((self.kind[who] == COMMA)[member])

    def _check_grammar(self) -> None:
        """Adjacent tokens, and what encloses them, decide whether a text is complete JSON."""
        if not self.kind.size:
            return
        kind, rec = self.kind, self.rec
        first = np.concatenate([[True], rec[1:] != rec[:-1]])
        prev = np.concatenate([[START], kind[:-1]])
        prev[first] = START
        after = np.concatenate([kind[1:], [START]])
        after[self.last_of_rec] = START
        inside = np.where(self.parent >= 0, kind[np.maximum(self.parent, 0)], START)
        opener = (kind == OPEN_OBJ) | (kind == OPEN_ARR)
        ended = np.isin(prev, (CLOSE_OBJ, CLOSE_ARR, STRING, SCALAR))
        self.key = (kind == STRING) & (inside == OPEN_OBJ) & ((prev == OPEN_OBJ) | (prev == COMMA))
        prev_key = np.concatenate([[False], self.key[:-1]])
        value = (opener | (kind == STRING) | (kind == SCALAR)) & ~self.key
        self.value = value
        ok = np.ones(kind.size, bool)
        ok &= ~value | np.where(inside == OPEN_OBJ, prev == COLON, np.where(inside == OPEN_ARR, (prev == OPEN_ARR) | (prev == COMMA), prev == START))
        ok &= ~self.key | (after == COLON)
        ok &= (kind != COLON) | (prev_key & (inside == OPEN_OBJ))
        ok &= (kind != COMMA) | (ended & (inside != START))
        ok &= (kind != CLOSE_OBJ) | ((inside == OPEN_OBJ) & (ended | (prev == OPEN_OBJ)))
        ok &= (kind != CLOSE_ARR) | ((inside == OPEN_ARR) & (ended | (prev == OPEN_ARR)))
        self.valid[rec[~ok]] = False

    def text(self, token: int) -> bytes:
        return self.buffer[self.start[token] : self.stop[token]]


def _string(raw: bytes) -> str:
    return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")


def nodes_of(texts: Sequence[str | None], with_fields: bool = True) -> list[Node]:
    """Objects of each text, in document order per nesting pass."""
    found: list[Node] = []
    todo: list[tuple[int, str, str | None, bytes]] = [(i, "", None, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if t]
    while todo:
        later: list[tuple[int, str, str | None, bytes]] = []
        chunk: list[tuple[int, str, str | None, bytes]] = []
        size = 0
        for item in todo:
            chunk.append(item)
            size += len(item[3])
            if size >= CHUNK_BYTES:
                _chunk_nodes(chunk, with_fields, found, later)
                chunk, size = [], 0
        if chunk:
            _chunk_nodes(chunk, with_fields, found, later)
        todo = later
    return found


def _chunk_nodes(chunk: list[tuple[int, str, str | None, bytes]], with_fields: bool, found: list[Node], later: list) -> None:
    index = StructuralIndex([t for *_, t in chunk])
    kind = index.kind
    if not kind.size:
        return
    live = index.valid[index.rec]
    null_byte = np.frombuffer(index.buffer, np.uint8)[index.start] == ord("n")
    in_object = np.where(index.parent >= 0, kind[np.maximum(index.parent, 0)] == OPEN_OBJ, False)
    nonnull = live & index.value & in_object & ~((kind == SCALAR) & null_byte)
    count = np.bincount(index.parent[nonnull], minlength=kind.size)
    maybe_object = np.zeros(kind.size, bool)
    strings = np.flatnonzero(live & index.value & (kind == STRING))
    second = np.frombuffer(index.buffer, np.uint8)[index.start[strings] + 1]
    maybe_object[strings[(second == ord("{")) | _SPACE[second] | (second == ord("\\"))]] = True
    wanted = live & index.value & ((kind == OPEN_OBJ) | (kind == OPEN_ARR) | maybe_object)
    if with_fields:
        wanted |= live & index.value & in_object
    paths: dict[int, str] = {}
    owner: dict[int, str | None] = {}  # path of the nearest object at or above
    fields: dict[int, dict[str, str | None]] = {}
    rows: list[int] = []
    for t in np.flatnonzero(wanted).tolist():
        rec, prefix, above, _ = chunk[index.rec[t]]
        p = int(index.parent[t])
        key = None
        if p < 0:
            path, parent = prefix, above
        else:
            parent = owner[p]
            if kind[p] == OPEN_OBJ:
                key = _string(index.text(t - 2))
                path = f"{paths[p]}.{key}" if paths[p] else key
            else:
                path = f"{paths[p]}[{index.order[t]}]"
        k = kind[t]
        if k == OPEN_OBJ:
            paths[t] = owner[t] = path
            fields[t] = {}
            rows.append(t)
            found.append((rec, path, parent, int(count[t]), fields[t]))
        elif k == OPEN_ARR:
            paths[t], owner[t] = path, parent
        else:
            raw = index.text(t)
            if k == STRING and maybe_object[t]:
                inner = _string(raw)
                if inner.lstrip(" \t\n\r")[:1] == "{" or (p < 0 and inner):
                    later.append((rec, path, parent, inner.encode("utf-8", "surrogatepass")))
            if with_fields and key is not None:
                fields[p][key] = _string(raw) if k == STRING else None if raw == b"null" else raw.decode()
    return


def index_nested(df: DataFrame, json_col: str, out: str = "nodes", with_fields: bool = True) -> DataFrame:
    """Add ``out``: the objects of ``json_col`` as an array of linked nodes; all other columns are kept.

    A node has ``node_path`` (keys joined by ``.``, list places ``[i]``, nulls counted; the top is
    ``''``), ``parent_path`` of the nearest object above (null at the top), ``n_fields``, the number
    of its fields that aren't null, and ``fields``, its scalar fields as text. Rows stay as many as
    they are; the array is empty where the text gives nothing.
    """
    if out in df.columns:
        raise ValueError(f"column exists already: {out}")
    slot = "__lumenar_json"
    carried = [c for c in df.columns if c != json_col]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{json_col}`").alias(slot))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, NODE_TYPE)])
    node_type = pa.list_(pa.struct([("node_path", pa.string()), ("parent_path", pa.string()), ("n_fields", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(slot).to_pylist()
            per: list[list] = [[] for _ in texts]
            for rec, path, parent, n, fields in nodes_of(texts, with_fields):
                per[rec].append((path, parent, n, list(fields.items())))
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, _node_array(per, node_type)], names=[*carried, out])

    return source.mapInArrow(run, schema)


def _node_array(per: list[list], node_type: pa.DataType) -> pa.Array:
    flat = [n for nodes in per for n in nodes]
    offsets = np.concatenate([[0], np.cumsum([len(n) for n in per])]).astype(np.int32)
    struct = node_type.value_type
    maps = pa.array([n[3] for n in flat], struct.field("fields").type)
    values = pa.StructArray.from_arrays(
        [pa.array([n[0] for n in flat], pa.string()), pa.array([n[1] for n in flat], pa.string()), pa.array([n[2] for n in flat], pa.int32()), maps],
        fields=[struct.field(i) for i in range(4)],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def explode_nodes(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """One row per node, with ``collection`` (its path without list places: the flat table it belongs to) and ``ordinal``.

    Columns of these names in ``df`` raise ValueError.
    """
    clash = set(df.columns) & {"node_path", "parent_path", "n_fields", "fields", "collection", "ordinal"}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    rest = [F.col(f"`{c}`") for c in df.columns if c != nodes]
    node = F.col("__lumenar_node")
    return (
        df.select(*rest, F.explode(F.col(f"`{nodes}`")).alias("__lumenar_node"))
        .select(*rest, node.node_path.alias("node_path"), node.parent_path.alias("parent_path"), node.n_fields.alias("n_fields"), node.fields.alias("fields"))
        .withColumn("collection", F.regexp_replace("node_path", r"\[\d+\]", ""))
        .withColumn("ordinal", F.expr(r"try_cast(regexp_extract(node_path, '\\[(\\d+)\\]$', 1) as int)"))
    )
