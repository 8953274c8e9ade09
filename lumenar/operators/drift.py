"""Schemas that drift between the files of a feed: the list of changes, and one steady table.

Each file's schema is a tree of fields with types, gathered by a distributed aggregate. Between a
file and the one before it the minimum-cost edit script of the two trees is computed: matching
labels are kept (or retyped), the rest is assigned by a minimum-cost matching in which renaming
is only open to a pair whose values agree in records both files hold, and deleted and added
subtrees left over at other places may be moved on the same evidence. Scripts are then compiled
into per-file projections from today's path to the field's first name.

Defined results: a payload that isn't a complete JSON object has no fields; a field counts as
present if one record has it non-null; a file whose predecessor is missing has no changes; mixed
types of one field in one file count as the commonest (ties: the first by name); records without
a scalar ``id`` give no evidence for renaming; repeated deliveries change nothing; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.session import cut_lineage

# Costs of the edit operations. A rename is cheaper than a removal and an addition.
COST_ADD = COST_REMOVE = 1.0
COST_RETYPE = 0.5
COST_RENAME = 0.6
COST_MOVE = 0.9
_NEVER = 1e9

Evidence = dict[tuple[str, str], tuple[int, int]]
Change = tuple[str, str, str]


def type_name(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string", int: "integer", float: "fractional"}[type(value)]


def fields_of(payload: str | None) -> dict[str, object] | None:
    """Non-null fields of a record by path, objects included; None where it is no complete object."""
    if not payload:
        return None
    try:
        top = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, object] = {}
    todo: list[tuple[str, dict]] = [("", top)]
    while todo:
        prefix, node = todo.pop()
        for key, value in node.items():
            if value is not None:
                path = f"{prefix}.{key}" if prefix else key
                out[path] = value
                if isinstance(value, dict):
                    todo.append((path, value))
    return out


def _without_nulls(value: object) -> object:
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def _value_text(value: object) -> str:
    return json.dumps(_without_nulls(value), sort_keys=True, ensure_ascii=False)


def _record_id(fields: dict[str, object]) -> str | None:
    value = fields.get("id")
    return None if value is None or isinstance(value, (dict, list)) else _value_text(value)


# ---------------------------------------------------------------- tree edit distance


def _min_assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost assignment (shortest augmenting paths); rows <= columns."""
    n, m = len(cost), len(cost[0])
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


class _Tree:
    def __init__(self, types: dict[str, str]) -> None:
        self.types = types
        self.children: dict[str, list[str]] = {}
        self.size: dict[str, int] = {}
        for path in sorted(types, key=lambda p: (p.count("."), p)):
            parent = path.rpartition(".")[0]
            while parent and types.get(parent) != "object":
                parent = parent.rpartition(".")[0]
            self.children.setdefault(parent, []).append(path)
        for path in sorted(types, key=lambda p: -p.count(".")):
            self.size[path] = 1 + sum(self.size[c] for c in self.children.get(path, ()))


def _label(path: str, parent: str) -> str:
    return path[len(parent) + 1 :] if parent else path


def _kept(evidence: Evidence, old: str, new: str) -> float:
    """Share of common records whose value is the same under both paths; 0 without evidence."""
    agree, both = evidence.get((old, new), (0, 0))
    return agree / both if agree and 2 * agree >= both else 0.0


def edit_script(old: dict[str, str], new: dict[str, str], evidence: Evidence) -> tuple[float, list[Change]]:
    """Cost and changes (path, kind, new path or '') of the minimum-cost script from ``old`` to ``new``."""
    a, b = _Tree(old), _Tree(new)

    def pair(x: str, y: str) -> tuple[float, list[Change], list[str], list[str]]:
        if old[x] != new[y]:
            return COST_RETYPE, [(x, "retyped", "")], [], []
        return forest(x, y) if old[x] == "object" else (0.0, [], [], [])

    def pair_match(rest_x: list[str], rest_y: list[str], price: float) -> list[tuple[str, str, float]]:
        """Pairs of the minimum-cost matching of what could be renamed or moved."""
        size = len(rest_x) + len(rest_y)
        cost = [[_NEVER] * size for _ in range(size)]
        for i, x in enumerate(rest_x):
            for j, y in enumerate(rest_y):
                share = _kept(evidence, x, y) if old[x] == new[y] else 0.0
                if share:
                    cost[i][j] = price - 1e-3 * share - 1e-6 * min(evidence[(x, y)][0], 999)
            for j in range(len(rest_y), size):
                cost[i][j] = COST_REMOVE * a.size[x]
        for i in range(len(rest_x), size):
            for j, y in enumerate(rest_y):
                cost[i][j] = COST_ADD * b.size[y]
            for j in range(len(rest_y), size):
                cost[i][j] = 0.0
        chosen = _min_assignment(cost)
        return [(x, rest_y[chosen[i]], price) for i, x in enumerate(rest_x) if chosen[i] < len(rest_y) and cost[i][chosen[i]] < _NEVER]

    def forest(px: str, py: str) -> tuple[float, list[Change], list[str], list[str]]:
        left = {_label(c, px): c for c in a.children.get(px, ())}
        right = {_label(c, py): c for c in b.children.get(py, ())}
        total, changes, gone, come = 0.0, [], [], []
        for label in sorted(left.keys() & right.keys()):
            cost, c, g, n = pair(left[label], right[label])
            total, changes, gone, come = total + cost, changes + c, gone + g, come + n
        rest_x = [left[k] for k in sorted(left.keys() - right.keys())]
        rest_y = [right[k] for k in sorted(right.keys() - left.keys())]
        if rest_x and rest_y:
            for x, y, price in pair_match(rest_x, rest_y, COST_RENAME):
                rest_x.remove(x)
                rest_y.remove(y)
                total += price
                changes.append((x, "renamed", y))
        return total, changes, gone + rest_x, come + rest_y

    total, changes, gone, come = forest("", "")
    if gone and come:
        for x, y, price in pair_match(gone, come, COST_MOVE):
            gone.remove(x)
            come.remove(y)
            total += price
            changes.append((x, "renamed", y))
    total += sum(COST_REMOVE * a.size[x] for x in gone) + sum(COST_ADD * b.size[y] for y in come)
    changes += [(x, "removed", "") for x in gone] + [(y, "added", "") for y in come]
    return total, sorted(changes)


# ---------------------------------------------------------------- distributed steps


def _batch_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple, int] = {}
        for feed, file_no, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            fields = fields_of(payload)
            if fields is None:
                counts[(feed, file_no, None, None)] = 0
                continue
            counts.setdefault((feed, file_no, None, None), 0)
            for path, value in fields.items():
                key = (feed, file_no, path, type_name(value))
                counts[key] = counts.get(key, 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["feed", "file_no", "path", "kind", "n"],
        )


def file_schemas(records: DataFrame) -> DataFrame:
    """``feed, file_no, fields array<struct<path, kind>>``: one row per file, empty files included.

    Counted per batch in Python, then summed: what is shuffled grows with files times fields, not records.
    """
    slim = records.filter("feed is not null and file_no is not null").select("feed", F.col("file_no").cast("bigint").alias("file_no"), "payload")
    counted = slim.mapInArrow(_batch_schemas, "feed string, file_no bigint, path string, kind string, n bigint")
    by_kind = counted.groupBy("feed", "file_no", "path", "kind").agg(F.sum("n").alias("n"))
    return (
        by_kind.groupBy("feed", "file_no", "path")
        .agg(F.min(F.struct(-F.col("n"), F.col("kind"))).alias("top"))
        .groupBy("feed", "file_no")
        .agg(F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", F.col("top.kind").alias("kind"))))).alias("fields"))
    )


def _file_pairs(schemas: DataFrame) -> DataFrame:
    """Each file beside the one before it, where they differ."""
    before = schemas.select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("fields").alias("old_fields"))
    return before.join(schemas.withColumnRenamed("fields", "new_fields"), ["feed", "file_no"]).filter("old_fields <> new_fields")


def _batch_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for feed, pair, side, wanted, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
            fields = fields_of(payload)
            rid = None if fields is None else _record_id(fields)
            if rid is None:
                continue
            for path in wanted:
                if path in fields:
                    digest = hashlib.md5(_value_text(fields[path]).encode("utf-8", "surrogatepass")).digest()
                    rows.append((feed, pair, side, rid, path, digest))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary()))],
            names=["feed", "file_no", "side", "rid", "path", "digest"],
        )


def rename_evidence(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``feed, file_no, old_path, new_path, agree, both``: how often common records keep a removed field's value under an added one.

    Only records of files that both lost and gained a field are read for it, and only those fields.
    """
    old_paths, new_paths = F.transform("old_fields", lambda f: f.path), F.transform("new_fields", lambda f: f.path)
    moved = pairs.select("feed", "file_no", F.array_except(old_paths, new_paths).alias("gone"), F.array_except(new_paths, old_paths).alias("come")).filter("size(gone) > 0 and size(come) > 0")
    wanted = moved.select("feed", (F.col("file_no") - 1).alias("at"), F.col("file_no").alias("pair"), F.lit(0).alias("side"), F.col("gone").alias("wanted")).unionByName(
        moved.select("feed", F.col("file_no").alias("at"), F.col("file_no").alias("pair"), F.lit(1).alias("side"), F.col("come").alias("wanted"))
    )
    slim = records.select("feed", F.col("file_no").cast("bigint").alias("at"), "payload")
    values = (
        slim.join(wanted, ["feed", "at"])
        .select("feed", "pair", "side", "wanted", "payload")
        .mapInArrow(_batch_values, "feed string, file_no bigint, side int, rid string, path string, digest binary")
        .groupBy("feed", "file_no", "rid")
        .agg(*[F.collect_set(F.when(F.col("side") == side, F.struct("path", "digest"))).alias(name) for side, name in ((0, "old"), (1, "new"))])
        .filter("size(old) > 0 and size(new) > 0")
    )
    both = values.select("feed", "file_no", "rid", F.explode("old").alias("o"), "new").select("feed", "file_no", "rid", "o", F.explode("new").alias("n"))
    return (
        both.groupBy("feed", "file_no", "rid", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"))
        .agg(F.max((F.col("o.digest") == F.col("n.digest")).cast("int")).alias("same"))
        .groupBy("feed", "file_no", "old_path", "new_path")
        .agg(F.sum("same").alias("agree"), F.count("*").alias("both"))
    )


def _batch_scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for feed, file_no, old, new, proof in zip(*(batch.column(i).to_pylist() for i in range(5))):
            evidence = {(e["old_path"], e["new_path"]): (e["agree"], e["both"]) for e in proof or ()}
            _, changes = edit_script({f["path"]: f["kind"] for f in old}, {f["path"]: f["kind"] for f in new}, evidence)
            rows += [(feed, file_no, *c) for c in changes]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=["feed", "file_no", "field_path", "change_kind", "new_path"],
        )


def schema_changes(records: DataFrame) -> DataFrame:
    """``feed, file_no, field_path, change_kind, new_path`` of every change from the file before.

    ``records`` needs ``feed, file_no, payload``; any other column is ignored.
    """
    pairs = cut_lineage(_file_pairs(cut_lineage(file_schemas(records))))
    proof = rename_evidence(records, pairs).groupBy("feed", "file_no").agg(F.collect_list(F.struct("old_path", "new_path", "agree", "both")).alias("proof"))
    return (
        pairs.join(proof, ["feed", "file_no"], "left")
        .select("feed", "file_no", "old_fields", "new_fields", "proof")
        .mapInArrow(_batch_scripts, "feed string, file_no bigint, field_path string, change_kind string, new_path string")
    )


def _lineage(changes: list[dict]) -> list[tuple[int, str, str]]:
    """(first file, path in it, first name) whenever a feed's renames change what a path stands for.

    A field added under a name that a renamed field still holds is called after its file too: ``a@5``.
    """
    first: dict[str, str] = {}
    out: list[tuple[int, str, str]] = []
    for c in sorted(changes, key=lambda c: (c["file_no"], c["change_kind"] != "removed", c["change_kind"], c["field_path"])):
        path, new = c["field_path"], c["new_path"]
        if c["change_kind"] == "renamed":
            for at, name in [(p, n) for p, n in first.items() if p.startswith(f"{path}.")]:
                first[f"{new}{at[len(path):]}"] = name
                out.append((c["file_no"], f"{new}{at[len(path):]}", name))
                del first[at]
            name = first.pop(path) if path in first else _renamed_prefix(first, path)
            first[new] = name
            out.append((c["file_no"], new, first[new]))
        elif c["change_kind"] == "removed":
            for at in [p for p in first if p == path or p.startswith(f"{path}.")]:
                del first[at]
        elif c["change_kind"] == "added":
            taken = any(p != n and (n == path or n.startswith(f"{path}.") or path.startswith(f"{n}.")) for p, n in first.items())
            first[path] = f"{path}@{c['file_no']}" if taken else path
            out.append((c["file_no"], path, first[path]))
    return out


def _renamed_prefix(first: dict[str, str], path: str) -> str:
    """First name of a path that itself was never renamed but lies in an object that was."""
    head = path
    while head := head.rpartition(".")[0]:
        if head in first:
            return first[head] + path[len(head) :]
    return path


_NAMES = "array<struct<path:string,name:string>>"


def compile_projections(changes: DataFrame) -> DataFrame:
    """``feed, since, until, names``: what each path is called from a file on until the next change, compiled from the edit scripts.

    Grows with a feed's changes, not its records. Paths that keep their own name aren't listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for feed, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names: dict[str, str] = {}
                rules: dict[int, dict[str, str]] = {}
                for since, path, name in _lineage(listed):
                    rules.setdefault(since, {})[path] = name
                steps = sorted(rules)
                for since, until in zip(steps, [*steps[1:], None]):
                    names |= rules[since]
                    rows.append((feed, since, until, [{"path": p, "name": n} for p, n in names.items() if p != n]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("path", pa.string()), ("name", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["feed", "since", "until", "names"])

    per_feed = changes.groupBy("feed").agg(F.collect_list(F.struct("file_no", "field_path", "change_kind", "new_path")).alias("changes"))
    return per_feed.mapInArrow(run, f"feed string, since bigint, until bigint, names {_NAMES}")


def project_record(payload: str | None, names: dict[str, str]) -> dict[str, str] | None:
    """Scalar and array fields of a record under their first names, as text; of two with one name the later keeps its path too."""
    fields = fields_of(payload)
    if fields is None:
        return None
    out: dict[str, str] = {}
    for path, value in fields.items():
        if not isinstance(value, dict):
            name = names.get(path) or _renamed_prefix(names, path)
            name = f"{name}@{path}" if name in out else name
            out.setdefault(name, value if isinstance(value, str) else _value_text(value))
    return out


def steady_table(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Every record once, under steady names: ``feed, file_no, rec_no, values map<first name, text>``.

    The latest delivery of a (feed, file_no, rec_no) counts; records that aren't complete JSON
    objects have a null map. Each file's projection is looked up once and joined by (feed, file).
    """
    keys = ["feed", "file_no", "rec_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            maps = [project_record(p, {x["path"]: x["name"] for x in names or ()}) for p, names in zip(col["payload"], col["names"])]
            maps = [None if m is None else list(m.items()) for m in maps]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(maps, pa.map_(pa.string(), pa.string()))], names=[*keys, "arrived_at", "values"])

    slim = records.filter("feed is not null and file_no is not null").select("feed", F.col("file_no").cast("bigint").alias("file_no"), F.col("rec_no").cast("bigint").alias("rec_no"), "arrived_at", "payload")
    files = slim.select("feed", "file_no").distinct()
    versions = compile_projections(changes)
    current = files.join(versions, "feed").filter("file_no >= since and (until is null or file_no < until) and size(names) > 0").select("feed", "file_no", "names")
    projected = slim.join(current, ["feed", "file_no"], "left").select(*keys, "arrived_at", "payload", "names").mapInArrow(
        run, "feed string, file_no bigint, rec_no bigint, arrived_at timestamp, values map<string,string>"
    )
    entries = projected.withColumn("values", F.map_entries("values"))
    latest = entries.groupBy(*keys).agg(F.max_by(F.struct("values"), F.coalesce("arrived_at", F.lit("1900-01-01").cast("timestamp"))).alias("last"))
    return latest.select(*keys, F.map_from_entries("last.values").alias("values"))
