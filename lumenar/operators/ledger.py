"""Task ledgers: an ordered map from task to true (pending), false (disabled) or a text (done, its output).

A ledger column is ``map<string, variant>``, as ``ledger_of`` reads it from JSON: it keeps the
order of entries and tells true from "true". Text that isn't a JSON object gives null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Step by task; pass your own programs to ``dispatch_plan``. Tasks without one can't be dispatched.
SCRIPTS = {"perform_download": "download", "apply_watermark": "watermark", "generate_captions": "captions", "post_process": "screenshots"}
# The order of the next-task scan.
SCAN_ORDER = ("perform_download", "apply_watermark", "generate_captions", "post_process")


def ledger_of(text: Column) -> Column:
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "map<string,variant>")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def state(value: Column) -> Column:
    """PENDING, DISABLED, DONE, or SKIPPED for any other value; MISSING for none."""
    kind = _kind(value)
    pending = F.try_variant_get(value, "$", "boolean")
    return (
        F.when(value.isNull(), "MISSING")
        .when((kind == "BOOLEAN") & pending, "PENDING")
        .when(kind == "BOOLEAN", "DISABLED")
        .when(kind == "STRING", "DONE")
        .otherwise("SKIPPED")
    )


def output_of(value: Column) -> Column:
    """The output where the task is done, else null."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def entries(df: DataFrame, ledger: str) -> DataFrame:
    """One row per entry, in the ledger's order: ``pos, task, state, output``, with the other columns."""
    rest = [c for c in df.columns if c != ledger]
    spread = df.select(*rest, ledger, F.posexplode(F.map_keys(ledger)).alias("pos", "task"))
    value = F.col(ledger)[F.col("task")]
    return spread.select(*rest, "pos", "task", state(value).alias("state"), output_of(value).alias("output"))


def should_perform(ledger: Column, task: str) -> Column:
    """Whether the task is pending: true itself, not something that counts as true."""
    return state(ledger[task]) == "PENDING"


def existing_output(doc: Column, task: str) -> Column:
    """The document's top-level output of a task, if it is a text."""
    value = F.try_variant_get(doc, f"$.{task}", "variant")
    return output_of(value)


def with_defaults(ledger: Column, defaults: Column) -> Column:
    """Missing tasks appended from ``defaults``; existing entries win."""
    return F.map_concat(ledger, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(ledger, k)))


def with_output(ledger: Column, task: str, output: Column) -> Column:
    """The task's output written in place, or appended; a missing ledger or an empty output changes nothing."""
    value = F.parse_json(F.to_json(F.struct(output.alias("o"))))
    text = F.variant_get(value, "$.o", "variant")
    replaced = F.transform_values(ledger, lambda k, v: F.when(k == task, text).otherwise(v))
    appended = F.map_concat(ledger, F.create_map(F.lit(task), text))
    fits = ledger.isNotNull() & F.coalesce(output != "", F.lit(False))
    return F.when(~fits, ledger).when(F.map_contains_key(ledger, task), replaced).otherwise(appended)


def task_output(named: Column, original: Column, to_process: Column) -> Column:
    """The first of a task's own output, the original file and the file to process that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (named, original, to_process)])


def next_task(ledger: Column, order: tuple[str, ...] = SCAN_ORDER) -> Column:
    """The first pending task in scan order; null if none is."""
    tasks = F.filter(F.array(*[F.lit(t) for t in order]), lambda t: state(ledger[t]) == "PENDING")
    return F.get(tasks, F.lit(0))


def dispatch_plan(df: DataFrame, ledger: str, url: str, to_process: str, scripts: dict[str, str] | None = None) -> DataFrame:
    """Per ledger entry, in order: ``pos, task, script, input, action`` (NO_SCRIPT, RUN, DONE or SKIP)."""
    script = F.create_map(*[F.lit(x) for pair in (scripts or SCRIPTS).items() for x in pair])[F.col("task")]
    rows = entries(df, ledger).withColumn("script", script)
    action = F.when(F.col("script").isNull(), "NO_SCRIPT").when(F.col("state") == "PENDING", "RUN").when(F.col("state") == "DONE", "DONE").otherwise("SKIP")
    given = F.when(F.col("task") == "perform_download", F.col(url)).otherwise(F.col(to_process))
    rest = [c for c in df.columns if c != ledger]
    return rows.select(*rest, "pos", "task", "script", given.alias("input"), action.alias("action"))


def find_by_url(documents: DataFrame, url: str | Column) -> DataFrame:
    """The document of an address; of several, the one with the least path."""
    wanted = documents.filter(F.col("url") == url)
    whole = F.struct("path", *[c for c in documents.columns if c != "path"])
    return wanted.agg(F.min_by(whole, "path").alias("d")).filter("d is not null").select("d.*")


def first_by_url(documents: DataFrame) -> DataFrame:
    """``find_by_url`` for every address at once."""
    whole = F.struct("path", *[c for c in documents.columns if c != "path"])
    return documents.filter("url is not null").groupBy(F.col("url").alias("__lumenar_url")).agg(F.min_by(whole, "path").alias("d")).select("d.*")


def unknown_only(incoming: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``incoming`` whose key isn't in ``known``; rows without a key are kept."""
    return incoming.join(known.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*incoming.columns)


def merge_forward(df: DataFrame, steps: list[tuple[str, Callable[[], Column]]], error_col: str = "errors") -> DataFrame:
    """Steps in order, each adding or replacing a column; a null result keeps what was there and is listed in ``error_col``."""
    failed: list[Column] = []
    for name, make in steps:
        made = make()
        failed.append(F.when(made.isNull(), F.lit(name)))
        df = df.withColumn(f"__lumenar_{len(failed)}", made.isNull())
        df = df.withColumn(name, F.coalesce(made, F.col(name)) if name in df.columns else made)
    marks = [F.when(F.col(f"__lumenar_{i}"), F.lit(name)) for i, (name, _) in enumerate(steps, 1)]
    return df.withColumn(error_col, F.array_compact(F.array(*marks))).drop(*[f"__lumenar_{i}" for i in range(1, len(steps) + 1)])


def vault_moves(documents: DataFrame, ledger: str, path: str, flag: str = "add_watermark") -> DataFrame:
    """Planned moves of finished files: ``json_path, source_path, target_path``.

    A relative output lies beside its document; the target is ``distro/vault`` below that folder.
    """
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    made = output_of(F.col(ledger)[flag])
    source = F.when(made.startswith("/"), made).otherwise(F.concat(folder, F.lit("/"), made))
    target = F.concat(folder, F.lit("/distro/vault/"), F.element_at(F.split(source, "/"), -1))
    return documents.filter(made.isNotNull()).select(F.col(path).alias("json_path"), source.alias("source_path"), target.alias("target_path"))


def load_default_tasks(path: str) -> dict:
    """``default_tasks`` of a settings file, or {}; a missing file raises."""
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("default_tasks", {})


def default_ledger(defaults: dict) -> Column:
    """A settings file's tasks as a ledger column."""
    return ledger_of(F.lit(json.dumps(defaults)))
