"""Sinks: what queries plan is written here, one place per kind of output."""

from __future__ import annotations

import getpass
import json
import logging
import os
import platform
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sidecar_path(original: Column) -> Column:
    """``stem.json`` beside a file; null for a missing or empty name."""
    return F.concat(F.regexp_replace(F.nullif(original, F.lit("")), r"\.[^./]*$", ""), F.lit(".json"))


def sidecar_documents(df: DataFrame, original: str = "original_filename") -> DataFrame:
    """``config_json, body``: each row as JSON text with the path it belongs to; rows without a file name are left out."""
    return df.select(sidecar_path(F.col(original)).alias("config_json"), F.to_json(F.struct(*df.columns)).alias("body")).filter("config_json is not null")


def write_files(df: DataFrame, path: str, body: str) -> None:
    """One file per row, by its executor; folders are made, a file is replaced whole."""

    def write(rows) -> None:  # noqa: ANN001
        for row in rows:
            target = Path(row[path])
            target.parent.mkdir(parents=True, exist_ok=True)
            content = row[body]
            part = target.with_name(f".{target.name}.part")
            part.write_bytes(content if isinstance(content, (bytes, bytearray)) else content.encode("utf-8"))
            os.replace(part, target)

    df.select(path, body).filter(F.col(path).isNotNull() & F.col(body).isNotNull()).foreachPartition(write)


def copy_files(plan: DataFrame, source: str, target: str, move: bool = False) -> None:
    """Carries out a plan of copies or moves; a missing source is skipped."""

    def run(rows) -> None:  # noqa: ANN001
        for row in rows:
            if os.path.exists(row[source]):
                os.makedirs(os.path.dirname(row[target]), exist_ok=True)
                (shutil.move if move else shutil.copyfile)(row[source], row[target])

    plan.select(source, target).filter(F.col(source).isNotNull() & F.col(target).isNotNull()).foreachPartition(run)


def backup_plan(df: DataFrame, config: str = "config_json", backup: str = "./metadata") -> DataFrame:
    """``source_path, target_path`` of documents to copy into the backup folder."""
    name = F.element_at(F.split(F.col(config), "/"), -1)
    return df.filter(F.col(config).isNotNull()).select(F.col(config).alias("source_path"), F.concat(F.lit(f"{backup}/"), name).alias("target_path"))


def article_outputs(pages: DataFrame, slug: str, plain: str, marked: str, html: str, folder: str) -> DataFrame:
    """``path, body``: plain text, text with emphasis and the page itself, three files per page."""
    kinds = ((plain, ".txt"), (marked, "_italics.txt"), (html, ".html"))
    parts = F.array(*[F.struct(F.concat(F.lit(f"{folder}/"), F.col(slug), F.lit(end)).alias("path"), F.col(c).alias("body")) for c, end in kinds])
    return pages.select(F.explode(parts).alias("f")).select("f.*").filter("body is not null")


def clip_document(clips: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """``body``: one document of clip lists by name, in order; JSON, which YAML readers read as well.

    A single value, for lists that fit in one file.
    """
    entry = F.struct(F.col(order).alias("o"), F.struct("start", "end", "text").alias("clip"))
    lists = clips.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.clip).alias("clips"))
    return lists.select(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "clips"))))).alias("body"))


def merge_clip_file(path: str, clips: dict) -> None:
    """The clip lists of a YAML file with ``clips`` laid over them by name, written back in order.

    Without a YAML library the file must hold JSON, which YAML readers read as well; other text is a ValueError.
    """
    try:
        import yaml
    except ImportError:
        yaml = None
    target = Path(path)
    text = target.read_text(encoding="utf-8") if target.exists() else ""
    held = (yaml.safe_load(text) if yaml else json.loads(text) if text.strip() else None) or {}
    held.update(clips)
    made = yaml.dump(held, default_flow_style=False, sort_keys=False, allow_unicode=True) if yaml else json.dumps(held, ensure_ascii=False, indent=2)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(made, encoding="utf-8")
    os.replace(part, target)


def save_clip_files(df: DataFrame, path: str, body: str) -> None:
    """Merges each row's clip lists (JSON text) into the file it names; a file belongs to one row."""

    def write(rows) -> None:  # noqa: ANN001
        for row in rows:
            merge_clip_file(row[path], json.loads(row[body]))

    df.select(path, body).filter(F.col(path).isNotNull() & F.col(body).isNotNull()).foreachPartition(write)


def transcripts_map(df: DataFrame, path: str, text: str) -> DataFrame:
    """One JSON object of texts by path: a single value, for sets that fit in one file."""
    return df.select(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(path, text))))).alias("transcripts"))


def write_text(df: DataFrame, column: str, folder: str) -> None:
    """A text column as text files, distributed."""
    df.select(column).write.mode("overwrite").text(folder)


def run_manifest(urls: list[str], config: dict) -> dict:
    """What a run was started with, and where."""
    from importlib.metadata import distributions

    return {
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "user": getpass.getuser(),
        "host": platform.node(),
        "platform": platform.platform(),
        "urls": list(urls),
        "config": config,
        "packages": sorted(f"{d.metadata['Name']}=={d.version}" for d in distributions()),
    }


def write_manifest(manifest: dict, path: str) -> None:
    Path(path).write_text(json.dumps(manifest, ensure_ascii=False, indent=2), encoding="utf-8")


def initialise_logging(path: str, name: str = "lumenar") -> logging.Logger:
    """A logger with everything in a file and notices on the console; a second call adds nothing."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    if not logger.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
        for handler, level in ((logging.FileHandler(path, encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(), logging.INFO)):
            handler.setLevel(level)
            handler.setFormatter(form)
            logger.addHandler(handler)
    return logger
