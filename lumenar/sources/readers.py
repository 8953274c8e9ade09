"""File sources as DataFrames. Unreadable content gives null columns, not failures, unless stated."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.sources.connectors import Connector, PageFetcher, apply_connector, drive_archives, with_retries

CLIP_TYPE = "array<struct<name:string,start:double,end:double,text:string>>"


def metadata_documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, url, doc, default_tasks`` of each JSON object in a folder; other files and bad JSON are left out."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    rows = reader.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    doc = F.try_parse_json("value")
    parsed = rows.select("path", "value", doc.alias("doc")).filter(F.schema_of_variant("doc").startswith("OBJECT"))
    url = F.try_variant_get("doc", "$.url", "string")
    ledger = F.from_json("value", "default_tasks map<string,variant>")["default_tasks"]
    return parsed.select("path", url.alias("url"), "doc", ledger.alias("default_tasks"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of UTF-8 files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def _load_clips(name: str, data: bytes) -> list[dict] | None:
    """Clips of a JSON or YAML file: a list of clips, or lists of clips by name."""
    try:
        text = data.decode("utf-8")
        if name.lower().endswith((".yaml", ".yml")):
            import yaml

            loaded = yaml.safe_load(text)
        else:
            loaded = json.loads(text)
    except Exception:  # noqa: BLE001 - a broken or unsupported file is a null row
        return None
    if isinstance(loaded, dict):
        pairs = [(k, c) for k, v in loaded.items() for c in (v if isinstance(v, list) else [v])]
    elif isinstance(loaded, list):
        pairs = [(c.get("name") if isinstance(c, dict) else None, c) for c in loaded]
    else:
        return None
    number = lambda v: None if v is None else float(v)
    out = []
    for key, clip in pairs:
        if isinstance(clip, dict):
            out.append({"name": key, "start": number(clip.get("start")), "end": number(clip.get("end")), "text": clip.get("text")})
        elif isinstance(clip, (list, tuple)) and len(clip) >= 2:
            out.append({"name": key, "start": number(clip[0]), "end": number(clip[1]), "text": clip[2] if len(clip) > 2 else None})
    return out


def clip_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, clips`` of JSON and YAML clip lists; null where a file can't be read (or YAML isn't installed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "clips": [_load_clips(p, c) for p, c in zip(batch["path"], batch["content"])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, clips {CLIP_TYPE}")


_MEMBERS = "archive string, member string, size bigint, content binary"


def _members(name: str, data: bytes) -> pd.DataFrame:
    rows = []
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
            rows = [(name, m.name, m.size, archive.extractfile(m).read()) for m in archive if m.isreg()]
    except tarfile.TarError:
        pass
    return pd.DataFrame(rows, columns=["archive", "member", "size", "content"])


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, size, content`` of the regular files in tar archives of any compression.

    Nothing is written to disk, so a member's name can't escape a folder. Links and directories are
    left out; an archive that can't be read gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield _members(name, data)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _MEMBERS)


def fetched_archives(df: DataFrame, url: str, make: Callable[[], Connector], attempts: int = 1, strict: bool = True) -> DataFrame:
    """``archive, member, size, content`` of shared-drive archives.

    ``make`` gives a downloader that is called with a file's id and returns the path it stored it
    under; an archive is stored and read by one task, so no other machine needs its file. An address
    of another host, and where ``strict`` a failed download, is an error; else it gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        downloader = make()
        for batch in batches:
            for file_id in batch["file_id"]:
                path = with_retries(downloader.call, file_id, attempts, strict=strict)
                if path is not None:
                    with open(path, "rb") as f:
                        yield _members(path, f.read())

    return drive_archives(df, url, strict).select("file_id").mapInPandas(run, _MEMBERS)


def fetched_pages(df: DataFrame, url: str, make: Callable[[], Connector] = PageFetcher, out: str = "html") -> DataFrame:
    """Add ``out``: each page's HTML; null where it has another status than 200 or can't be reached."""
    return apply_connector(df, url, out, make)


def url_batch(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, url, title, date, tasks`` of JSON array files of addresses."""
    kind = "array<struct<url:string,title:string,date:string,tasks:map<string,boolean>>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("x"))
    return rows.select("file", F.posexplode("x").alias("pos", "entry")).select("file", "pos", "entry.*")
