"""What reaches outside: network, recognisers, encoders; and a way to call them per partition.

A connector is built once in each Python worker. None of them is part of a query's result unless
the caller asks for it, and none needs more than a local server in tests.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
import urllib.error
import urllib.request
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.functions.urls import drive_file_id, host_class

ATTEMPTS = 3
# Where a shared file is fetched, how pages are asked for, and the block size of downloads.
DRIVE_ADDRESS = "https://drive.google.com/uc?export=download&id={}"
AGENT = "Mozilla/5.0"
BLOCK = 8192


class Connector(ABC):
    """Turns one text (an address, a path) into another, or None."""

    @abstractmethod
    def call(self, given: str) -> str | None: ...


class PageFetcher(Connector):
    """The body of a page with status 200, else None; an address that can't be reached is an error."""

    def __init__(self, timeout: float = 30.0) -> None:
        self.timeout = timeout

    def call(self, given: str) -> str | None:
        request = urllib.request.Request(given, headers={"User-Agent": AGENT})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                if answer.status != 200:
                    return None
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError:
            return None


class ArchiveDownloader(Connector):
    """Stores the shared file of an id in a folder and gives its path; any status but 200 is a RuntimeError."""

    def __init__(self, folder: str, address: str = DRIVE_ADDRESS, timeout: float = 300.0) -> None:
        self.folder, self.address, self.timeout = Path(folder), address, timeout

    def call(self, given: str) -> str:
        target = self.folder / f"{given}.tar"
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        self.folder.mkdir(parents=True, exist_ok=True)
        try:
            with urllib.request.urlopen(self.address.format(given), timeout=self.timeout) as answer, part.open("wb") as out:
                if answer.status != 200:
                    raise RuntimeError(f"download failed with status {answer.status}")
                while block := answer.read(BLOCK):
                    out.write(block)
            os.replace(part, target)
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"download failed with status {error.code}") from error
        finally:
            part.unlink(missing_ok=True)
        return str(target)


def _run(argv: list[str], timeout: float) -> str:
    return subprocess.run(argv, capture_output=True, text=True, check=True, timeout=timeout).stdout


class InfoExtractor(Connector):
    """What an external program prints of an address as one JSON object; any failure is '{}'."""

    def __init__(self, program: tuple[str, ...] = ("yt-dlp", "--dump-single-json", "--skip-download", "--no-playlist"), cookies: str | None = None, timeout: float = 300.0) -> None:
        self.argv = [*program, *(("--cookies", cookies) if cookies and os.path.exists(cookies) else ())]
        self.timeout = timeout

    def call(self, given: str) -> str:
        try:
            found = json.loads(_run([*self.argv, given], self.timeout))
        except (OSError, ValueError, subprocess.SubprocessError):
            return "{}"
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else "{}"


class Downloader(Connector):
    """Stores a medium with an external program and gives the path; a missing address or any failure is None.

    It is given JSON text with ``url``, ``original_filename`` and the optional settings ``video_download``
    (``format``, ``cookie_path``, ``noplaylist``).
    """

    def __init__(self, program: tuple[str, ...] = ("yt-dlp",), timeout: float = 3600.0) -> None:
        self.program, self.timeout = program, timeout

    def call(self, given: str) -> str | None:
        try:
            wanted = json.loads(given)
            settings = wanted.get("video_download") or {}
            if not wanted.get("url"):
                return None
            argv = [*self.program, "-o", wanted["original_filename"], "-f", settings.get("format") or "bestvideo+bestaudio/best"]
            if settings.get("cookie_path"):
                argv += ["--cookies", settings["cookie_path"]]
            if settings.get("noplaylist", True):
                argv.append("--no-playlist")
            _run([*argv, wanted["url"]], self.timeout)
        except (OSError, ValueError, KeyError, TypeError, AttributeError, subprocess.SubprocessError):
            return None
        return wanted["original_filename"]


class Encoder(Connector):
    """Runs an argument list given as JSON text and gives the output path, its last argument; any failure is None."""

    def __init__(self, timeout: float = 3600.0) -> None:
        self.timeout = timeout

    def call(self, given: str) -> str | None:
        try:
            argv = json.loads(given)
            _run(argv, self.timeout)
        except (OSError, ValueError, TypeError, subprocess.SubprocessError):
            return None
        return argv[-1]


class Recogniser(Connector):
    """Speech to text; ``task`` may be ``transcribe``, or ``translate`` for English text."""

    task = "transcribe"


class LocalRecogniser(Recogniser):
    """A recogniser of the whisper package; RuntimeError where it isn't installed."""

    def __init__(self, model: str = "base", task: str = "transcribe") -> None:
        try:
            import whisper
        except ImportError as error:
            raise RuntimeError("whisper package not available") from error
        self.model, self.task = whisper.load_model(model), task

    def call(self, given: str) -> str:
        options = {"task": "translate", "language": "en"} if self.task == "translate" else {}
        return self.model.transcribe(given, **options).get("text", "")


def recognised_text(df: DataFrame, path: str, out: str, make: Callable[[], Connector]) -> DataFrame:
    """Add ``out``: what a recogniser makes of each file; '' where it fails or understands nothing."""
    return apply_connector(df, path, out, make).withColumn(out, F.when(F.col(path).isNotNull(), F.coalesce(out, F.lit(""))))


def with_retries(call: Callable[[str], str | None], given: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep, strict: bool = False) -> str | None:
    """The first result that isn't None; waits 1, 2, 4 … seconds after failures. The last error counts as None unless ``strict``."""
    for attempt in range(attempts):
        try:
            found = call(given)
        except Exception:  # noqa: BLE001 - the caller sees a null and counts it
            if strict and attempt + 1 == attempts:
                raise
            found = None
        if found is not None:
            return found
        if attempt + 1 < attempts:
            wait(2.0**attempt)
    return None


def apply_connector(df: DataFrame, given: str, out: str, make: Callable[[], Connector], attempts: int = 1) -> DataFrame:
    """Add ``out``: the connector's result for each row's ``given`` (null for null)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        connector = make()
        for batch in batches:
            yield batch.map(lambda g: None if g is None else with_retries(connector.call, g, attempts))

    return df.withColumn(out, run(F.col(given)))


def drive_archives(df: DataFrame, url: str, strict: bool = True) -> DataFrame:
    """Rows of shared-drive addresses with ``file_id``; another host or an address without id is an error, or dropped where not ``strict``."""
    drive = host_class(F.col(url)) == "google_drive"
    found = drive_file_id(F.col(url))
    if not strict:
        return df.filter(drive & found.isNotNull()).withColumn("file_id", found)
    bad = F.raise_error(F.concat(F.lit("not a shared-drive file: "), F.coalesce(url, F.lit("null")))).cast("string")
    return df.withColumn("file_id", F.when(F.coalesce(drive, F.lit(False)) & found.isNotNull(), found).otherwise(bad))
