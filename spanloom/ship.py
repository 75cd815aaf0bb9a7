"""Bringing the library to the executors of a cluster where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def archive(path: str | Path) -> Path:
    """The library's modules and texts as a zip file, which Python can import from; also for ``spark-submit --py-files``."""
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(x for x in root.rglob("*") if x.suffix in (".py", ".xml")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    return Path(path)


def ship(spark: SparkSession) -> None:
    """Let the session's executors import the library: Spark hands the archive to each of them. Not needed where it is installed or
    was submitted with --py-files."""
    folder = tempfile.mkdtemp(prefix="spanloom-ship-")  # read by the driver alone
    spark.sparkContext.addPyFile(str(archive(f"{folder}/spanloom.zip")))
